"""Encoding by pieces is exactly that of the library, whatever the white space and the order of texts."""

import random

import public_tokenizers

from tallyvec.llm import tokens

PLAIN = ["a", "word", "'s", "'ll", "don't", "1", "42", "é", "ß", "中文", "!", "...", "-", "x" * 30, "\U0001f600", "\u0301"]
ODD = [
    " ", "  ", "\n", "\n\n", "\n\n\n", "\t", " \n", "\n ", "\xa0", "\u3000", "\u2028", "\u200b", "\x85", "\x1c", "\r\n",
    "\x0b", "<|endoftext|>", "<|endof", "\0", "\u180e", "\ufeff",
]


def test_pieces_are_exact():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng, n = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(1), 0
    plain, own_plain = Tokenizer.from_file(path), tokens.Encoder(path, plain=True)
    plain.encode_special_tokens = True
    while n < 50_000:
        batch = ["Title\n\n\nname\tvalue\tunit", "a\n\n\nb\tc\td", "\xa0\xa0x", ""] if n == 0 else []
        for _ in range(rng.randint(1, 60)):
            words = rng.choices(PLAIN if rng.random() < 0.5 else PLAIN + ODD, k=rng.randint(0, 12))
            batch.append(rng.choice(["", " "]).join(words) if rng.random() < 0.5 else "".join(w + rng.choice(" \n") for w in words))
        want = [x.ids for x in library.encode_batch_fast(batch, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode_many(batch)] == want
        batch = [" " + t for t in batch]
        want = [x.ids for x in plain.encode_batch_fast(batch, add_special_tokens=False)]
        assert [x.tolist() for x in own_plain.encode_many(batch)] == want
        n += len(batch)


def test_forgetting_changes_nothing(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "LEARNT", 7)
    own, rng = tokens.Encoder(path, most=50), random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(30))
        assert own.encode(text).tolist() == own._whole(text).tolist()


def test_workers_keep_no_pieces_between_tasks(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = tokens.write_tokens(docs, path, str(tmp_path), end_id=2)
    assert tokens.read_tokens(spark, files).count() == 200

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            known = [len(v.known) for k, v in sys.__dict__.get("_tallyvec_kept", {}).items() if k[0] == "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64())], ["n"])

    sizes = [r.n for r in spark.range(0, 64, 1, 32).mapInArrow(held, "n long").collect()]
    assert sizes and max(sizes) == 1
