"""Alignment of two tokenizers against brute force, one document at a time."""

import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers

from tallyvec.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "  a  b ", "é ☃ 　x", "<|endoftext|> <s> <unk>", "▁x", "\0a", "ﬁ", "a\tb\n\n c", "x" * 500,
    "\U0001f600 " * 40, "word " * 30_000,
]


def spans(ids, pieces):
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends], ends, ids))


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {v: k for k, v in one.get_vocab().items()}
    letters = alignment._byte_letters()
    count, best, found = collections.Counter(), collections.Counter(), []
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        left = [bytes(letters[c] for c in names[i]) for i in a]
        right = [bytes([int(p[1:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
                 for i in b for p in [two.id_to_piece(i)]]
        if not text or not b"".join(left) == b"".join(right) == b" " + text.encode():
            found.append(([], [], [], ""))
            continue
        x, y = spans(a, left), spans(b, right)
        links, at = [], 0
        for start, end, i in x:
            while y[at][1] <= start:
                at += 1
            j = at
            while j < len(y) and y[j][0] < end:
                links.append((i, y[j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = [[[], []] for _ in cuts]
        for side, tokens in enumerate((x, y)):
            for (_, end, i) in tokens:
                groups[bisect.bisect_left(cuts, end)][side].append(str(i))
        count.update(links)
        found.append((a, b, links, ";".join(",".join(g) + "|" + ",".join(h) for g, h in groups)))
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = [
        (len(a), len(b), text.count("|"), len(links), sum(count[x] == best[x[1]] for x in links),
         sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for a, b, links, text in found
    ]
    return rows, count, collections.Counter(x for _, _, links, _ in found for x in set(links))


def test_alignment(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "dup"), (3, "dup"), (4, None)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    # Columns named like those of the result.
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_links int, chunk string")
    want, links, in_docs = brute([t for _, t in rows])
    for sizes in ((4 << 20, 16 << 20), (20_000, 100_000)):  # one chunk a task; many chunks and bands
        got, pairs = alignment.align(docs.repartition(5), A, B, *sizes)
        columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert got.columns == columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *r)) for (i, _), r in zip(rows, want))
        pairs = pairs.collect()
        assert {(r.a_id, r.b_id): r.n_links for r in pairs} == links
        assert {(r.a_id, r.b_id): r.n_docs for r in pairs} == in_docs
    empty, pairs = alignment.align(docs.where("false"), A, B)
    assert empty.collect() == [] == pairs.collect()


def test_postings_come_back():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(draw.integers(1, 300)), int(draw.integers(1, 300))
        pairs = draw.integers(0, 4, m) << 32 | draw.integers(0, draw.integers(1, 60), m)
        made = alignment.entries(pairs, draw.integers(0, n, m))
        packed = alignment.pack_postings(*made, n)
        back = alignment.unpack_postings(*packed, n)
        assert all(np.array_equal(a, b) for a, b in zip(made, back))
        distinct, docs, links = alignment.popcounts(*packed, n)
        assert np.array_equal(distinct, made[0])
        assert np.array_equal(docs, np.bincount(made[1])) and np.array_equal(links, np.bincount(made[1], made[3]))
