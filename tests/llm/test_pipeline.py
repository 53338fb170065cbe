"""Each stage of the pipeline against brute force over what it was given."""

import collections
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tallyvec.llm import decontaminate, kneser_ney, mixing, queries
from tests.llm.test_operators import SF, classes, fingerprint


def key(row):
    return (row.doc_id, row.text, row.lang, row.source, row.n_chars)


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{number}")
        seen[number] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{number}"))
        docs = seen[number][1]
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    given, quality = seen[0]
    judged = kneser_ney.classify(spark.createDataFrame(given), queries.trusted_ids(spark, SF)).where("kept").collect()
    assert {r.doc_id for r in quality.collect()} == {r.doc_id for r in judged}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = collections.Counter(labels[r.doc_id] for r in quality.collect() if r.doc_id in labels)
    every = collections.Counter(labels[r.doc_id] for r in given if r.doc_id in labels)
    assert left[1] >= 0.95 * every[1] and left[0] <= 0.4 * every[0]

    given, single = seen[1]
    given = sorted(given, key=lambda r: r.doc_id)
    label = classes([fingerprint(r.text) for r in given], 3)
    first = {c: key(r) for r, c in reversed(list(zip(given, label)))}
    assert sorted(map(key, single.collect())) == sorted(first.values())

    given, clean = seen[2]
    windows = {
        tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()
        if (w := decontaminate.normal_words(r.text)) for i in range(max(1, len(w) - 9))
    }
    sizes = {len(w) for w in windows}

    def hit(text):
        w = decontaminate.normal_words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(map(key, clean.collect())) == sorted(key(r) for r in given if not hit(r.text))

    given, mixed = seen[3]
    copies = {r.doc_id: r.copies for r in mixing.sample(spark.createDataFrame(given)).collect()}
    want = collections.Counter({key(r): copies[r.doc_id] for r in given if copies[r.doc_id]})
    assert collections.Counter(map(key, mixed.collect())) == want

    given, encoded = seen[4]
    coder = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    at, want = 0, []
    for r in sorted(given, key=lambda r: r.doc_id):
        ids = coder.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in encoded.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
