"""Long texts, clashing names, and targets that can be met to the word."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvec.llm import mixing, secrets

SF = "/root/testdata/sf0.001"


def test_many_secrets_in_one_text(spark):
    """Twenty thousand spans, where a list copied per span would take minutes."""
    rng = random.Random(1)
    text, want, at = [], [], 0
    for _ in range(20_000):
        word = "".join(rng.choice("0123456789abcdef") for _ in range(16))
        want.append(f"hex:{at}:{at + 16}")
        text.append(word)
        at += 17
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "")], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[1].base == ",".join(want) and got[1].n_hex == len(want) and got[2].base == ""
    assert time.time() - begin < 60


def test_large_documents_do_not_spoil_a_target(spark):
    rng = random.Random(7)
    rows = []
    for s in range(6):
        sizes = [rng.randint(5, 40) for _ in range(60)] + [rng.randint(60, 300) for _ in range(30)] + [4000, 2600]
        rows += [(1000 * s + i, f"src{s}", "w " * n) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.sample(docs).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")
    ).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 0.01 * r.target and r.most <= 3


def test_landing_keeps_decided_documents():
    rng = np.random.default_rng(0)
    p, x = rng.choice([0.0, 0.3, 0.6, 1.0], 200), rng.integers(1, 50, 200).astype(float)
    free = (p > 0) & (p < 1)
    done = mixing.landing(mixing.flight(p, x, mixing.LANDING), x, float(p @ x), free)
    assert set(done) <= {0.0, 1.0} and (done[~free] == p[~free]).all()
    assert abs(done @ x - p @ x) <= 1 and abs(done.sum() - p.sum()) <= 3


@pytest.mark.parametrize("number", range(5))
def test_stages_stand_odd_rows_and_names(spark, tmp_path, number):
    """Nulls in any column, empty and repeated rows, names that operators use themselves, and no rows."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, turn long, n_words long, spans string, n_hit long, point long"
    rows = [(*r, 1, 2, "s", 3, 4) for r in base]
    rows += [(None, None, None, None, None, None, None, None, None, None), (7, "", "en", None, 0, 1, 1, "", 1, 1)] + [rows[3]] * 3
    rows += [(8, "word " * 50_000, None, "a", 1, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    name, stage = corpus_pipeline.STAGES[number]
    for given in (docs, docs.where("false")):
        out = stage(spark, given, SF)
        if number < 4:
            assert out.columns == docs.columns, name
            if number < 3:
                assert not collections.Counter(map(tuple, out.collect())) - collections.Counter(map(tuple, given.collect()))
        else:
            assert out.count() == given.count()
        if not given.take(1):
            assert out.count() == 0
