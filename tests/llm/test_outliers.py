"""Outliers where junk is a large part of a group, against a search over subsets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvec.llm import outliers


def ordinary(rng):
    words = "the of and with over then river mountain Paris house small green water".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(60, 240)))


def junk(rng):
    return " ".join("".join(rng.choice("AB#$%QX*") for _ in range(rng.randint(9, 14))) for _ in range(rng.randint(60, 240)))


@pytest.mark.parametrize("share", [0.1, 0.3, 0.4])
def test_junk_is_rejected_however_much_there_is(spark, share):
    rng = random.Random(int(share * 100))
    n = round(400 * share / (1 - share))
    rows = [(i, ordinary(rng), "en", "a") for i in range(400)] + [(1000 + i, junk(rng), "en", "a") for i in range(n)]
    rows += [(5000 + i, ordinary(rng), "en", "tiny") for i in range(5)] + [(6000, junk(rng), "en", "tiny")]
    rows += [(7000 + i, ordinary(rng), None, None) for i in range(5)] + [(8000, junk(rng), None, None), (8001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("t", F.lit(1))
    got = {r.doc_id: r for r in outliers.judge(docs.withColumn("start", F.lit("x"))).collect()}
    assert len(got) == len(rows)
    kept = [i for i in got if got[i].kept]
    assert not [i for i in kept if 1000 <= i < 5000 or i in (6000, 8000, 8001)]
    assert len([i for i in kept if i < 400]) >= 392  # a few beyond the cut
    assert all(got[i].kept for i in got if 5000 <= i < 5005 or 7000 <= i < 7005)


def lowest(points, starts=300):
    """The lowest determinant of the core's covariance, by concentration from random subsets."""
    rng = np.random.default_rng(0)
    floor, best = np.diag(np.square(outliers.FLOOR)), np.inf
    for _ in range(starts):
        own = points[rng.choice(len(points), 6, replace=False)]
        for _ in range(30):
            cov = np.cov(own.T, bias=True) * outliers.CORE_SCALE + floor
            off = points - own.mean(0)
            d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
            own = points[d <= np.sort(d)[(len(points) + 1) // 2 - 1]]
        best = min(best, np.linalg.slogdet(np.cov(own.T, bias=True) * outliers.CORE_SCALE + floor)[1])
    return best


def test_determinant_is_that_of_a_search(spark):
    rng = np.random.default_rng(5)
    groups = {"one": rng.normal(size=(120, 5)), "two": np.vstack([rng.normal(size=(70, 5)), rng.normal(7, 1.0, size=(50, 5))])}
    rows = [(t, *map(float, p)) for t, points in groups.items() for p in points]
    members = spark.createDataFrame(rows, "t string, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = {r.t: r for r in outliers.estimates(members).collect()}
    for t, points in groups.items():
        off = points - np.array(found[t].center)
        d = np.einsum("ij,jk,ik->i", off, np.array(found[t].inverse).reshape(5, 5), off)
        core = points[d <= np.sort(d)[(len(points) + 1) // 2 - 1]]
        cov = np.cov(core.T, bias=True) * outliers.CORE_SCALE + np.diag(np.square(outliers.FLOOR))
        # The start counts, and the last fit is made of more than the core.
        assert np.linalg.slogdet(cov)[1] <= lowest(points) + 0.6
    assert d[70:].min() > outliers.CUT  # the fifty that lie apart
