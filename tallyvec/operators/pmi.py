"""Positive pointwise mutual information over coordinate tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvec.sources.stage import small


def _share(sums: DataFrame, key: str) -> DataFrame:
    total = sums.agg(F.sum("s").alias("total"))
    # One row; the cross join is a lookup of a constant.
    return sums.join(F.broadcast(total)).select(key, (F.col("s") / F.col("total")).alias("p"))


def row_marginals(matrix: DataFrame) -> DataFrame:
    """``px(row, p)``: the share of each row in the total."""
    return _share(matrix.groupBy("row").agg(F.sum("v").alias("s")), "row")


def col_marginals(matrix: DataFrame) -> DataFrame:
    """``py(col, p)``: the share of each column in the total."""
    return _share(matrix.groupBy("col").agg(F.sum("v").alias("s")), "col")


def count_marginals(vocab: DataFrame) -> DataFrame:
    """``py(col, p)`` from the word counts of the vocabulary."""
    return _share(vocab.select(F.col("idx").alias("col"), F.col("cnt").alias("s")), "col")


def smooth_contexts(py: DataFrame, beta: float) -> DataFrame:
    """Raise ``py(col, p)`` to ``beta`` and normalise; unchanged unless ``beta < 1``."""
    if beta >= 1:
        return py
    return _share(py.select("col", F.pow("p", F.lit(float(beta))).alias("s")), "col")


# Sums of doubles depend on their order in the last digits. A value this close to the
# threshold reaches it, and a PMI this close to zero is zero.
ROUNDING = 1e-12


def pmi_threshold(min_pmi: float) -> float:
    """The smallest ``exp(pmi)`` that is kept."""
    return (1.0 if min_pmi == 0 else math.exp(min_pmi)) * (1 - ROUNDING)


def _cut_log(exp_pmi: Column, min_pmi: float) -> Column:
    return F.when(exp_pmi >= F.lit(pmi_threshold(min_pmi)), F.log(exp_pmi))


def _apply(
    matrix: DataFrame,
    py: DataFrame,
    min_pmi: float,
    alpha: float,
    n_rows: int | None,
    n_cols: int | None,
    keep: list[str],
) -> DataFrame:
    # p(x,y) / p(x) = x_ij / rowsum_i: the total cancels, so no pass over the matrix is
    # needed for it. A zero row or context probability gives no entry at all.
    row_sums = small(matrix.groupBy("row").agg(F.sum("v").alias("row_sum")), n_rows)
    contexts = small(py.filter("p > 0"), n_cols)
    joined = matrix.join(row_sums, "row").join(contexts, "col").filter("row_sum > 0")
    exp_pmi = (F.col("v") / F.col("row_sum")) / (F.col("p") + F.lit(float(alpha)))
    return (
        joined.select("row", "col", *keep, _cut_log(exp_pmi, min_pmi).alias("pmi"))
        # Entries below the threshold come out null.
        .filter(F.abs("pmi") > ROUNDING)
    )


def train_pmi(
    matrix: DataFrame,
    py: DataFrame | None = None,
    min_pmi: float = 0.0,
    alpha: float = 0.0,
    beta: float = 1.0,
    n_rows: int | None = None,
    n_cols: int | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``pmi(row, col, pmi)`` and the context probabilities ``py(col, p)`` that it used.

    ``exp(pmi) = p(x,y) / (p(x) (p(y) + alpha))``; values under ``exp(min_pmi)`` are cut
    off, the others are not shifted. With ``beta < 1`` the context probabilities are
    smoothed and normalised; otherwise a given ``py`` is used as it is. Known sizes let the
    marginals be broadcast instead of shuffling the matrix to them. ``keep`` names columns
    of the matrix to carry along.
    """
    py = smooth_contexts(col_marginals(matrix) if py is None else py, beta)
    return _apply(matrix, py, min_pmi, alpha, n_rows, n_cols, keep or []), py


def weight_by_count(pmi: DataFrame) -> DataFrame:
    """``count * pmi`` for a ``train_pmi(..., keep=["v"])`` result, as ``m(row, col, v)``."""
    return pmi.select("row", "col", (F.col("v") * F.col("pmi")).alias("v"))
