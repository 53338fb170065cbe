"""Subwords of a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.functions.text import subwords


def subword_table(words: DataFrame, min_n: int = 3, max_n: int = 6) -> DataFrame:
    """``(word, pos, subword)``: the marked word first, then its character n-grams.

    A marked word whose length is itself within the range appears a second time among the
    n-grams.
    """
    grams = F.posexplode(subwords(F.col("word"), min_n, max_n)).alias("pos", "subword")
    return words.select("word", grams)


def subword_counts(vocab: DataFrame, min_n: int = 3, max_n: int = 6) -> DataFrame:
    """``(subword, cnt)``: corpus frequency of each subword over ``vocab(word, cnt)``."""
    grams = F.explode(subwords(F.col("word"), min_n, max_n)).alias("subword")
    return vocab.select("cnt", grams).groupBy("subword").agg(F.sum("cnt").alias("cnt"))
