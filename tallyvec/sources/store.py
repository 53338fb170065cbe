"""Saving and loading the tables of a model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """Write each table as parquet under ``folder/name``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def load_tables(
    spark: SparkSession, folder: str, names: list[str], fallback: str | None = None
) -> dict[str, DataFrame]:
    """Read tables saved by ``save_tables``.

    A table missing from ``folder`` is read from ``fallback``, as a partial model shares
    the vocabulary of the full one.
    """
    tables = {}
    for name in names:
        try:
            tables[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException:
            if fallback is None:
                raise
            tables[name] = spark.read.parquet(f"{fallback.rstrip('/')}/{name}")
    return tables


def export_words(vocab: DataFrame, path: str, mode: str = "error") -> None:
    """Write the words of ``vocab(idx, word, ...)`` as text, one per line in index order."""
    vocab.orderBy("idx").select(F.col("word").alias("value")).write.mode(mode).text(path)
