"""Neighbour lists as text: one line per query, one folder per set of queries.

A line reads ``query,[('word', 0.9), ("it's", 0.8)]``: the query up to the first ``,[``, then pairs
as Python writes them, by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word between single or double quotes, with a backslash before what would end it; a number.
PAIR = r"""\((?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"), ([-+0-9.eEinfa]+)\)"""


def _quoted(word: Column) -> Column:
    safe = F.replace(word, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(word, F.lit("'")) & ~F.contains(word, F.lit('"'))
    single = F.replace(safe, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), single, F.lit("'")))


def write_neighbour_lists(neighbours: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``neighbours(set, query, rank, word, sim)`` as ``path/set=.../*.txt``, by query.

    A list is as long as the ranks of its query. Sets and queries are spread over the tasks, so a large
    set is written by several.
    """
    pairs = F.array_sort(F.collect_list(F.struct("rank", "word", "sim")))
    lists = neighbours.groupBy("set", "query").agg(pairs.alias("pairs"))
    items = F.transform(
        "pairs", lambda p: F.concat(F.lit("("), _quoted(p["word"]), F.lit(", "), p["sim"].cast("string"), F.lit(")"))
    )
    line = F.concat("query", F.lit(",["), F.array_join(items, ", "), F.lit("]"))
    ordered = lists.sortWithinPartitions("set", "query").select("set", line.alias("value"))
    ordered.write.mode(mode).partitionBy("set").text(path)


def read_neighbour_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(set, query, rank, word, sim)`` of the lists in a folder; ranks count from 1."""
    lines = spark.read.schema("value string, set string").text(path).where("value <> ''")
    at = F.instr("value", ",[")
    line = lines.select("set", F.substring(F.col("value"), F.lit(1), at - 1).alias("query"), F.substring("value", at + 1, F.length("value")).alias("rest"))
    parts = [F.regexp_extract_all("rest", F.lit(PAIR), F.lit(n)) for n in (1, 2, 3)]
    pairs = line.select("set", "query", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc")])).alias("place", "p"))
    word = F.regexp_replace(F.concat("p.a", "p.b"), r"\\(.)", "$1")
    return pairs.select(
        "set", "query", (F.col("place") + 1).alias("rank"), word.alias("word"), F.col("p.c").cast("double").alias("sim")
    )
