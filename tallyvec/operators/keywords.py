"""Keywords of labels by proportion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.sources.stage import small


def proportion_keywords(
    scores: DataFrame,
    min_score: float = 0.5,
    topk: int = 30,
    candidates_topk: int = 100,
    words: DataFrame | None = None,
    stopwords: DataFrame | None = None,
    is_stopword: Callable[[Column], Column] | None = None,
    n_words: int | None = None,
) -> DataFrame:
    """``keywords(row, rank, col, score)`` from a sparse table ``scores(row, col, v)``.

    For a term with share p of its label and share n of all other labels together, the
    score is p / (p + n). Per label the ``candidates_topk`` largest shares are scored, those
    reaching ``min_score`` are kept, stop words are removed and the best ``topk`` stay
    (``topk <= 0``: all). A label that is the only one, or is empty, has no keywords.

    ``words(idx, word)`` adds the word and is needed for the stop rules. Both cuts are
    ranked windows with a limit, which Spark applies before the shuffle too, so a label
    with most of the entries sends only its candidates.
    """
    cells = scores.select("row", "col", "v")
    label_sums = cells.groupBy("row").agg(F.sum("v").alias("label_sum"))
    term_sums = small(cells.groupBy("col").agg(F.sum("v").alias("term_sum")), n_words)
    total = label_sums.agg(F.sum("label_sum").alias("total"))

    by_share = Window.partitionBy("row").orderBy(F.desc("v"), F.asc("col"))
    candidates = (
        # The share is v over a sum that is the same for the whole label.
        cells.filter("v > 0")
        .withColumn("place", F.row_number().over(by_share))
        .filter(F.col("place") <= candidates_topk)
    )
    p = F.col("v") / F.col("label_sum")
    n = (F.col("term_sum") - F.col("v")) / F.col("others")
    scored = (
        candidates.join(label_sums, "row")
        .join(term_sums, "col")
        .join(F.broadcast(total))
        .withColumn("others", F.col("total") - F.col("label_sum"))
        # With no other labels n is undefined and nothing reaches the minimum.
        .filter("others > 0")
        .select("row", "col", "v", (p / (p + n)).alias("score"))
        .filter(F.col("score") >= min_score)
    )
    named = ["col"]
    if words is not None:
        names = small(words.select(F.col("idx").alias("col"), "word"), n_words)
        scored, named = scored.join(names, "col"), ["col", "word"]
    if stopwords is not None:
        scored = scored.join(stopwords, "word", "left_anti")
    if is_stopword is not None:
        scored = scored.filter(~is_stopword(F.col("word")))
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("v"), F.asc("col"))
    ranked = scored.withColumn("rank", F.row_number().over(by_score))
    if topk > 0:
        ranked = ranked.filter(F.col("rank") <= topk)
    return ranked.select("row", "rank", *named, "score")
