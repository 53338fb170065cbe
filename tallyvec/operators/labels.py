"""Label-word counts and the label index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.functions.sums import count_labels
from tallyvec.operators.ranking import dense_index
from tallyvec.operators.vocabulary import place_key
from tallyvec.sources.stage import small


def count_label_words(
    sentences: DataFrame, vocab: DataFrame, n_vocab: int | None = None
) -> DataFrame:
    """``(label, col, cnt, first)`` from labelled sentences.

    Every in-vocabulary word of a sentence counts once per label, repeated labels
    repeatedly. A task counts bounded stretches of text by label and word, and the counts are looked
    up. ``first`` orders the labels by first appearance among the sentences that have a known word.
    """
    ids = small(vocab.select("word", F.col("idx").alias("col")), n_vocab)
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = f"label string, word string, cnt long, doc_id {kinds['doc_id']}, sent_no {kinds['sent_no']}, pos int"
    counts = sentences.select("doc_id", "sent_no", "labels", "words").mapInArrow(count_labels, schema)
    return (
        counts.join(ids, "word")
        .select("label", "col", "cnt", place_key("pos").alias("first"))
        # Most labels and words meet in one stretch only, so nothing is combined again before the shuffle.
        .repartition("label", "col")
        .groupBy("label", "col")
        .agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
    )


def index_labels(counts: DataFrame) -> tuple[DataFrame, int]:
    """``labels(idx, label)`` in order of first appearance, and their number."""
    firsts = counts.groupBy("label").agg(F.min("first").alias("first"))
    labels, size = dense_index(firsts, [F.asc("first")], name="labels")
    return labels.select("idx", "label"), size


def label_word(sentences: DataFrame, vocab: DataFrame, n_vocab: int | None = None) -> DataFrame:
    """``dw(label, word, cnt)`` over the words of the vocabulary."""
    words = small(vocab.select(F.col("idx").alias("col"), "word"), n_vocab)
    counts = count_label_words(sentences, vocab, n_vocab)
    return counts.join(words, "col").select("label", "word", "cnt")
