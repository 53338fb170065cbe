"""Vocabulary scan, word index, encoding and the sentence ordinal."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.functions.sums import count_words
from tallyvec.operators.ranking import dense_index, running_offset
from tallyvec.sources.stage import small


def place_key(key: str) -> Column:
    """``(doc_id, sent_no, position)`` as one 38-digit number, in the same order.

    A struct would turn the hash aggregation of the minimum into a sort; a wide decimal
    is updated in place.
    """
    within = F.shiftleft(F.col("sent_no").cast("long"), 31).bitwiseOR(F.col(key).cast("long"))
    high = F.col("doc_id").cast("decimal(19,0)") * F.lit(Decimal(10) ** 18 * 5).cast("decimal(19,0)")
    return (high + within.cast("decimal(19,0)")).cast("decimal(38,0)")


def word_counts(sentences: DataFrame, min_count: int = 1) -> DataFrame:
    """``counts(word, cnt, first)`` of the words seen ``min_count`` times or more.

    ``first`` orders the words by first appearance. A task counts bounded stretches of text, so its memory
    does not grow with its input, and a word that makes up a third of the text costs one row per stretch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = f"word string, cnt long, doc_id {kinds['doc_id']}, sent_no {kinds['sent_no']}, pos int"
    counts = sentences.select("doc_id", "sent_no", "words").mapInArrow(count_words, schema)
    return (
        # What is left of a word after the stretches is not worth combining again before the shuffle.
        counts.repartition("word")
        .groupBy("word")
        .agg(F.sum("cnt").alias("cnt"), F.min(place_key("pos")).alias("first"))
        .filter(F.col("cnt") >= min_count)
    )


def scan_vocabulary(sentences: DataFrame, min_count: int) -> DataFrame:
    """``counts(word, cnt)`` of the words seen ``min_count`` times or more."""
    return (
        sentences.select(F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") >= min_count)
    )


def index_vocabulary(sentences: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """``vocab(idx, word, cnt)`` by falling count, ties by first appearance, and its size."""
    counts = word_counts(sentences, min_count)
    vocab, size = dense_index(counts, [F.desc("cnt"), F.asc("first")], name="vocab")
    return vocab.select("idx", "word", "cnt"), size


def encode_words(
    df: DataFrame, vocab: DataFrame, n_vocab: int | None = None, word: str = "word"
) -> DataFrame:
    """Replace the word column by its index and drop the rows of unknown words."""
    keys = small(vocab.select(F.col("word").alias(word), "idx"), n_vocab)
    return df.join(keys, word).drop(word)


def decode_words(
    df: DataFrame, vocab: DataFrame, n_vocab: int | None = None, idx: str = "idx"
) -> DataFrame:
    """Replace the index column by its word."""
    keys = small(vocab.select(F.col("idx").alias(idx), "word"), n_vocab)
    return df.join(keys, idx).drop(idx)


def document_offsets(sentences: DataFrame) -> tuple[DataFrame, int, int]:
    """``(doc_id, first_sentence, numbers)``: the sentences before each document.

    ``numbers`` lists the sentences of a document from which some were left out, and is null for
    one that has all from 0 on. Also the number of sentences and of documents. Only numbers are
    grouped and sorted, no texts.
    """
    left = F.sort_array(F.collect_list("sent_no"))
    sizes = sentences.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sents"), F.max("sent_no").alias("last"), left.alias("numbers")
    )
    whole = F.col("last") + 1 == F.col("n_sents")
    sizes = sizes.select("doc_id", "n_sents", F.when(~whole, F.col("numbers")).alias("numbers"))
    offsets, total, n_docs = running_offset(
        sizes, [F.col("doc_id")], "n_sents", "first_sentence", name="sentences"
    )
    return offsets.select("doc_id", "first_sentence", "numbers"), total, n_docs


def index_sentences(sentences: DataFrame) -> tuple[DataFrame, int]:
    """Add ``i_sent``, the ordinal of each sentence in the corpus, and return their number.

    Sentences are counted within their document, so numbers that a filter has left out make
    no gap: a sentence looks up its place among those that are left. One row per document is sorted; the
    sentences themselves stay where they are, as long as the documents' numbers are small enough to be sent.
    """
    offsets, total, n_docs = document_offsets(sentences)
    place = F.coalesce(F.array_position("numbers", F.col("sent_no")) - 1, F.col("sent_no"))
    # Sixteen listed numbers take as much as another row.
    listed = offsets.agg(F.sum(F.greatest(F.size("numbers"), F.lit(0)))).first()[0] or 0
    indexed = sentences.join(small(offsets, n_docs + listed // 16), "doc_id").withColumn("i_sent", F.col("first_sentence") + place)
    return indexed.drop("first_sentence", "numbers"), total
