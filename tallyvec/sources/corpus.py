"""Corpora as DataFrames.

``docs(doc_id LONG, text STRING)`` is a table of documents; ``doc_id`` is the
ordinal of the document. ``sentences(doc_id, sent_no, words ARRAY<STRING>)`` is what
the counting operators read, optionally with ``labels ARRAY<STRING>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.functions.text import split_pieces, split_words, strip
from tallyvec.sources.stage import small

# Word sets up to this size are compiled into the filter; larger ones are joined.
LITERAL_WORDS = 1_000


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Read text files, one document per line, as ``docs(doc_id, text)``.

    ``doc_id`` is the line number over all files in path order, blank lines included.
    Each file split is numbered on its own; the line counts of the earlier splits, one
    row per split, shift it. Nothing is sorted or shuffled but those counts.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    splits = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")
    )
    # One row per file split: driver-sized, like the file listing itself.
    total, shifts = 0, []
    for r in sorted(splits.collect(), key=lambda r: (r["file"], r["start"])):
        shifts.append((r["file"], r["start"], total - r["first_row"]))
        total += r["n"]
    shift = spark.createDataFrame(shifts, "file string, start bigint, shift bigint")
    return lines.join(F.broadcast(shift), ["file", "start"]).select(
        (F.col("row_id") + F.col("shift")).alias("doc_id"), "text"
    )


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Read a word list, one word per line, as distinct ``words(word)``."""
    return distinct_words(spark.read.text(path).select(F.col("value").alias("word")))


def distinct_words(lines: DataFrame) -> DataFrame:
    """Strip the lines of ``lines(word)``, drop the blank ones and keep each word once."""
    return lines.select(strip(F.col("word")).alias("word")).filter("word <> ''").distinct()


def scan_corpus(docs: DataFrame, lowercase: bool = True) -> DataFrame:
    """Lower-case and strip the text of each document and drop the blank documents."""
    text = F.lower("text") if lowercase else F.col("text")
    return docs.withColumn("text", strip(text)).filter("text <> ''")


def limit_documents(docs: DataFrame, num_doc: int = -1) -> DataFrame:
    """Keep the documents with an ordinal below ``num_doc``; all of them if it is not positive.

    Blank documents count, so this goes before ``scan_corpus``.
    """
    return docs.filter(F.col("doc_id") < num_doc) if num_doc > 0 else docs


def corpus_length(docs: DataFrame) -> DataFrame:
    """The number of lines of the corpus, blank ones included, as ``corpus_len(n_docs)``."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def tokenize_sentences(
    docs: DataFrame, separator: str = "\n", lowercase: bool = True
) -> DataFrame:
    """Split documents into ``sentences(doc_id, sent_no, words)``.

    Empty pieces are dropped. A piece of whitespace only stays as an empty sentence and
    keeps its number.
    """
    pieces = scan_corpus(docs, lowercase).select(
        "doc_id", F.posexplode(split_pieces(F.col("text"), separator)).alias("sent_no", "piece")
    )
    return pieces.select("doc_id", "sent_no", split_words(F.col("piece")).alias("words"))


def labelled_sentences(
    docs: DataFrame, separator: str = "\n", lowercase: bool = True
) -> DataFrame:
    """Split ``labels<TAB>text[<TAB>text...]`` into ``sentences(doc_id, sent_no, labels, words)``.

    A document without a tab is its own label, ``__doc{doc_id}__``. Every sentence
    carries all labels of its document.
    """
    columns = F.split("text", "\t")
    own_label = F.array(F.concat(F.lit("__doc"), F.col("doc_id").cast("string"), F.lit("__")))
    has_labels = F.size("columns") > 1
    # The sentence separator may span no column border, so columns are split one by one.
    texts = F.when(has_labels, F.slice("columns", 2, F.size("columns"))).otherwise(F.col("columns"))
    pieces = F.flatten(F.transform(texts, lambda t: split_pieces(t, separator)))
    return (
        scan_corpus(docs, lowercase)
        .select("doc_id", columns.alias("columns"))
        .select(
            "doc_id",
            F.when(has_labels, split_words(F.element_at("columns", 1)))
            .otherwise(own_label)
            .alias("labels"),
            F.posexplode(pieces).alias("sent_no", "piece"),
        )
        .select("doc_id", "sent_no", "labels", split_words(F.col("piece")).alias("words"))
    )


def holdout_sentences(
    sentences: DataFrame,
    terms: Iterable[str] | DataFrame,
    training: bool = True,
    n_terms: int | None = None,
) -> DataFrame:
    """Sentences without any test term (``training``), or those with at least one.

    A short list of terms is compiled into the filter. ``terms`` may also be
    ``words(word)``: then the keys of the sentences that hold a term are found with a
    semi join and joined back.
    """
    if not isinstance(terms, DataFrame):
        terms = sorted(set(terms))
        if len(terms) <= LITERAL_WORDS:
            known = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
            hit = F.arrays_overlap("words", known)
            return sentences.filter(~hit if training else hit)
        n_terms = len(terms)
        terms = sentences.sparkSession.createDataFrame([(t,) for t in terms], "word string")
    keys = ["doc_id", "sent_no"]
    hits = (
        sentences.select(*keys, F.explode("words").alias("word"))
        .join(small(terms, n_terms), "word", "left_semi")
        .select(*keys)
        .distinct()
    )
    return sentences.join(hits, keys, "left_anti" if training else "left_semi")


def drop_stopwords(
    sentences: DataFrame,
    stopwords: Iterable[str] | None = None,
    is_stopword: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Remove stop words before any windowing, so that their neighbours become adjacent.

    ``is_stopword`` is a function from a word column to a boolean column, for rules that
    are not a word list.
    """
    if is_stopword is None:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))]).cast("array<string>")
        return sentences.withColumn(
            "words", F.filter("words", lambda w: ~F.array_contains(stop, w))
        )
    return sentences.withColumn("words", F.filter("words", lambda w: ~is_stopword(w)))
