"""Word vectors by counting: training, inference of unseen words, look-up and search."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.operators.cooccurrence import count_pairs_once, count_row_pairs, mirrored, weights
from tallyvec.operators.factor import fill_rows, representation, sparse_dot, truncated_svd
from tallyvec.operators.pmi import count_marginals, train_pmi
from tallyvec.operators.ranking import dense_index
from tallyvec.operators.search import most_similar, similar_to_vector
from tallyvec.operators.vocabulary import index_vocabulary
from tallyvec.sources.stage import small, write_stage


@dataclass(frozen=True)
class EmbeddingParams:
    """Parameters of training and inference.

    ``negative`` sets the threshold ``log(negative)`` on the PMI; ``beta`` smooths the
    context probabilities and ``alpha`` is added to them. ``min_cooccurrence`` is applied at
    every ``prune_point``-th sentence only, or to the final counts if ``exact_pruning``.
    ``scale`` is the power of the singular values in the transformer.
    """

    size: int = 100
    window: int = 3
    min_count: int = 10
    negative: int = 10
    alpha: float = 0.0
    beta: float = 0.75
    dynamic_weight: bool = False
    n_iter: int = 5
    min_cooccurrence: int = 5
    prune_point: int = 500_000
    exact_pruning: bool = False
    scale: float = 0.5
    seed: int = 0

    def __post_init__(self):
        if not 0 < self.beta:
            raise ValueError("beta must be positive")

    @property
    def min_pmi(self) -> float:
        return math.log(max(1, self.negative))


@dataclass
class WordVectors:
    """A trained model.

    ``vocab(idx, word, cnt)`` are the contexts and stay fixed. ``wv(idx, word, vec)`` also
    holds appended words. ``py(col, p)`` and ``transformer(col, vec)`` infer new rows.
    """

    params: EmbeddingParams
    vocab: DataFrame
    n_vocab: int
    py: DataFrame
    transformer: DataFrame
    wv: DataFrame
    n_words: int
    sigma: list[float] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {"vocab": self.vocab, "py": self.py, "transformer": self.transformer, "wv": self.wv}

    def get_vector(self, word: str) -> DataFrame:
        """``(idx, word, vec)`` of a word; no row if it is unknown."""
        return self.wv.filter(F.col("word") == word)

    __getitem__ = get_vector

    def similar_words(self, word: str, topk: int = 10) -> DataFrame:
        """``(rank, word, sim)`` without the word itself; empty for unknown words."""
        return most_similar(word, self.wv, self.params.size, topk, everything=False)

    def similar_words_from_vector(
        self, vector: list[float], topk: int = 10, query_idx: int = -1
    ) -> DataFrame:
        """``(rank, word, sim)`` for a vector of the model's size."""
        if len(vector) != self.params.size:
            raise ValueError(f"the vector must have {self.params.size} dimensions")
        return similar_to_vector(vector, self.wv, topk, query_idx)

    def infer_words(
        self, sentences: DataFrame, words: Iterable[str] | DataFrame, append: bool = True
    ) -> tuple[DataFrame, WordVectors]:
        """Infer vectors ``(row, word, vec)`` from new text; also return the extended model.

        Words that never occur get a zero vector. Known words keep their vector in the
        model.
        """
        index, n_rows = word_rows(self.wv.sparkSession, words)
        counts = row_counts(sentences, index, n_rows, self.vocab, self.n_vocab, self.params)
        inferred = infer_rows(
            counts, n_rows, self.py, self.transformer, self.n_vocab, self.params.size
        )
        named = write_stage(
            inferred.join(small(index, n_rows), "row").select("row", "word", "vec"), "inferred"
        )
        return named, self.append(named) if append else self

    def append(self, rows: DataFrame) -> WordVectors:
        """Add the unknown words of ``rows(row, word, vec)`` after the known ones."""
        wv, added = append_words(self.wv, self.n_words, rows)
        return replace(self, wv=wv, n_words=self.n_words + added)


def word_rows(
    spark: SparkSession, words: Iterable[str] | DataFrame
) -> tuple[DataFrame, int]:
    """``index(row, word)`` of a word set in code point order, and its size."""
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in words], "word string")
    return dense_index(words.select("word").distinct(), [F.col("word")], "row", "rows")


def row_counts(
    sentences: DataFrame,
    index: DataFrame,
    n_rows: int,
    vocab: DataFrame,
    n_vocab: int,
    params: EmbeddingParams,
) -> DataFrame:
    """``m(row, col, v)``: contexts of chosen words against the trained vocabulary."""
    counts = count_row_pairs(
        sentences, index, n_rows, vocab, n_vocab, params.window, params.dynamic_weight
    )
    weight = weights(F.col("units"), params.window, params.dynamic_weight)
    return counts.join(small(index, n_rows), "word").select("row", "col", weight.alias("v"))


def infer_rows(
    matrix: DataFrame,
    n_rows: int,
    py: DataFrame,
    transformer: DataFrame,
    n_contexts: int,
    size: int,
) -> DataFrame:
    """``(row, vec)`` of new rows in the space of a model; rows without entries are zero."""
    pmi, _ = train_pmi(matrix, py, n_rows=n_rows, n_cols=n_contexts)
    vectors = sparse_dot(pmi, transformer, size, n_contexts, value="pmi", n_rows=n_rows)
    return fill_rows(vectors, n_rows, size)


def append_words(wv: DataFrame, n_words: int, rows: DataFrame) -> tuple[DataFrame, int]:
    """Extend ``wv(idx, word, vec)`` by the unknown words of ``rows(row, word, vec)``."""
    unknown = rows.join(wv.select("word"), "word", "left_anti").select("row", "word", "vec")
    ordered, added = dense_index(unknown, [F.col("row")], name="append")
    extra = ordered.select((F.col("idx") + n_words).alias("idx"), "word", "vec")
    return wv.select("idx", "word", "vec").unionByName(extra), added


def pair_matrix(
    sentences: DataFrame, vocab: DataFrame, n_vocab: int, params: EmbeddingParams
) -> DataFrame:
    """``m(row, col, v)`` of the vocabulary against itself, each pair written once."""
    counts = count_pairs_once(
        sentences,
        vocab,
        n_vocab,
        params.window,
        params.dynamic_weight,
        1 if params.exact_pruning else params.min_cooccurrence,
        params.prune_point,
    )
    weight = weights(F.col("units"), params.window, params.dynamic_weight)
    if params.exact_pruning:
        counts = counts.filter(weight >= params.min_cooccurrence)
    return mirrored(write_stage(counts, "pairs")).select("row", "col", weight.alias("v"))


def factor_rows(
    pmi: DataFrame, n_rows: int, n_cols: int, params: EmbeddingParams
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Row vectors ``(row, vec)``, the transformer ``(col, vec)`` and the singular values."""
    u, sigma, v = truncated_svd(
        pmi, params.size, n_rows, n_cols, params.n_iter, params.seed, value="pmi"
    )
    vectors, transformer = representation(u, sigma, v, params.scale)
    vectors = write_stage(fill_rows(vectors, n_rows, params.size), "vectors")
    transformer = write_stage(fill_rows(transformer, n_cols, params.size), "transformer")
    return vectors, transformer, sigma


def name_vectors(vectors: DataFrame, vocab: DataFrame, n_vocab: int) -> DataFrame:
    """``wv(idx, word, vec)`` from ``(row, vec)``."""
    named = vectors.withColumnRenamed("row", "idx").join(
        small(vocab.select("idx", "word"), n_vocab), "idx"
    )
    return named.select("idx", "word", "vec")


def train_word_vectors(
    sentences: DataFrame, params: EmbeddingParams = EmbeddingParams()
) -> WordVectors:
    """Train on ``sentences(doc_id, sent_no, words)``: two passes over the text."""
    vocab, n_vocab = index_vocabulary(sentences, params.min_count)
    ww = pair_matrix(sentences, vocab, n_vocab, params)
    pmi, py = train_pmi(
        ww, count_marginals(vocab), params.min_pmi, params.alpha, params.beta, n_vocab, n_vocab
    )
    py = write_stage(py, "contexts")
    vectors, transformer, sigma = factor_rows(pmi, n_vocab, n_vocab, params)
    wv = name_vectors(vectors, vocab, n_vocab)
    return WordVectors(params, vocab, n_vocab, py, transformer, wv, n_vocab, sigma)
