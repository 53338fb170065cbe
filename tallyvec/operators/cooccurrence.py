"""Windowed word-context counts.

Counts are kept as integers, ``units``: a pair at distance d adds ``window - d + 1`` with
dynamic weights and 1 without. One division at the end gives the weight, so the result
does not depend on the order of the additions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.functions.sums import PACKED_SCHEMA, code_words, coded_pairs, near_pairs, pair_sums
from tallyvec.operators.vocabulary import index_sentences
from tallyvec.sources.stage import small, write_stage

# Words and indices that are broadcast to be looked up in the scan, and what a word takes beside its letters.
HEAD_BYTES, WORD_BYTES = 128 << 20, 32

# Near pairs of tokens for two groups of words.
DEALT = 1 << 22


def _shifted(window: int, both_sides: bool) -> dict[int, Column]:
    """For each distance, the word array moved by it; negative distances look left."""
    words, nothing = F.col("words"), F.lit(None).cast("string")
    columns = {d: F.slice(words, d + 1, F.size(words)) for d in range(1, window + 1)}
    if both_sides:
        for d in range(1, window + 1):
            columns[-d] = F.concat(F.array_repeat(nothing, d), words)
    return columns


def _tokens(sentences: DataFrame, window: int, both_sides: bool, keep: list[str]) -> DataFrame:
    """One row per token with its neighbours at each distance in columns of their own.

    The neighbours are laid out by whole-array shifts, so the cost is linear in the length
    of a sentence however long it is.
    """
    shifted = _shifted(window, both_sides)
    zipped = F.arrays_zip(
        F.col("words").alias("word"),
        *[c.alias(f"near_{i}") for i, c in enumerate(shifted.values())],
    )
    return sentences.select(*keep, F.inline(zipped)).filter("word is not null")


def _neighbours(window: int, both_sides: bool, dynamic_weight: bool) -> Column:
    """``array<struct<context, units>>`` over the neighbour columns of ``_tokens``."""
    distances = _shifted(window, both_sides)
    return F.array(
        *[
            F.struct(
                F.col(f"near_{i}").alias("context"),
                F.lit(window - abs(d) + 1 if dynamic_weight else 1).cast("long").alias("units"),
            )
            for i, d in enumerate(distances)
        ]
    )


def _surviving_units(counts: DataFrame, keys: list[str], min_units: int, last: int) -> DataFrame:
    """Apply the block pruning to ``counts(keys, block, units)``.

    At the end of every block but the last, a pair whose running count is too low is
    dropped and starts again from zero. Once a block ends with enough, the pair stays for
    good. So the pair keeps what it counted from the first block on that is large enough
    by itself, or is the last.
    """
    pair = Window.partitionBy(*keys)
    start = F.min(
        F.when((F.col("units") >= min_units) | (F.col("block") == last), F.col("block"))
    ).over(pair)
    return (
        counts.withColumn("start", start)
        .filter(F.col("block") >= F.col("start"))
        .groupBy(*keys)
        .agg(F.sum("units").alias("units"))
    )


def head_and_tail(vocab: DataFrame, head_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """``(word, idx)`` of the most frequent words, to be broadcast, and of the others, if there are any.

    The head has ``head_bytes`` at most, or one word. A word behind it has a rank, and so a share of the
    tokens, of less than one in as many words as the head holds.
    """
    ids = vocab.select("word", "idx")
    size, count = ids.agg(F.sum(F.octet_length("word") + WORD_BYTES), F.count("*")).first()
    if not count or size <= head_bytes:
        return ids, None
    head = max(1, count * head_bytes // size)
    # Indices rise as counts fall; longer words than the average only come with less of them.
    largest = ids.where(F.col("idx") < head).agg(F.sum(F.octet_length("word") + WORD_BYTES)).first()[0]
    head = max(1, head * head_bytes // max(largest, head_bytes))
    return ids.where(F.col("idx") < head), ids.where(F.col("idx") >= head)


def look_up(df: DataFrame, word: str, out: str, head: DataFrame, tail: DataFrame) -> DataFrame:
    """Replace the words of a column by their indices; rows of unknown words are dropped."""
    frequent = F.broadcast(head.toDF(word, out))
    rare = df.join(frequent.drop(out), word, "left_anti").join(tail.toDF(word, out), word)
    return df.join(frequent, word).unionByName(rare).drop(word)


def _groups(sentences: DataFrame, vocab: DataFrame, window: int) -> int:
    """Groups of words, of which each two have a bounded number of pairs, by the tokens that the vocabulary has counted."""
    if "cnt" in vocab.columns:
        tokens = vocab.agg(F.sum("cnt")).first()[0]
    else:
        tokens = sentences.agg(F.sum(F.greatest(F.size("words"), F.lit(0)))).first()[0]
    least = math.sqrt(max((tokens or 0) * window / DEALT, 1))
    # Enough to keep all cores busy, unless there is little to do.
    return max(math.ceil(least), min(round(8 * least), math.ceil(math.sqrt(4 * sentences.sparkSession.sparkContext.defaultParallelism))))


def _scanned_pairs(
    sentences: DataFrame, ids: DataFrame, window: int, dynamic_weight: bool, keep: list[str], groups: int
) -> DataFrame:
    """Packed sums by ``(a, b, keep)``, the words being looked up by broadcast in the scan stage, each token once."""
    # Numbered in a step of its own: within that of the explosion the number would be that of the token.
    numbered = sentences.withColumn("sent", F.monotonically_increasing_id())
    placed = numbered.select(*keep, "sent", F.posexplode("words").alias("pos", "word")).filter("word is not null")
    # The broadcast look-up leaves the tokens in the order of the scan.
    tokens = placed.join(F.broadcast(ids), "word").select(*keep, "sent", "pos", "idx")
    return tokens.mapInArrow(near_pairs(window, dynamic_weight, keep, groups), PACKED_SCHEMA)


def _chunked_pairs(
    sentences: DataFrame, head: DataFrame, tail: DataFrame, window: int, dynamic_weight: bool, keep: list[str], groups: int
) -> DataFrame:
    """Packed sums by ``(a, b, keep)``, the rare words being looked up by a join.

    A chunk of sentences lists each of its words once. The words move to their index and come back to
    their chunk as numbers; the sentences move once, as codes of words.
    """
    coded = f"chunk long, {''.join(f'{k} int, ' for k in keep)}codes array<int>, code int, word string"
    chunks = write_stage(sentences.select(*keep, "words").mapInArrow(code_words(keep), coded), "chunks")
    words = chunks.filter("word is not null").select(F.col("chunk").alias("of"), "code", "word")
    ids = look_up(words, "word", "idx", head, tail).groupBy("of")
    texts = chunks.filter("codes is not null").select("chunk", *keep, "codes").groupBy("chunk")
    return texts.cogroup(ids).applyInArrow(coded_pairs(window, dynamic_weight, keep, groups), PACKED_SCHEMA)


def _count(
    pairs: DataFrame, keys: list[str], blocks: int | None, min_units: int
) -> DataFrame:
    if blocks is None:
        return pairs.groupBy(*keys).agg(F.sum("units").alias("units"))
    counts = pairs.groupBy(*keys, "block").agg(F.sum("units").alias("units"))
    return _surviving_units(counts, keys, min_units, blocks)


def _with_blocks(
    sentences: DataFrame, min_count: int, prune_point: int
) -> tuple[DataFrame, int | None]:
    """Add ``block``, if any pruning happens at all, and return the number of the last one."""
    if min_count <= 1:
        return sentences, None
    indexed, total = index_sentences(sentences)
    last = (total - 1) // prune_point
    if last < 1:
        return sentences, None
    block = F.floor(F.col("i_sent") / prune_point).cast("int")
    return indexed.withColumn("block", block).drop("i_sent"), last


def count_pairs_once(
    sentences: DataFrame,
    vocab: DataFrame,
    n_vocab: int | None,
    window: int = 3,
    dynamic_weight: bool = True,
    min_count: int = 1,
    prune_point: int = 500_000,
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """``(a, b, units)`` over the indices of the vocabulary, ``a <= b``.

    Words are looked up and then paired as numbers, and a task adds up a bounded number of pairs at a time, so its memory
    does not grow with its input. The sums are dealt out once, packed, by the groups of both words, and two groups are added
    up at a time: there are as many as keep these bounded. Frequent words are looked up by broadcast in the scan stage; if that is the whole vocabulary, the only
    shuffle is that of the sums. Of a larger one the rare words are looked up by a join, once per chunk of sentences.
    """
    sentences, last = _with_blocks(sentences, min_count, prune_point)
    keep = [] if last is None else ["block"]
    min_units = min_count * (window if dynamic_weight else 1)
    head, tail = head_and_tail(vocab, head_bytes)
    kind = vocab.schema["idx"].dataType.simpleString()
    groups = _groups(sentences, vocab, window)
    options = (window, dynamic_weight, keep, groups)
    packed = _scanned_pairs(sentences, head, *options) if tail is None else _chunked_pairs(sentences, head, tail, *options)
    summed = pair_sums("int32" if kind == "int" else "int64", groups, min_units, last)
    # All sums of two groups of words come together, and are added up by themselves.
    cells = packed.repartition("a", "b").groupBy("a", "b").agg(F.collect_list("sums").alias("sums"))
    return cells.mapInPandas(summed, f"a {kind}, b {kind}, units long")


def mirrored(counts: DataFrame) -> DataFrame:
    """``(row, col, units)``, both ways, of ``(a, b, units)``."""
    one_way = F.struct(F.col("a").alias("row"), F.col("b").alias("col"))
    both_ways = F.array(one_way, F.struct(F.col("b").alias("row"), F.col("a").alias("col")))
    return counts.select(
        F.inline(F.when(F.col("a") == F.col("b"), F.array(one_way)).otherwise(both_ways)), "units"
    )


def count_pairs(sentences: DataFrame, vocab: DataFrame, *args, **options) -> DataFrame:
    """``(row, col, units)`` over the indices of the vocabulary; for the arguments see ``count_pairs_once``.

    Each unordered pair is counted once, under its smaller index first, and mirrored after
    the aggregation: half the rows to combine and to shuffle.
    """
    return mirrored(count_pairs_once(sentences, vocab, *args, **options))


def count_row_pairs(
    sentences: DataFrame,
    row_words: DataFrame,
    n_rows: int | None,
    vocab: DataFrame,
    n_vocab: int | None,
    window: int = 3,
    dynamic_weight: bool = True,
    min_count: int = 1,
    prune_point: int = 500_000,
) -> DataFrame:
    """``(word, col, units)`` for the chosen row words only; they may be unknown to ``vocab``.

    Row words are matched before the neighbours are expanded, so the other tokens cost one
    look-up each.
    """
    sentences, last = _with_blocks(sentences, min_count, prune_point)
    keep = [] if last is None else ["block"]
    min_units = min_count * (window if dynamic_weight else 1)
    rows = small(row_words.select("word").distinct(), n_rows)
    contexts = small(vocab.select(F.col("word").alias("context"), F.col("idx").alias("col")), n_vocab)
    tokens = _tokens(sentences, window, True, keep).join(rows, "word", "left_semi")
    pairs = (
        tokens.select(*keep, "word", F.inline(_neighbours(window, True, dynamic_weight)))
        .filter("context is not null")
        .join(contexts, "context")
        .drop("context")
    )
    return _count(pairs, ["word", "col"], last, min_units)


def weights(units: Column, window: int, dynamic_weight: bool) -> Column:
    """The weight of a count of integer units."""
    return units / F.lit(float(window)) if dynamic_weight else units.cast("double")


def word_context(
    sentences: DataFrame,
    vocab: DataFrame,
    window: int = 3,
    dynamic_weight: bool = True,
    min_count: int = 1,
    prune_point: int = 500_000,
    row_words: DataFrame | None = None,
    n_vocab: int | None = None,
    n_rows: int | None = None,
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """``ww(word, context, cnt)``: in-vocabulary contexts within ``window`` on both sides.

    Words outside the vocabulary keep their place in the sentence. ``row_words(word)``
    limits the rows; without it they are the vocabulary. An empty ``row_words`` gives no
    rows. For ``min_count`` see the block pruning in ``_surviving_units``.
    """
    options = (window, dynamic_weight, min_count, prune_point)
    words = small(vocab.select(F.col("idx").alias("col"), F.col("word").alias("context")), n_vocab)
    if row_words is None:
        counts = count_pairs(sentences, vocab, n_vocab, *options, head_bytes)
        rows = small(vocab.select(F.col("idx").alias("row"), "word"), n_vocab)
        counts = counts.join(rows, "row")
    else:
        counts = count_row_pairs(sentences, row_words, n_rows, vocab, n_vocab, *options)
    return counts.join(words, "col").select(
        "word", "context", weights(F.col("units"), window, dynamic_weight).alias("cnt")
    )
