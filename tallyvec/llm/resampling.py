"""Importance resampling towards a target distribution of hashed word features.

Features are the words and word pairs of a text, hashed into buckets. Texts are cut into lines at
their line ends, which no word crosses. Distinct lines are found by one aggregation; the
features of each are hashed once and counted as often as the line occurs. What lines
cannot see, the pairs across a line end, is added from the documents.
A document's weight is put together the same way from the gains of its distinct lines.
Documents are then drawn by weight plus Gumbel noise, which is sampling without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvec.operators.ranking import dense_index
from tallyvec.sources.stage import write_stage

BUCKETS = 10_000
HOT = 1000  # a line with over one in so many of all occurrences is hot: there are fewer than this many

# Letters A-Z lowered; what is not a letter, digit or beyond ASCII separates words, and line ends stay.
_letter = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256)
)


def line_key(line: bytes) -> tuple[int, int]:
    """Two independent hashes: 128 bits name a line."""
    one, two = xxhash.xxh64_intdigest(line, 42), xxhash.xxh64_intdigest(line, 43)
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def features(words: list[bytes], buckets: int) -> list[int]:
    """Buckets of the words and of the pairs of neighbours."""
    crc = zlib.crc32
    single = [crc(w) for w in words]
    pairs = [crc(b" " + w, c) for c, w in zip(single, words[1:])]
    return [c % buckets for c in single + pairs]


def _lines(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """Distinct lines with words: ``(a, b, cnt, n_words, features)``, written."""
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    distinct = texts.select(line).groupBy("line").agg(F.count("*").alias("cnt"))
    schema = "a long, b long, cnt long, n_words long, features binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cnt in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                words = raw.translate(_letter).split()
                if words:
                    found = np.array(features(words, buckets), np.uint32)
                    rows.append((*line_key(raw), cnt, len(words), found.tobytes()))
            yield _batch(rows, schema)

    return write_stage(distinct.mapInArrow(work, schema), name)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _documents(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """Every row's distinct lines and the pairs across its line ends, written; ``row`` numbers rows."""
    schema = "row long, doc_id long, n_words long, cross binary, a array<long>, b array<long>, times array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, crc = TaskContext.get().partitionId() << 33, zlib.crc32
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                lines: Counter[bytes] = Counter()
                n_words, last, cross = 0, None, []
                for line, plain in zip(raw.split(b"\n"), raw.translate(_letter).split(b"\n")):
                    words = plain.split()
                    if not words:
                        continue
                    lines[line] += 1
                    n_words += len(words)
                    if last is not None:
                        cross.append(crc(last + b" " + words[0]) % buckets)
                    last = words[-1]
                keys = [line_key(x) for x in lines]
                cross = np.array(cross, np.uint32).tobytes()
                rows.append((row, doc_id, n_words, cross, [k[0] for k in keys], [k[1] for k in keys], list(lines.values())))
                row += 1
            yield _batch(rows, schema)

    return write_stage(texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema), name)


def _totals(lines: DataFrame, documents: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: those of lines as often as these occur, and those across line ends.

    Each task sends a number per bucket at most, and so does the sum to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column(0).to_numpy()
            lists = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(1)]
            if lists:
                often = np.repeat(times, [len(x) for x in lists])
                np.add.at(total, np.concatenate(lists), often)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    both = lines.select("cnt", "features").union(documents.select(F.lit(1).cast("long"), "cross"))
    summed = both.mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares of each bucket."""
    size, whole, aim = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (whole + size) / ((s + 1.0) * (aim + size)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _summed(worth: np.ndarray, cells: pa.Array) -> list[int]:
    lists = [np.frombuffer(x.as_py(), np.uint32) for x in cells]
    sums = np.concatenate([[0], np.cumsum(worth[np.concatenate([np.zeros(0, np.uint32), *lists])])])
    ends = np.cumsum([0, *map(len, lists)])
    return (sums[ends[1:]] - sums[ends[:-1]]).tolist()


def noise(seed: int) -> Column:
    """Floored thousandths of a Gumbel draw that follows from the seed and ``doc_id`` (null: empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``.

    ``target`` has a column ``text``. Of the rows with ``least_words`` words, ``percent`` in a
    hundred are drawn by highest score, ties to the smaller id (null last); ``rank`` numbers them, all others
    have none. Null and wordless texts have no features and weight 0; repeated rows are rows
    of their own; other columns are ignored; an empty target has only smoothing; no rows give none.
    """
    spark = docs.sparkSession
    rows = _documents(docs, buckets, "resample-rows")
    lines = _lines(docs, buckets, "resample-lines")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    aimed = _totals(_lines(aim, buckets, "resample-target"), _documents(aim, buckets, "resample-target"), buckets)
    # A number per bucket: its size is known.
    worth = spark.sparkContext.broadcast(gains(_totals(lines, rows, buckets), aimed))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = pa.array(_summed(worth.value, batch.column(batch.num_columns - 1)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], gain], [*batch.schema.names[:-1], "gain"])

    priced = lines.select("a", "b", "cnt", "features").mapInArrow(price, "a long, b long, cnt long, gain long")
    priced = write_stage(priced, "resample-gains")
    crossed = rows.select("row", "doc_id", "n_words", "cross").mapInArrow(
        price, "row long, doc_id long, n_words long, gain long"
    )
    total = priced.agg(F.sum("cnt")).first()[0] or 0
    # Lines so frequent are fewer than HOT, so they can be sent everywhere; no other key is large.
    hot = F.broadcast(priced.where(F.col("cnt") * HOT > total).select("a", "b", "gain"))
    rest = priced.where(F.col("cnt") * HOT <= total).select("a", "b", "gain")
    uses = rows.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("u")).select("row", "u.*")
    met = uses.join(hot, ["a", "b"]).unionByName(uses.join(hot, ["a", "b"], "left_anti").join(rest, ["a", "b"]))
    by_row = met.groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("inside"))
    n = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    rated = crossed.join(by_row, "row", "left").select(
        "row", "doc_id", "n_words", n.alias("n_features"), (F.col("gain") + F.coalesce("inside", F.lit(0))).alias("sum")
    )
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(sum - pmod(sum, n_features)) div n_features"))
    scored = rated.select("row", "doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))
    scored = write_stage(scored.withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words).select("row", "doc_id", "n_words", "score")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("row")]
    placed, count = dense_index(able, order, "place", "resample-order")
    drawn = placed.where(F.col("place") < percent * count // 100)
    drawn = drawn.select("row", (F.col("place") + 1).cast("long").alias("rank"))
    return scored.join(drawn, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
