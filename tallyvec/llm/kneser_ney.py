"""Quality by an interpolated modified Kneser-Ney model of bytes.

Grams of six bytes are counted over the trusted documents and summed in shards. The
probabilities of the grams that the corpus asks for are put together by joins with the
sharded counts, order by order, and go back to the chunks of documents that asked. A
document's perplexity is judged by a quantile of its language among trusted documents
that the model has not seen.

Units are the bytes of UTF-8, so that a gram of any text is one number and no alphabet has to be
chosen. Two bytes that UTF-8 never uses mark a text's start and end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.llm.ballots import CELLS, cell_table, deflate, inflate
from tallyvec.sources.stage import write_stage

ORDER, WIDTH = 6, 8  # of a gram: units, and bits of each
START, END = 0xFF, 0xFE
HELD_OUT = 3  # one in so many trusted documents sets thresholds instead of training
QUANTILE = 0.99  # of the perplexities of trusted documents, by language
CHUNK_BYTES = 16 << 20
PART_BYTES = 1 << 20  # of a chunk whose grams are listed at once
PACK_LEVEL = 3  # of zstd for documents: a tenth less to shuffle than at level 1
STEP = 1024  # an answer is a whole number of 1/STEP bits, below 64 bits


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts end to end, and how many each text has (its length and one)."""
    sizes = np.array([len(x) for x in texts], np.int64) + 1
    room = bytes([START]) * (ORDER - 1)
    units = np.frombuffer(room + (bytes([END]) + room).join(texts) + bytes([END]), np.uint8)
    n = len(units) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for i in range(ORDER):
        keys <<= np.uint64(WIDTH)
        keys |= units[i : i + n]
    # A gram that ends inside the room before a text belongs to no text.
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    inside = np.ones(n, bool)
    for i in range(ORDER - 1):
        inside[(starts[1:] - ORDER + 1 + i)] = False
    return keys[inside], sizes


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``PART_BYTES``, or one longer text."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PART_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a chunk, ascending, and how often each occurs."""
    grams, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in _parts(texts):
        new, n = np.unique(_grams(part)[0], return_counts=True)
        # What is known stays in place, so that no array of the chunk's size is sorted for a part.
        place = np.searchsorted(grams, new)
        known = np.zeros(len(new), bool)
        inside = place < len(grams)
        known[inside] = grams[place[inside]] == new[inside]
        times[place[known]] += n[known]
        place = place[~known]
        grams, times = np.insert(grams, place, new[~known]), np.insert(times, place, n[~known])
    return grams, times


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal ones among sorted ``keys`` begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    own = keys * np.uint64(0x9E3779B97F4A7C15)
    own >>= np.uint64(40)
    own %= np.uint64(shards)
    return own.astype(np.int32)


def _cells(chunk: int, keys: np.ndarray, shards: int, values: np.ndarray | None = None) -> list[tuple]:
    """Ascending distinct ``keys``, cut by shard, with a number each if given."""
    own = _shard(keys, shards)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(own))):
        part = order[a:b]
        raw = _planes(np.diff(keys[part], prepend=np.uint64(0)))
        raw += _planes(values[part].astype(np.uint64)) if values is not None else b""
        rows.append((chunk, int(own[part[0]]), deflate(raw)))
    return rows


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: most are alike."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _columns(payload: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(inflate(payload), np.uint8).reshape(width, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]


def _pack_docs(docs: DataFrame, chunks: int) -> DataFrame:
    """``(chunk, rows)``: documents compressed in bundles on their way to their chunk."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    chunk = F.pmod(key, F.lit(chunks)).cast("int").alias("chunk")
    dealt = docs.select(chunk, "doc_id", F.xxhash64("text").alias("tie"), "lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=PACK_LEVEL)
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            order = np.argsort(numbers, kind="stable")
            cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
            chunk, rows = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                part = pa.Table.from_batches([batch]).select([1, 2, 3, 4]).take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                chunk.append(int(numbers[order[a]]))
                rows.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(rows, pa.binary())], ["chunk", "rows"])

    return dealt.mapInArrow(work, "chunk int, rows binary")


def _unpack_docs(table: pa.Table) -> pa.Table:
    press = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(press.decompress(x.as_py())).read_all() for x in table["rows"]]
    return pa.concat_tables(parts).combine_chunks()


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]


def _model(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame | None], float]:
    """By order: ``(gram, f)`` discounted shares, ``(gram, g)`` the context's rest.

    Also what the first order leaves to each byte, seen or not.
    """
    counts = [grams.select("gram", "cnt")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many bytes stand before
        tail = F.col("gram").bitwiseAND(F.lit((1 << (WIDTH * order)) - 1)).alias("gram")
        counts.insert(0, write_stage(counts[0].select(tail).groupBy("gram").agg(F.count("*").alias("cnt")), f"kn-{order}"))
    shares, rests = [], []
    spare = 1.0
    for order, table in enumerate(counts, 1):
        few = [F.sum((F.col("cnt") == n).cast("long")).alias(f"n{n}") for n in (1, 2, 3, 4)]
        n1, n2, n3, n4, total, types = (x or 0 for x in table.agg(*few, F.sum("cnt"), F.count("*")).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [max(0.05, min(k - 0.05, v)) for k, v in (
            (1, 1 - 2 * y * n2 / n1 if n1 else 0.5),
            (2, 2 - 3 * y * n3 / n2 if n2 else 1.0),
            (3, 3 - 4 * y * n4 / n3 if n3 else 1.5),
        )]
        off = F.when(F.col("cnt") == 1, d[0]).when(F.col("cnt") == 2, d[1]).otherwise(d[2])
        if order == 1:
            taken = table.agg(F.sum(off)).first()[0] or 0.0
            spare = (taken / total if total else 1.0) / (types + 1)  # one more for bytes never seen
            shares.append(table.select("gram", ((F.col("cnt") - off) / total if total else F.lit(0.0)).alias("f")))
            rests.append(None)
            continue
        context = F.shiftrightunsigned("gram", WIDTH).alias("context")
        sums = table.groupBy(context).agg(F.sum("cnt").alias("all"), F.sum(off).alias("taken"))
        sums = write_stage(sums, f"kn-context-{order}")
        rests.append(sums.select(F.col("context").alias("gram"), (F.col("taken") / F.col("all")).alias("g")))
        share = (F.col("cnt") - off) / F.col("all")
        shared = table.withColumn("context", context).join(sums, "context").select("gram", share.alias("f"))
        shares.append(write_stage(shared, f"kn-share-{order}"))
    return shares, rests, spare


def _bits(asked: DataFrame, model) -> DataFrame:
    """``(shard, gram, bits)``: the surprise of distinct grams, by joins from the first order up.

    The many grams of the highest order share few tails, so a tail's probability is put together once and
    joined to the grams that end with it. Each order is written, which tells how it is best joined.
    """
    shares, rests, spare = model
    levels = [asked.select("gram")]
    for order in range(len(shares) - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (WIDTH * order)) - 1)).alias("gram")
        levels.insert(0, write_stage(levels[0].select(tail).distinct(), f"kn-tails-{order}"))
    below: DataFrame | None = None
    for order, (level, share, rest) in enumerate(zip(levels, shares, rests), 1):
        table = asked if order == len(shares) else level
        table = table.join(share, "gram", "left")
        if below is None:
            p = F.coalesce("f", F.lit(0.0)) + F.lit(spare)
        else:
            low = below.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            context = rest.select(F.col("gram").alias("context"), "g")
            mask = F.lit((1 << (WIDTH * (order - 1))) - 1)
            table = table.join(context, F.shiftrightunsigned("gram", WIDTH) == F.col("context"), "left")
            table = table.join(low, F.col("gram").bitwiseAND(mask) == F.col("tail"))
            p = F.coalesce("f", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("low")
        if order == len(shares):
            return table.select("shard", "gram", (-F.log2(p)).alias("bits"))
        below = write_stage(table.select("gram", p.alias("p")), f"kn-p-{order}")
    raise AssertionError("no order")


def perplexity(
    docs: DataFrame, trusted: DataFrame, storage: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> DataFrame:
    """``(doc_id, tie, lang, n_bytes, bits, split)`` for every document; ``tie`` is a hash of the text.

    ``bits`` is the surprise of the whole text; ``split`` is 'train' for trusted documents that
    the model is made of, 'held' for those held out, else null. ``trusted`` holds ids.
    ``storage`` is where the executors keep the packed documents and the lists of their grams between passes.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = min(max(16, total // CHUNK_BYTES + 1), (1 << 31) - 1)
    shards = max(16, chunks // 4)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt once and kept by the executors for the three passes; made again where it is lost.
    packed = _pack_docs(docs, chunks).repartition(parts, "chunk").persist(storage)
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0
    ids = write_stage(ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", held.alias("held")), "kn-trusted")

    def trained(left: pa.Table, right: pa.Table) -> list[bytes]:
        own = {i for i, h in zip(right["doc_id"].to_pylist(), right["held"].to_pylist()) if not h}
        if not left.num_rows or not own:
            return []
        table = _unpack_docs(left)
        return [t for i, t in zip(table["doc_id"].to_pylist(), _texts(table)) if i in own]

    both = packed.groupBy("chunk").cogroup(ids.groupBy("chunk"))

    def count(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        texts = trained(left, right)
        if not texts:
            return cell_table([])
        grams, times = _distinct(texts)
        return cell_table(_cells(key[0].as_py(), grams, shards, times))

    def add(table: pa.Table) -> pa.Table:
        columns = [_columns(x.as_py(), 2) for x in table["payload"]]
        keys = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
        counts = np.concatenate([c[1] for c in columns]).view(np.int64)
        del columns
        order = np.argsort(keys)
        keys = keys[order]
        first = _starts(keys)
        return pa.table({"gram": keys[first].view(np.int64), "cnt": np.add.reduceat(counts[order], first)})

    counted = both.applyInArrow(count, CELLS)
    grams = write_stage(counted.groupBy("bucket").applyInArrow(add, "gram long, cnt long"), "kn-grams")
    model = _model(grams)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, _ = _distinct(_texts(_unpack_docs(table)))
        return cell_table(_cells(key[0].as_py(), grams, shards))

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_columns(x.as_py(), 1)[0], dtype=np.uint64) for x in table["payload"]])
        keys.sort()
        distinct = keys[_starts(keys)].view(np.int64)
        return pa.table({"shard": pa.array(np.full(len(distinct), table["bucket"][0].as_py()), pa.int32()), "gram": distinct})

    def reply(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        keys, bits = right["gram"].to_numpy().view(np.uint64), right["bits"].to_numpy()
        order = np.argsort(keys)
        keys, bits = keys[order], bits[order]
        rows = []
        for chunk, payload in zip(left["chunk"].to_pylist(), left["payload"]):
            wanted = np.cumsum(_columns(payload.as_py(), 1)[0], dtype=np.uint64)
            codes = np.minimum(np.rint(bits[np.searchsorted(keys, wanted)] * STEP), 65535).astype(np.uint16)
            rows.append((chunk, key[0].as_py(), deflate(codes.tobytes())))
        return cell_table(rows)

    # Dealt once by bucket, for the merge and for the replies.
    asked = packed.groupBy("chunk").applyInArrow(ask, CELLS).repartition(parts, "bucket").persist(storage)
    distinct = write_stage(asked.groupBy("bucket").applyInArrow(merge, "shard int, gram long"), "kn-distinct")
    known = write_stage(_bits(distinct, model), "kn-bits")
    replies = asked.groupBy("bucket").cogroup(known.groupBy("shard")).applyInArrow(reply, CELLS)

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        table = _unpack_docs(left)
        texts = _texts(table)
        grams, _ = _distinct(texts)
        own = _shard(grams, shards)
        bits = np.empty(len(grams))
        for shard, payload in zip(right["bucket"].to_pylist(), right["payload"]):
            bits[own == shard] = np.frombuffer(inflate(payload.as_py()), np.uint16) / STEP
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in _parts(texts):
            keys, counts = _grams(part)
            sums.append(np.add.reduceat(bits[np.searchsorted(grams, keys)], np.cumsum(counts) - counts))
            sizes.append(counts)
        sums, sizes = np.concatenate(sums), np.concatenate(sizes)
        return pa.table(
            {
                "doc_id": table["doc_id"].cast(pa.int64()), "tie": table["tie"], "lang": table["lang"],
                "n_bytes": pa.array(sizes - 1), "bits": pa.array(np.round(sums, 3)),
            }
        )

    schema = "doc_id long, tie long, lang string, n_bytes long, bits double"
    scored = packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, schema)
    split = F.when(F.col("held"), "held").when(~F.col("held"), "train")
    scored = write_stage(scored, "kn-scores")
    packed.unpersist()
    asked.unpersist()
    return scored.join(ids.select("doc_id", "held"), "doc_id", "left").select(*scored.columns, split.alias("split"))


def classify(
    docs: DataFrame, trusted: DataFrame, storage: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> DataFrame:
    """``(doc_id, tie, lang, n_bytes, perplexity, threshold, kept, split)`` for every document.

    ``perplexity`` is per byte, in bits, the end of the text included. The threshold is a
    quantile of the held-out trusted documents of the language, or of all languages for a
    language without any (null is one); without any at all, everything is kept. Kept without a
    judgement are texts without bytes and the documents trained on: these are trusted by
    their labels, and how a model fits its own texts does not compare with the held-out ones.
    Null texts are empty; repeated rows are scored alike, null ids never trusted; needs
    ``doc_id, lang, text``; no rows give none. ``storage`` is that of ``perplexity``.
    """
    scored = write_stage(perplexity(docs, trusted, storage), "kn-split")
    rated = scored.withColumn("perplexity", F.col("bits") / (F.col("n_bytes") + 1))
    held = rated.where("split = 'held' and n_bytes > 0")
    quantile = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10000))
    marks = write_stage(held.groupBy(F.col("lang").alias("l")).agg(quantile.alias("own")), "kn-marks")
    whole = held.agg(quantile.alias("whole")).first()["whole"]
    judged = rated.join(marks, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    judged = judged.withColumn("threshold", F.coalesce("own", F.lit(whole).cast("double")))
    unjudged = (F.col("n_bytes") == 0) | F.col("split").eqNullSafe(F.lit("train"))
    kept = unjudged | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "tie", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"), "split")
