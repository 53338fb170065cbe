"""Ask, in one shuffle, which fingerprints occur elsewhere.

Documents are dealt into chunks. A chunk lists the distinct fingerprints it holds, cut
into buckets by their leading bits: one row per chunk and bucket, the fingerprints sorted
and stored as differences, a few bytes each. A bucket merges the lists and replies to each
chunk with one bit per listed fingerprint: does it occur again, here or elsewhere? Since a
chunk lists a fingerprint once however often it holds it, a text that fills a third of the
corpus adds one entry per chunk. Positions are never sent; the chunk knows them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "chunk int, bucket int, payload binary"
CELL_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])

# Two low bits of a listed value: it is met more than once in the chunk; it is a reference.
MULTI, REFERENCE = 2, 1


def deflate(raw: bytes) -> bytes:
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 64 else b"\0" + raw


def inflate(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload[1:]) if payload[0] else payload[1:]


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=values[:1] * 0)
    wide = steps[1:].size and int(steps[1:].max()) >> 32
    body = steps[1:].astype(np.uint64 if wide else np.uint32)
    head = np.array([int(values[0])], np.uint64).tobytes()
    planes = np.ascontiguousarray(body.view(np.uint8).reshape(len(body), body.itemsize).T).tobytes()
    return deflate((b"\1" if wide else b"\0") + head + planes)


def unpack(payload: bytes) -> np.ndarray:
    raw = inflate(payload)
    kind = np.dtype(np.uint64 if raw[0] else np.uint32)
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(kind.itemsize, -1)
    steps = np.ascontiguousarray(planes.T).view(kind).reshape(-1).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), steps]), dtype=np.uint64)


def pack_mask(mask: np.ndarray) -> bytes:
    return deflate(np.packbits(mask).tobytes())


def unpack_mask(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(inflate(payload), np.uint8), count=n).astype(bool)


def name_bits(total: int) -> int:
    """Bits with which, among ``total`` fingerprints, one in 2**20 meets a stranger at most."""
    return min(62, max(32, total.bit_length() + 20))


def bucket_bits(total: int, bucket_entries: int = 1 << 20) -> int:
    """Leading bits that cut ``total`` entries into buckets of about ``bucket_entries``."""
    return max(4, min(30, (max(1, total // bucket_entries)).bit_length()))


class Ballot:
    """The distinct names of a chunk, in the order in which they are listed and answered."""

    def __init__(self, names: np.ndarray, bits: int, references: np.ndarray | None = None):
        short = names >> np.uint64(64 - bits)
        order = np.argsort(short, kind="stable")
        ranked = short[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(new)
        self.slot = np.empty(len(names), np.int64)  # of each name: its place among the distinct ones
        self.slot[order] = np.cumsum(new) - 1
        self.distinct, self.bits = ranked[first], bits
        many = np.diff(np.append(first, len(ranked))) > 1
        if references is None:
            known = np.ones(len(first), bool)
        elif len(first):
            known = np.logical_or.reduceat(references[order], first)
        else:
            known = np.zeros(0, bool)
        self.values = (self.distinct << np.uint64(2)) | (many * MULTI + known * REFERENCE).astype(np.uint64)

    def cells(self, chunk: int, buckets: int) -> list[tuple[int, int, bytes]]:
        own = (self.distinct >> np.uint64(self.bits - buckets)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ends = np.append(cuts[1:], len(own))
        return [(chunk, int(own[a]), pack(self.values[a:b])) for a, b in zip(cuts, ends)]

    def answers(self, replies: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
        """The reply bits, for each name given at first; ``replies``: (bucket, payload)."""
        own = (self.distinct >> np.uint64(self.bits - buckets)).astype(np.int64)
        yes = np.zeros((len(own), 2), bool)
        for bucket, payload in replies:
            a, b = np.searchsorted(own, [bucket, bucket + 1])
            yes[a:b] = unpack_mask(payload, 2 * (b - a)).reshape(-1, 2)
        return yes[self.slot]


def cell_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, CELL_SCHEMA.types)], schema=CELL_SCHEMA)


def memo(chunk: int, payload: bytes) -> tuple[int, int, bytes]:
    """A row that comes back to its chunk with the replies, unchanged."""
    return chunk, -1 - chunk, payload


def count_votes(asked: DataFrame) -> DataFrame:
    """Replies to the cells: two bits for each listed value.

    The first says that the value occurs at least twice and at least once as a reference;
    the second that this chunk is the lowest of those that list it.
    """

    def reply(table: pa.Table) -> pa.Table:
        chunks, buckets = table["chunk"].to_numpy(), table["bucket"].to_numpy()
        payloads = [x.as_py() for x in table["payload"]]
        if buckets[0] < 0:
            return cell_table(list(zip(chunks.tolist(), buckets.tolist(), payloads)))
        turn = np.argsort(chunks, kind="stable")
        lists = [unpack(payloads[i]) for i in turn]
        sizes = [len(x) for x in lists]
        values = np.concatenate(lists)
        order = np.argsort(values >> np.uint64(2), kind="stable")
        ranked = values[order]
        names = ranked >> np.uint64(2)
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(names))) > 1
        many |= np.logical_or.reduceat((ranked & np.uint64(MULTI)) > 0, first)
        many &= np.logical_or.reduceat((ranked & np.uint64(REFERENCE)) > 0, first)
        out = np.empty((len(values), 2), bool)
        out[order, 0] = many[np.cumsum(new) - 1]
        out[order, 1] = new
        parts = np.split(out, np.cumsum(sizes)[:-1])
        return cell_table(
            [(int(chunks[i]), int(buckets[0]), pack_mask(x.reshape(-1))) for i, x in zip(turn, parts)]
        )

    return asked.groupBy("bucket").applyInArrow(reply, CELLS)


def into_chunks(docs: DataFrame, chunk_bytes: int, least: int = 64) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, text), the number of bytes and of chunks; null texts become empty.

    Rows are dealt by a hash of id and text: copies spread over the chunks, whatever their
    ids, and a row that is computed again goes to the same chunk.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(least, total // chunk_bytes + 1), (1 << 31) - 1)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk")
    return rows.select(chunk, "doc_id", "text"), total, n


class Chunk:
    """The documents of a chunk in a fixed order, their bytes end to end."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        keys = pa.table({"a": table["doc_id"], "b": table["text"]})
        turn = pa.compute.sort_indices(keys, [("a", "ascending"), ("b", "ascending")])
        table = table.take(turn).combine_chunks()
        text = table["text"].cast(pa.large_binary()).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
        self.doc_ids = table["doc_id"]
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        data = text.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0]
        self.lengths = np.diff(self.offsets)


def with_replies(chunks: DataFrame, replies: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(chunk number, Chunk, memo, replies)`` on every chunk that has documents."""

    def both(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        number = key[0].as_py()
        back = list(zip(right["bucket"].to_pylist(), right["payload"].to_pylist()))
        note = next((p for b, p in back if b < 0), b"")
        return work(number, Chunk(left), note, [x for x in back if x[0] >= 0])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places that lie in a window of ``width`` from one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0
