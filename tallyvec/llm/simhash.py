"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints with at most
three differing bits, one segment differs by at most one bit, so the two share a variant of
that segment in which one bit is a wildcard. Each distinct fingerprint is indexed under its
64 variants; equal keys meet in one sorted run, where the full distance is verified.

Only distinct fingerprints are indexed, so copies cost nothing, and a run passes on a
spanning forest of its links, not its pairs. A run of more than 2,048 fingerprints is cut
again by variants of the other segment's halves, and once more by their quarters; then
at most 11 bits of its members are free, so no run can exceed 2,048.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

RUN = 2048  # largest run compared in one go: 2**11, what the third cut leaves at most

_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().translate(_lower).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    cut = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(line[a:b], seed) for a, b in cut], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes, as a signed 64-bit number."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, tie, fp)``; ``tie`` is a hash of the text. Wordless and null texts have ``fp`` zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width, seed)) for t in batch.column(2)]
            arrays = [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tie", "fp"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInArrow(work, "doc_id long, tie long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(root, node)`` that connect what the links ``(a, b)`` connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _link_run(fps: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs that begin at ``first``; ``fps`` as unsigned numbers."""
    end = np.repeat(np.append(first[1:], len(fps)), np.diff(np.append(first, len(fps))))
    here, left, right = np.arange(len(fps)), [], []
    for step in range(1, len(fps)):
        here = here[here + step < end[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(fps[here] ^ fps[here + step]) <= most]
        left.append(fps[near])
        right.append(fps[near + step])
    none = fps[:0]
    return forest(np.concatenate([none, *left]), np.concatenate([none, *right]))


def _compare(indexed: DataFrame, most: int, last: bool) -> DataFrame:
    """Runs of equal ``(key, sub)`` to links; members of runs too long come back as they are."""
    schema = "hot boolean, key long, sub long, a long, b long"

    def rows(hot: bool, key, sub, a, b) -> pa.RecordBatch:
        n = len(a)
        arrays = [pa.array(np.full(n, hot)), *(pa.array(np.asarray(x, np.int64)) for x in (key, sub))]
        arrays += [pa.array(x.view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, ["hot", "key", "sub", "a", "b"])

    def settle(key, sub, fps) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        long = np.repeat((size > RUN) & (not last), size)
        if long.any():
            yield rows(True, key[long], sub[long], fps[long], fps[long])
        some = np.repeat(size > 1, size) & ~long
        if not some.any():
            return
        a, b = _link_run(fps[some], np.flatnonzero(new[some]), most)
        if len(a):
            yield rows(False, np.zeros(len(a)), np.zeros(len(a)), a, b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            key, sub, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            if held and (held[-1][0][-1], held[-1][1][-1]) == (key[-1], sub[-1]):
                held.append((key, sub, fp))
                continue
            cut = int(np.flatnonzero((key != key[-1]) | (sub != sub[-1]))[-1]) + 1 if (
                key[0], sub[0]) != (key[-1], sub[-1]) else 0
            held.append((key[:cut], sub[:cut], fp[:cut]))
            k, s, f = (np.concatenate(x) for x in zip(*held))
            if len(k):
                yield from settle(k, s, f.view(np.uint64))
            held = [(key[cut:], sub[cut:], fp[cut:])]
        if held:
            k, s, f = (np.concatenate(x) for x in zip(*held))
            yield from settle(k, s, f.view(np.uint64))

    dealt = indexed.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(work, schema)


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints ``fp`` that connect all near pairs."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    wild = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")
    key = F.expr(
        "shiftleft(cast(k as bigint), 32) | (if(k < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)"
        " & ~shiftleft(1L, k % 32))"
    )
    indexed = distinct.select("fp", wild).select(key.alias("key"), F.lit(0).cast("long").alias("sub"), "fp")
    found = write_stage(_compare(indexed, most, False), "simhash-links")
    parts = [found.where("not hot").select("a", "b")]
    # What remains to be cut: the half that the key does not hold, then its quarter.
    cuts = [
        (31, "if(shiftright(key, 32) < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))", 16, 0),
        (15, "if(shiftright(sub, 16) < 16, half & 65535L, shiftright(half, 16))", 8, 12),
    ]
    for level, (top, rest, width, room) in enumerate(cuts):
        hot = found.where("hot").select("key", "sub", F.col("a").alias("fp"))
        if not hot.take(1):
            break
        half = cuts[0][1]
        hot = hot.withColumn("half", F.expr(half)).withColumn("rest", F.expr(rest))
        sub = (
            f"shiftleft(sub, {room}) | shiftleft(cast(k as bigint), {width}) | (if(k < {width},"
            f" shiftright(rest, {width}), rest & {(1 << width) - 1}L) & ~shiftleft(1L, k % {width}))"
        )
        wild = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k")
        again = hot.select("*", wild).select("key", F.expr(sub).alias("sub"), "fp")
        found = write_stage(_compare(again, most, level == 1), f"simhash-links-{level + 2}")
        parts.append(found.where("not hot").select("a", "b"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of ``edges(a, b)``, the root being the smallest node.

    Alternating large and small stars: each pass hangs the neighbours of a node on the
    smallest of them. Passes are written tables; the driver sees a count and a checksum.
    """
    now, mark = write_stage(edges.where("a <> b"), "stars"), None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = hung.union(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        now = write_stage(small, "stars")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, tie, fp, component_id)``: documents with the smallest id they are linked to.

    Fingerprints link at ``most`` or fewer differing bits, directly or through others.
    Takes ``doc_id`` and ``text``, ignores other columns; null and wordless texts have
    fingerprint zero, which links like any other; repeated rows come back repeated; null ids
    are passed over in ``component_id`` unless a component has no other; no rows give none.
    """
    own = write_stage(fingerprints(docs, width, seed), "simhash")
    nodes = write_stage(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    tree = components(links(nodes.select("fp"), most))
    placed = nodes.join(tree, nodes.fp == tree.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    placed = write_stage(placed, "simhash-placed")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(lows, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "tie", "fp", "component_id")
