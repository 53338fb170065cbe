"""Exact removal of long repeated byte strings by difference-cover suffix sorting.

1. Sample. A place is sampled if its distance from the start of its document, modulo 133,
   is in a difference cover of 12 residues. For any two places there is a shift under 133
   that leads both to sampled places. A sampled suffix is named by its first
   ``length - 132`` bytes, and the names are sorted and merged over all documents.
2. Recurse. Only sampled suffixes whose name is not unique go on. Each is named again, by
   so many bytes that equal names settle all starts up to the next sampled place.
3. Merge. The remaining suffixes that can still have a partner (one with a repeated
   sampled suffix within reach) are named by their first ``length`` bytes and merged with
   one holder of each settled stretch.
4. Compare. Sorted neighbours with equal prefixes repeat; every byte of their prefix goes.

Suffixes are sorted by the fingerprints of their prefixes rather than by their bytes:
only the equality of adjacent prefixes decides, and fingerprints cost a few bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyvec.llm.ballots import (
    CELLS, Ballot, Chunk, bucket_bits, cell_table, count_votes, covered, into_chunks, memo, name_bits,
    pack_mask, unpack_mask, with_replies,
)
from tallyvec.llm.rolling import Roller

# Every residue modulo 133 is a difference of two of these.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)

RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
_rollers: dict[int, Roller] = {}


def roller(seed: int) -> Roller:
    """One per Python worker; its tables are built once."""
    return _rollers.setdefault(seed, Roller(seed))


def _samples(chunk: Chunk, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places with ``reach`` bytes to follow, and the distance to the next one."""
    gaps = np.diff(np.array([*COVER, COVER[0] + PERIOD]))
    longest = int(chunk.lengths.max(initial=0))
    rounds = longest // PERIOD + 1
    pattern = (np.arange(rounds)[:, None] * PERIOD + np.array(COVER)).reshape(-1)
    steps = np.tile(gaps, rounds)
    fit = np.searchsorted(pattern, chunk.lengths - reach, side="right")
    at = np.repeat(chunk.offsets[:-1], fit)
    within = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)
    return at + pattern[within], steps[within]


def _ends(chunk: Chunk, places: np.ndarray) -> np.ndarray:
    """The end of the document that holds each place."""
    return chunk.offsets[np.searchsorted(chunk.offsets, places, side="right")]


def remove_repeats(docs: DataFrame, length: int = 400, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Documents without the bytes of ``length``-byte strings that start anywhere else too.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns a row per document
    with the removed spans in bytes (maximal, ascending) and the remaining bytes. Null
    texts count as empty, repeated rows as documents of their own, whatever their ids;
    texts shorter than ``length`` stay whole; no documents give no rows.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    name_width = length - PERIOD + 1
    chunks, total, _ = into_chunks(docs, chunk_bytes)
    samples = total * len(COVER) // PERIOD
    short, buckets = name_bits(samples), bucket_bits(samples)
    full = 62

    def level_0(number: int, chunk: Chunk) -> Ballot:
        places, _ = _samples(chunk, name_width)
        return Ballot(roller(1).at(chunk.buf, name_width, places), short)

    def sample(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        return cell_table(level_0(number, Chunk(table)).cells(number, buckets))

    def level_1(chunk: Chunk, repeated: np.ndarray):
        """The repeated samples that have room for the longer name, and those names."""
        places, steps = _samples(chunk, name_width)
        places, steps = places[repeated], steps[repeated]
        room = places + length + steps - 1 <= _ends(chunk, places)
        places, steps = places[room], steps[room]
        names = np.zeros(len(places), np.uint64)
        for step in np.unique(steps):  # the width belongs to the residue, so it is part of the name
            own = steps == step
            names[own] = roller(2).at(chunk.buf, length + int(step) - 1, places[own])
        return places, steps, Ballot(names, full)

    def recurse(number: int, chunk: Chunk, note: bytes, replies) -> pa.Table:
        repeated = level_0(number, chunk).answers(replies, buckets)[:, 0]
        _, _, ballot = level_1(chunk, repeated)
        return cell_table([memo(number, pack_mask(repeated)), *ballot.cells(number, buckets)])

    def merge(number: int, chunk: Chunk, note: bytes, replies) -> pa.Table:
        n = len(chunk.buf)
        places, _ = _samples(chunk, name_width)
        repeated = unpack_mask(note, len(places))
        stretch, steps, ballot = level_1(chunk, repeated)
        settled, holder = ballot.answers(replies, buckets).T
        known, sent = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        for mask, edge in ((settled, known), (settled & holder, sent)):
            np.add.at(edge, stretch[mask], 1)
            np.add.at(edge, stretch[mask] + steps[mask], -1)
        known, sent = np.cumsum(known[:-1]) > 0, np.cumsum(sent[:-1]) > 0
        ask = np.zeros(n + 1, np.int32)  # a repeated sample within reach, and room for the prefix
        first = chunk.offsets[np.searchsorted(chunk.offsets, places[repeated], side="right") - 1]
        np.add.at(ask, np.maximum(places[repeated] - PERIOD + 1, first), 1)
        np.add.at(ask, places[repeated] + 1, -1)
        ask = np.cumsum(ask[:-1]) > 0
        for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:]):
            ask[max(a, b - length + 1) : b] = False
        ask &= ~known | sent
        starts = np.flatnonzero(ask)
        ballot = Ballot(roller(3).at(chunk.buf, length, starts), full)
        note = pack_mask(np.concatenate([known, ask]))
        return cell_table([memo(number, note), *ballot.cells(number, buckets)])

    def compare(number: int, chunk: Chunk, note: bytes, replies) -> pa.Table:
        n = len(chunk.buf)
        known, ask = unpack_mask(note, 2 * n).reshape(2, n) if note else np.zeros((2, n), bool)
        starts = np.flatnonzero(ask)
        ballot = Ballot(roller(3).at(chunk.buf, length, starts), full)
        again = starts[ballot.answers(replies, buckets)[:, 0]]
        gone = covered(np.union1d(np.flatnonzero(known), again), length, n)
        spans, kept = [], []
        for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            kept.append(chunk.buf[a:b][~own].tobytes() if len(edges) else chunk.buf[a:b].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": chunk.doc_ids.cast(pa.int64()),
                "n_bytes": pa.array(chunk.lengths, pa.int64()),
                "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    names = chunks.groupBy("chunk").applyInArrow(sample, CELLS)
    longer = with_replies(chunks, count_votes(names), recurse, CELLS)
    rest = with_replies(chunks, count_votes(longer), merge, CELLS)
    return with_replies(chunks, count_votes(rest), compare, RESULT)
