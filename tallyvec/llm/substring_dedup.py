"""Exact removal of repeated word sequences by fixed-block anchors.

A window of ``width`` words contains a whole reference block: a run of ``(width + 1) // 2``
words that starts at a multiple of that number. So the reference blocks of all documents
are indexed and probed with every rolling run of that many words. Around the hits, windows
of the full width are compared: the hit is extended left and right, as far as the words
are the same, to the maximal exact repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyvec.llm.ballots import (
    CELLS, Ballot, Chunk, bucket_bits, cell_table, count_votes, covered, into_chunks, memo, name_bits,
    pack_mask, unpack_mask, with_replies,
)
from tallyvec.llm.suffix_dedup import roller

RESULT = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string"

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Where the words of a chunk start and end, their fingerprints, and those of documents."""

    def __init__(self, chunk: Chunk, named: bool = True):
        inside = ~_space[chunk.buf]
        edges = np.diff(inside, prepend=False, append=False)
        cuts = chunk.offsets[1:-1]  # two documents' words may touch
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        joined = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts
        flips = np.flatnonzero(edges)
        self.starts = np.sort(np.concatenate([flips[::2], joined]))
        self.ends = np.sort(np.concatenate([flips[1::2], joined]))
        self.first = np.searchsorted(self.starts, chunk.offsets)  # word offsets of the documents
        self.counts = np.diff(self.first)
        self.names = roller(4).spans(chunk.buf, self.starts, self.ends) if named else None

    def windows(self, width: int) -> np.ndarray:
        """Starts, as word numbers, of all windows within one document."""
        fit = np.maximum(self.counts - width + 1, 0)
        return np.repeat(self.first[:-1] - (np.cumsum(fit) - fit), fit) + np.arange(fit.sum())


def remove_repeats(docs: DataFrame, width: int = 35, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Documents without the words of ``width``-word windows that start anywhere else too.

    Words are runs without a space or one of the characters 9 to 13. Takes ``doc_id`` and
    ``text``; other columns are ignored. Returns a row per document with its removed spans
    in words (maximal, ascending) and the kept words joined by one space. Null texts have
    no words, repeated rows are documents of their own, texts of fewer words stay whole,
    no documents give no rows.
    """
    block = (width + 1) // 2
    chunks, total, _ = into_chunks(docs, chunk_bytes)
    short, buckets = name_bits(total // 6), bucket_bits(total // 6)
    full = 62

    def anchors(words: Words) -> tuple[np.ndarray, Ballot]:
        starts = words.windows(block)
        own = np.searchsorted(words.first, starts, side="right") - 1
        reference = (starts - words.first[own]) % block == 0
        return starts[reference], Ballot(roller(5).at(words.names, block, starts), short, reference), reference

    def probe(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        _, ballot, _ = anchors(Words(Chunk(table)))
        return cell_table(ballot.cells(number, buckets))

    def extend(number: int, chunk: Chunk, note: bytes, replies) -> pa.Table:
        words = Words(chunk)
        blocks, ballot, reference = anchors(words)
        hit = np.zeros(len(words.names) + 1, np.int32)
        found = blocks[ballot.answers(replies, buckets)[reference, 0]]
        np.add.at(hit, np.maximum(found - block + 1, 0), 1)
        np.add.at(hit, found + 1, -1)
        windows = words.windows(width)
        ask = (np.cumsum(hit) > 0)[windows]
        ballot = Ballot(roller(6).at(words.names, width, windows[ask]), full)
        return cell_table([memo(number, pack_mask(ask)), *ballot.cells(number, buckets)])

    def compare(number: int, chunk: Chunk, note: bytes, replies) -> pa.Table:
        words = Words(chunk)
        windows = words.windows(width)
        windows = windows[unpack_mask(note, len(windows))] if note else windows[:0]
        ballot = Ballot(roller(6).at(words.names, width, windows), full)
        gone = covered(windows[ballot.answers(replies, buckets)[:, 0]], width, len(words.names))
        spans, kept = [], []
        for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            pieces = chunk.buf[chunk.offsets[d] : chunk.offsets[d + 1]].tobytes().split()
            if len(pieces) != b - a:
                raise AssertionError("words differ")
            if len(edges):
                pieces = [w for w, g in zip(pieces, own.tolist()) if not g]
            kept.append(b" ".join(pieces))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": chunk.doc_ids.cast(pa.int64()),
                "n_words": pa.array(words.counts, pa.int64()),
                "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    probes = chunks.groupBy("chunk").applyInArrow(probe, CELLS)
    hits = with_replies(chunks, count_votes(probes), extend, CELLS)
    return with_replies(chunks, count_votes(hits), compare, RESULT)
