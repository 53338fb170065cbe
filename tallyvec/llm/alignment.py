"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the same bytes. Wherever both end a token, a group ends; wherever either
does, a link ends: the token of A and that of B over the bytes since the last such place.

The index is inverted: every pair of token ids has a posting, the compressed bitmap of the
documents that link the pair, with multiplicity planes beside it (plane ``j`` holds bit
``j`` of one less than the number of links in a document). Postings are made per chunk of
documents, OR-merged by bucket of the B id into bands of documents, and popcounted: the
bitmap gives the number of documents, bitmap and planes that of links. Then the counts meet
the postings again, which return the scores of their documents: no text is read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.llm.ballots import deflate, inflate, pack, unpack
from tallyvec.llm.tokens import Encoder
from tallyvec.llm.worker import kept
from tallyvec.sources.stage import write_stage

CHUNK_BYTES = 2 << 20  # text in a chunk, or one longer document
GROUP_CHARS = 1 << 19  # characters tokenized together
PIECES = 400_000  # pieces of text that a worker remembers
BUCKETS = 16  # of B ids
BAND_BYTES = 16 << 20  # of packed postings in a bucket's band

POSTINGS = "pairs binary, counts binary, lists binary, bitmaps binary"
_fields = ["pairs", "counts", "lists", "bitmaps"]
DOC_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


class Tokenizers:
    """A byte-level tokenizers file (A) and a sentencepiece model (B), with their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, plain=True, most=PIECES)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocab = self.a.tokenizer.get_vocab()
        table = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            table[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_bytes = _Flat(table)
        self.b_bytes = _Flat([self._piece(i) for i in range(self.b.get_piece_size())])

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        return self.a.encode_many([" " + t for t in texts]), self.b.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Flat:
    """Byte strings end to end."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return kept(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))


class Aligned:
    """Tokens, groups and links of the texts of one chunk."""

    def __init__(self, coder: Tokenizers, texts: list[str]):
        n = len(texts)
        a_lists, b_lists = [], []
        for part in _parts(texts):
            one, two = coder.encode(part)
            a_lists += one
            b_lists += two
        raw = [b" " + t.encode() if t else b"" for t in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        a, na = _flat_ids(a_lists)
        b, nb = _flat_ids(b_lists)
        good = sizes > 0
        for flat, ids, counts in ((coder.a_bytes, a, na), (coder.b_bytes, b, nb)):
            good &= _sums(flat.sizes[ids], counts) == sizes
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        text = np.frombuffer(b"".join(x for x, g in zip(raw, good) if g), np.uint8)
        where = np.repeat(np.arange(n), sizes * good)
        bad = where[(coder.a_bytes.joined(a) != text) | (coder.b_bytes.joined(b) != text)]
        if len(bad):
            fine = good.copy()
            fine[bad] = False
            a, b = a[np.repeat(fine, na)], b[np.repeat(fine, nb)]
            na, nb, good = na * fine, nb * fine, fine
        sizes = sizes * good
        total = int(sizes.sum())
        a_ends, b_ends = np.cumsum(coder.a_bytes.sizes[a]), np.cumsum(coder.b_bytes.sizes[b])
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[a_ends] = True
        is_b[b_ends] = True
        ends = np.flatnonzero(is_a | is_b)
        both = np.flatnonzero(is_a & is_b)
        doc_ends = np.cumsum(sizes)
        #: By link: ids of its tokens and the document's number.
        self.link_a = a[np.searchsorted(a_ends, ends)]
        self.link_b = b[np.searchsorted(b_ends, ends)]
        self.link_doc = np.searchsorted(doc_ends, ends)
        self.n_a, self.n_b = na, nb
        self.n_groups = np.bincount(np.searchsorted(doc_ends, both), minlength=n)
        self.n_links = np.bincount(self.link_doc, minlength=n)
        self.a, self.b = a, b
        self.a_group, self.b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)

    def groups(self, names: list[str]) -> Iterator[str]:
        """Per document its groups as text; ``names`` are the ids' decimals with each separator."""
        number = np.concatenate([2 * self.a_group, 2 * self.b_group + 1])
        order = np.argsort(number, kind="stable")  # two ascending runs, merged
        number, ids = number[order], np.concatenate([self.a, self.b])[order]
        after = np.append(number[1:], -1)
        kind = np.where(after == number, 0, np.where(number % 2 == 0, 1, 2))
        counts = self.n_a + self.n_b
        ends = np.cumsum(counts)
        kind[ends[counts > 0] - 1] = 3
        codes = (ids * 4 + kind).tolist()
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            yield "".join([names[c] for c in codes[start:end]])


def _parts(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _flat_ids(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    out = np.empty(int(counts.sum()), np.int64)
    at = 0
    for x in lists:
        out[at : at + len(x)] = x
        at += len(x)
    return out, counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    running = np.concatenate([[0], np.cumsum(values)])
    return running[ends] - running[ends - counts]


def entries(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs; and per pair and document, by pair: place of the pair, document, links."""
    distinct, place = np.unique(pairs, return_inverse=True)
    width = int(docs.max(initial=0)) + 1
    both, times = np.unique(place * width + docs, return_counts=True)
    return distinct, both // width, both % width, times


def pack_postings(pairs: np.ndarray, place: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[bytes, ...]:
    """Bitmap and planes of each pair, as ascending lists or, where that is shorter, as bits."""
    top = int(times.max(initial=1)) - 1
    counts, lists, bits = [], [], []
    for plane in range(1 + top.bit_length()):
        on = slice(None) if plane == 0 else ((times - 1) >> (plane - 1)) & 1 == 1
        own, at = place[on], doc[on]
        n = np.bincount(own, minlength=len(pairs))
        dense = n * 32 > n_docs
        lists.append(at[~dense[own]])
        turn = np.cumsum(dense) - 1
        plot = np.zeros((int(dense.sum()), n_docs), bool)
        plot[turn[own[dense[own]]], at[dense[own]]] = True
        bits.append(np.packbits(plot, axis=1).reshape(-1))
        counts.append(np.where(dense, -1, n))
    parts = [np.concatenate(counts).astype("<i4"), np.concatenate(lists).astype("<u4"), np.concatenate(bits)]
    return pack(pairs.astype(np.uint64)), *[deflate(_planes(p)) for p in parts]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def unpack_postings(pairs: bytes, counts: bytes, lists: bytes, bitmaps: bytes, n_docs: int):
    """What was packed: distinct pairs, and by pair and document the place of the pair, document and links."""
    distinct = unpack(pairs).astype(np.int64)
    sizes = _numbers(inflate(counts), "<i4").reshape(-1, len(distinct))
    listed = _numbers(inflate(lists), "<u4").astype(np.int64)
    bits = np.frombuffer(inflate(bitmaps), np.uint8).reshape(-1, (n_docs + 7) // 8)
    keys, found = None, None
    at = row = 0
    for plane, n in enumerate(sizes):
        plain = np.maximum(n, 0)
        own = np.repeat(np.arange(len(distinct)), plain) * n_docs + listed[at : at + int(plain.sum())]
        at += int(plain.sum())
        dense = np.flatnonzero(n < 0)
        if len(dense):
            pair, doc = np.nonzero(np.unpackbits(bits[row : row + len(dense)], axis=1, count=n_docs))
            row += len(dense)
            own = np.sort(np.concatenate([own, dense[pair] * n_docs + doc]))
        if plane == 0:
            keys, found = own, np.ones(len(own), np.int64)
        else:
            found[np.searchsorted(keys, own)] += 1 << (plane - 1)
    return distinct, keys // n_docs, keys % n_docs, found


def popcounts(pairs: bytes, counts: bytes, lists: bytes, bitmaps: bytes, n_docs: int):
    """Distinct pairs with their numbers of documents and of links, without unpacking the bitmaps."""
    distinct = unpack(pairs).astype(np.int64)
    sizes = _numbers(inflate(counts), "<i4").reshape(-1, len(distinct)).astype(np.int64)
    ones = np.bitwise_count(np.frombuffer(inflate(bitmaps), np.uint8).reshape(-1, (n_docs + 7) // 8)).sum(1, dtype=np.int64)
    sizes[sizes < 0] = ones  # bitmaps stand in the order of planes and pairs
    weights = np.concatenate([[1], 1 << np.arange(len(sizes) - 1)])
    return distinct, sizes[0], weights @ sizes


def _index(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: a document's own columns; the postings of a chunk and bucket."""
    schema = (
        "chunk long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        f"bucket int, n_docs int, {POSTINGS}"
    )
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizers(a_path, b_path)
        # Ids with what may follow one: a token of its side, the other side, a group, nothing.
        size = max(len(coder.a_bytes.sizes), len(coder.b_bytes.sizes))
        decimals = [f"{i}{s}" for i in range(size) for s in (",", "|", ";", "")]
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 1, chunk_bytes):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                found, n = Aligned(coder, texts), len(texts)
                shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups(decimals)]
                numbers = [pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                arrays = [pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), batch.column(0).cast(pa.int64())]
                arrays += [*numbers, pa.array(shas, pa.string())]
                arrays += [pa.nulls(n, t) for t in types[len(arrays) :]]
                yield pa.RecordBatch.from_arrays(arrays, names)
                cells = []
                buckets = found.link_b % BUCKETS
                order = np.argsort(buckets, kind="stable")
                cuts = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
                pairs = found.link_b << 32 | found.link_a
                for bucket, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if y > x:
                        own = order[x:y]
                        packed = pack_postings(*entries(pairs[own], found.link_doc[own]), n)
                        cells.append((chunk, *[None] * 7, bucket, n, *packed))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names)
                chunk += 1

    return write_stage(docs.select("doc_id", "text").mapInArrow(work, schema), "align-index")


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``size`` bytes, or one longer text."""
    texts = batch.column(column).cast(pa.large_binary())
    lengths = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, before + size)))
        yield batch.slice(start, end - start)
        start = end


def _merge(cells: DataFrame, band_bytes: int) -> DataFrame:
    """Postings of a bucket and a band of chunks, OR-merged; a band bounds what a task holds."""
    packed = sum(F.octet_length(c) for c in _fields)
    largest = cells.groupBy("bucket").agg(F.sum(packed).alias("n")).agg(F.max("n")).first()[0] or 0
    bands = largest // band_bytes + 1
    band = F.pmod(F.xxhash64("chunk"), F.lit(bands)).cast("int").alias("band")
    schema = f"bucket int, band int, chunks array<long>, sizes array<int>, {POSTINGS}"

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sizes = table["n_docs"].to_numpy()
        before = np.cumsum(sizes) - sizes
        pairs, docs, times = [], [], []
        for i, row in enumerate(table.select(_fields).to_pylist()):
            distinct, place, doc, n = unpack_postings(*row.values(), int(sizes[i]))
            pairs.append(distinct[place])
            docs.append(doc + before[i])
            times.append(n)
        pair, doc, n = (np.concatenate(x) for x in (pairs, docs, times))
        distinct, place = np.unique(pair, return_inverse=True)
        order = np.argsort(place, kind="stable")  # chunks ascend, and so do documents within a pair
        packed = pack_postings(distinct, place[order], doc[order], n[order], int(sizes.sum()))
        return pa.table(
            {
                "bucket": table["bucket"][:1], "band": table["band"][:1],
                "chunks": pa.array([table["chunk"].to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
                **{f: pa.array([p], pa.binary()) for f, p in zip(_fields, packed)},
            }
        )

    placed = cells.select("chunk", "bucket", "n_docs", band, *_fields)
    return write_stage(placed.groupBy("bucket", "band").applyInArrow(merge, schema), "align-postings")


def _pair_counts(postings: DataFrame) -> DataFrame:
    """``(bucket, b_id, a_id, n_docs, n_links, best)`` by popcount; ``best``: no A id has more links with the B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, docs, links = popcounts(*[row[f] for f in _fields], sum(row["sizes"]))
                bucket = pa.array(np.full(len(pairs), row["bucket"], np.int32))
                yield pa.RecordBatch.from_arrays([bucket, *map(pa.array, (pairs, docs, links))], ["bucket", "pair", "d", "n"])

    counted = postings.select("bucket", "sizes", *_fields).mapInArrow(count, "bucket int, pair long, d long, n long")
    summed = counted.groupBy("bucket", "pair").agg(F.sum("d").alias("n_docs"), F.sum("n").alias("n_links"))
    summed = write_stage(
        summed.select(
            "bucket", F.shiftright("pair", 32).cast("int").alias("b_id"),
            F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("a_id"), "n_docs", "n_links",
        ), "align-pairs",
    )
    most = summed.groupBy(F.col("b_id").alias("b")).agg(F.max("n_links").alias("most"))
    return summed.join(most, F.col("b_id") == F.col("b")).select(*summed.columns, (F.col("n_links") == F.col("most")).alias("best"))


def _scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(chunk, scores)``: what a bucket's postings return to the documents of a chunk."""
    bands = postings.select(F.col("bucket").alias("k"), F.col("band").alias("to"))
    sent = pairs.join(bands, F.col("bucket") == F.col("k")).select("k", "to", "b_id", "a_id", "n_links", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        sizes = np.array(row["sizes"], np.int64)
        distinct, place, doc, times = unpack_postings(*[row[f] for f in _fields], int(sizes.sum()))
        known = right["b_id"].to_numpy().astype(np.int64) << 32 | right["a_id"].to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, distinct, sorter=order)]
        counts, best = right["n_links"].to_numpy()[at], right["best"].to_numpy(zero_copy_only=False)[at]
        sums, bests = np.zeros((2, int(sizes.sum())), np.int64)
        np.add.at(sums, doc, times * counts[place])
        np.add.at(bests, doc, times * best[place])
        cuts = np.cumsum(sizes)[:-1]
        packed = [deflate(np.concatenate(x).tobytes()) for x in zip(np.split(bests, cuts), np.split(sums, cuts))]
        return pa.table({"chunk": pa.array(row["chunks"], pa.int64()), "scores": pa.array(packed, pa.binary())})

    met = postings.groupBy("bucket", "band").cogroup(sent.groupBy("k", "to"))
    return met.applyInArrow(score, "chunk long, scores binary")


def align(
    docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES, band_bytes: int = BAND_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Per document its alignment and scores, and per linked pair of ids its counts.

    First ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: tokens of
    both kinds, groups, links, links whose pair is the best of its B id, the pairs' counts added up over
    the links, and the digest of the groups. Then ``bucket, b_id, a_id, n_docs, n_links, best``.
    ``a_path`` is a byte-level file of the tokenizers library, which gets a space and the
    text; ``b_path`` a sentencepiece model that adds the space. Strings of special tokens are plain text.

    Null and empty texts, and those whose tokens' bytes are not the text's, have no tokens: zeros and
    an empty digest. Takes ``doc_id`` and ``text``, ignores other columns; repeated rows and ids and
    null ids are documents of their own; no rows give none. Files must be on all executors.
    """
    index = _index(docs, a_path, b_path, chunk_bytes)
    cells = index.where("bucket is not null").select("chunk", "bucket", "n_docs", *_fields)
    postings = _merge(cells, band_bytes)
    pairs = write_stage(_pair_counts(postings), "align-counts")
    returned = _scores(postings, pairs)
    own = index.where("bucket is null").select("chunk", "number", "doc_id", *DOC_COLUMNS, "groups_sha256")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("number")
        both = np.zeros((2, left.num_rows), np.int64)
        for payload in right["scores"]:
            both += np.frombuffer(inflate(payload.as_py()), np.int64).reshape(2, -1)
        out = {c: left[c] for c in ("doc_id", *DOC_COLUMNS)}
        return pa.table(out | {"n_best": both[0], "count_sum": both[1], "groups_sha256": left["groups_sha256"]})

    schema = ", ".join(f"{c} long" for c in ("doc_id", *DOC_COLUMNS, "n_best", "count_sum")) + ", groups_sha256 string"
    scored = own.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(gather, schema)
    return scored, pairs
