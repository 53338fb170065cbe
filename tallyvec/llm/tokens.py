"""Token ids in files of fixed-width packed blocks.

A file set is a Parquet table with one row per block of whole documents: the shard and its
place in it, the ids of the documents, the number of token ids of each, and the token ids,
each in the fewest bits that hold the vocabulary, most significant bit first. Any id can be
reached from its block's row without decoding others, and a block is unpacked by numpy.
Spark writes and reads the files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvec.llm.worker import kept

BLOCK_IDS = 1 << 17  # a block is closed at so many ids; a document is never cut
GROUP_CHARS = 1 << 21  # so many characters are encoded together, or one longer text
PIECES = 1_500_000  # pieces of text that a worker remembers: some 250 MB; of ``write_tokens``, for one task
LEARNT = 1 << 15  # pieces encoded at once

FILE = (
    "shard int, block int, start long, doc_ids array<long>, counts array<long>, bits int, n_ids long, payload binary"
)


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack_ids(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from the one numbered ``start``; bytes before and after are not touched."""
    if bits in (8, 16, 32):
        step = bits // 8
        return np.frombuffer(payload, f">u{step}", n, start * step).astype(np.uint32)
    first, last = start * bits, (start + n) * bits
    raw = np.frombuffer(payload, np.uint8)[first // 8 : -(-last // 8)]
    flat = np.unpackbits(raw)[first % 8 : first % 8 + n * bits].reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, 32 - bits :] = flat
    return np.packbits(out, axis=1).view(">u4").reshape(-1).astype(np.uint32)


# White space of Unicode but for the space and the line end, and what some tables count as white space.
ODD_SPACE = (
    r"\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
)


class Encoder:
    """A tokenizers file, with the encodings of pieces remembered.

    A byte-level pre-tokenizer never joins what stands left and right of a single space or
    line end between two other characters, and never gives that to the left. So a text whose only white
    space is of that kind is put together from pieces, each with the space or line end before it; other
    texts, those that hold an added token such as ``<|endoftext|>`` (unless ``plain`` makes them
    ordinary text), and all texts of other kinds of tokenizers, are encoded as they are. Arrow finds the distinct pieces of
    many documents. Those not met before are encoded in one go: the lengths of the tokens in bytes tell
    where a piece ends.
    """

    def __init__(self, path: str, plain: bool = False, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.most = most
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self._many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.pieces = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not made.get("normalizer")
        )
        added = [x["content"] for x in made.get("added_tokens") or [] if x["content"] and not (plain and x["special"])]
        # One with white space could stand across pieces or texts.
        self.pieces = self.pieces and not any(re.search(r"\s|\0", x) for x in added)
        self.whole = "|".join([f"[{ODD_SPACE}]", r"[ \n][ \n]", r"[ \n]\z", *map(re.escape, added)])
        self.lengths = np.zeros(1 << self.bits, np.int64)  # a byte is one character of a token
        for token, number in self.tokenizer.get_vocab().items():
            self.lengths[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = {"": 0}  # what stands before a space or a line end at the start of a text
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def release(self) -> None:
        """Forget all pieces and give back the memory, which idle workers would keep from other stages."""
        self._forget()
        pa.default_memory_pool().release_unused()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._many([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Joined, pieces stay apart: each begins with a space or a line end, or is given one that is left out again."""
        bare = np.array([p[0] not in " \n" for p in pieces])
        joined = "".join(["\n" + p if b else p for p, b in zip(pieces, bare.tolist())])
        ids = self._whole(joined)
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(joined.encode(), np.uint8)
        starts = np.flatnonzero((raw == ord(" ")) | (raw == ord("\n")))
        count = np.diff(np.searchsorted(ends, np.append(starts[1:], len(raw))) + 1, prepend=0)
        first, end = len(self.known), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while first + len(pieces) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : end] = ids
        self.at[first : first + len(pieces)] = self.used + np.cumsum(count) - count + bare
        self.size[first : first + len(pieces)] = count - bare
        self.used = end
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pieces of all the texts are looked up and encoded together."""
        out: list[np.ndarray | None] = [None if t else np.zeros(0, np.uint32) for t in texts]
        left = [i for i, t in enumerate(texts) if t]
        column = pa.array([texts[i] for i in left], pa.large_string())
        if self.pieces and left:
            odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(left), bool)
        for i in np.flatnonzero(odd).tolist():
            out[left[i]] = self._whole(texts[left[i]])
        if not odd.all():
            ids, ends = self._by_pieces(column.filter(pa.array(~odd)))
            begin = 0
            for i, end in zip(np.flatnonzero(~odd).tolist(), ends.tolist()):
                out[left[i]] = ids[begin:end]
                begin = end
        return out

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(marked, "\0")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        own = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(own < 0)
        if len(missing):
            if len(self.known) + len(missing) > self.most:
                self._forget()
                own = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
                missing = np.flatnonzero(own < 0)
            for start in range(0, len(missing), LEARNT):
                self._learn([distinct[i] for i in missing[start : start + LEARNT].tolist()])
            own[missing] = np.arange(len(self.known) - len(missing), len(self.known))
        place = own[coded.indices.to_numpy()]
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[place] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy()[1:] - 1]


def encoder(path: str) -> Encoder:
    return kept(("tokens", path), lambda: Encoder(path))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> str:
    """Encode ``doc_id, text`` and write the files, in ascending order of ids; returns their path.

    Every document ends with ``end_id``. Null texts are empty, null ids come first, rows of
    the same id are ordered by a hash of the text; other columns are ignored. Shards follow
    the order of ids. ``tokenizer`` is a file that all executors have.
    """
    path = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names, parts = [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = {
                "shard": shard, "block": block, "start": start, "doc_ids": names,
                "counts": [len(p) for p in parts], "bits": coder.bits, "n_ids": len(ids),
                "payload": pack_ids(ids, coder.bits),
            }
            return pa.RecordBatch.from_pylist([row], _file_schema())

        held = 0
        try:
            for batch in batches:
                for doc_ids, texts in _groups(batch):
                    for name, ids in zip(doc_ids, coder.encode_many(texts)):
                        names.append(name)
                        parts.append(np.append(ids, np.uint32(end_id)))
                        held += len(parts[-1])
                        if held >= BLOCK_IDS:
                            yield close()
                            block, start = block + 1, start + held
                            names, parts, held = [], [], 0
            if parts:
                yield close()
        finally:
            coder.release()

    tie = F.xxhash64("text").alias("tie")
    ordered = docs.select("doc_id", "text", tie).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(work, FILE).write.option("compression", "zstd").parquet(path)
    return path


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of neighbouring documents, some ``GROUP_CHARS`` at a time."""
    doc_ids, texts, size = [], [], 0
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        doc_ids.append(name)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= GROUP_CHARS:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


def _file_schema() -> pa.Schema:
    long = pa.int64()
    return pa.schema(
        [
            ("shard", pa.int32()), ("block", pa.int32()), ("start", long), ("doc_ids", pa.list_(long)),
            ("counts", pa.list_(long)), ("bits", pa.int32()), ("n_ids", long), ("payload", pa.binary()),
        ]
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it. Shards number as many as the tasks
    that wrote them; their totals are added up in one window.
    """
    files = spark.read.schema(FILE).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    schema = "shard int, doc_id long, place long, n_tokens long, ids_crc32 long"
    schema += ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["payload"], row["bits"], row["n_ids"])
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                arrays = [
                    pa.array(np.full(len(counts), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(sums, pa.int64()),
                ]
                fields = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    own = np.concatenate([[0], ends]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(own, pa.array(ids.astype(np.int32))))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, fields)

    per_doc = files.mapInArrow(work, schema).join(offsets, "shard")
    start = (F.col("place") + F.col("offset")).alias("start")
    return per_doc.select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
