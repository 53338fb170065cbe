"""Sums by integer keys within a task, over bounded stretches of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

# Tokens that are paired at a time, rows that are added up before they are sent on, rows sent at a time,
# words of sentences that are counted at a time, and words of a chunk.
TAKEN, HELD, SENT, COUNTED, CODED = 1 << 18, 1 << 22, 1 << 16, 1 << 21, 1 << 21


def _packed(columns: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int]] | None:
    """Rows of numbers as one number each, in the same order, if they fit, and the least and the bits of each column."""
    least = [int(c.min()) for c in columns]
    bits = [(int(c.max()) - low).bit_length() for c, low in zip(columns, least)]
    if sum(bits) > 63:
        return None
    packed = np.zeros(len(columns[0]), np.int64)
    for c, low, b in zip(columns, least, bits):
        packed <<= b
        packed |= c - low
    return packed, least, bits


def _unpacked(packed: np.ndarray, least: list[int], bits: list[int]) -> list[np.ndarray]:
    """The columns of ``_packed``, whose numbers are used up."""
    out = []
    for low, b in zip(least[::-1], bits[::-1]):
        out.append((packed & ((1 << b) - 1)) + low)
        packed >>= b
    return out[::-1]


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows in order of all columns. Single numbers sort many times as fast as their order is found."""
    found = _packed(columns)
    if found is None:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    found[0].sort()
    return [new.astype(c.dtype) for c, new in zip(columns, _unpacked(*found))]


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where the runs of equal rows begin."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sum_by_key(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys, in order, and the sum of each one's values; nothing may be negative."""
    *keys, values = _sorted([*keys, values])
    starts = _starts(keys)
    return [k[starts] for k in keys], np.add.reduceat(values, starts)


def stretches(
    batches: Iterator[pa.RecordBatch], size: int, measure: Callable[[pa.RecordBatch], int]
) -> Iterator[pa.Table]:
    """The same rows in fewer and larger tables, of ``size`` or little more."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += measure(batch)
        if n >= size:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _added(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*([*k, v] for k, v in parts))]
    return sum_by_key(columns[:-1], columns[-1])


def running_sums(
    parts: Iterator[tuple[list[np.ndarray], np.ndarray]], held: int | None = None
) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sums of ``(keys, values)`` in stretches, each in order; a key may come once per stretch.

    ``held`` rows at most wait at a time, besides those of one part. As long as adding up halves them,
    the sums wait for more of the same keys.
    """
    held = held or HELD
    waiting, n = [], 0
    for keys, values in parts:
        if not len(values):
            continue
        waiting.append((keys, values))
        n += len(values)
        if n >= held:
            sums = _added(waiting)
            waiting, n = [sums], len(sums[1])
            if n > held // 2:
                waiting, n = [], 0
                yield sums
    if n:
        yield _added(waiting)


def total_sums(
    parts: Iterator[tuple[list[np.ndarray], np.ndarray]], held: int | None = None
) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The sums of ``(keys, values)``, each key once and in order; they alone, and as many rows again, are held."""
    waiting, n, most = [], 0, held or HELD
    for part in parts:
        waiting.append(part)
        n += len(part[1])
        if n >= most:
            waiting = [_added(waiting)]
            n = len(waiting[0][1])
            most = max(most, 2 * n)
    return _added(waiting) if waiting else None


# Sums of pairs that travel: the groups of both numbers, and the sums of such pairs.
PACKED_SCHEMA = "a int, b int, sums binary"
_packed_fields = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("sums", pa.binary())])


def _planes(numbers: np.ndarray) -> tuple[int, bytes]:
    """How many bytes the largest number takes, and the lowest bytes of all numbers, then the next ones."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    cells = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)
    return width, np.ascontiguousarray(cells[:, :width].T).tobytes()


def pack_sums(keys: list[np.ndarray], values: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Sums in order of their keys, the first two a pair, as rows of ``PACKED_SCHEMA``, one for each two groups.

    Numbers are dealt to the groups in turn. Of the keys, as one number each, the differences are kept, compressed byte by byte.
    """
    cells = keys[0] % groups * groups + keys[1] % groups
    order = np.argsort(cells.astype(np.uint16) if groups <= 256 else cells, kind="stable")
    cells = cells[order]
    cuts = np.flatnonzero(np.diff(cells, prepend=-1, append=groups * groups)).tolist()
    columns = [keys[0][order] // groups, keys[1][order] // groups, *(k[order] for k in keys[2:])]
    found, values, codec = _packed(columns), values[order], pa.Codec("zstd", compression_level=1)
    rows = []
    for begin, end in zip(cuts[:-1], cuts[1:]):
        # Numbers too large to be one are sent as they are.
        own = [c[begin:end] for c in columns] if found is None else [np.diff(found[0][begin:end], prepend=0)]
        planes = [_planes(c) for c in [*own, values[begin:end]]]
        least, bits = ([], []) if found is None else found[1:]
        head = np.array([end - begin, len(bits), *least, *bits, len(planes), *(w for w, _ in planes)], "<i8")
        data = b"".join([head.tobytes(), *(p for _, p in planes)])
        packed = len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)
        rows.append((cells[begin] // groups, cells[begin] % groups, packed))
    for i in range(0, len(rows), 256):
        batch = zip(*rows[i : i + 256])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(batch, _packed_fields)], _packed_fields.names)


def unpack_sums(sums: bytes, a: int, b: int, groups: int) -> tuple[list[np.ndarray], np.ndarray]:
    """``(keys, values)`` of a row of ``PACKED_SCHEMA``."""
    data = pa.Codec("zstd").decompress(sums[8:], int.from_bytes(sums[:8], "little"), asbytes=True)
    head = np.frombuffer(data, "<i8", len(data) // 8)
    n, k = head[:2].tolist()
    least, bits = head[2 : 2 + k].tolist(), head[2 + k : 2 + 2 * k].tolist()
    at = 2 + 2 * k
    widths = head[at + 1 : at + 1 + head[at]].tolist()
    raw = np.frombuffer(data, np.uint8, offset=8 * (at + 1 + len(widths))).reshape(-1, n)
    columns, at = [], 0
    for width in widths:
        cells = np.zeros((n, 8), np.uint8)
        cells[:, :width] = raw[at : at + width].T
        columns.append(cells.reshape(-1).view("<i8"))
        at += width
    keys = _unpacked(np.cumsum(columns[0]), least, bits) if k else columns[:-1]
    return [keys[0] * groups + a, keys[1] * groups + b, *keys[2:]], columns[-1]


def pair_sums(
    kind: str, groups: int, min_units: int, last: int | None
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function from ``(a, b, sums)``, all that there are of two groups in a row, to ``(a, b, units)``, each pair once.

    With blocks, the third key, up to ``last``, the pruning is applied: at the end of every block but the last, a pair
    whose running count is too low is dropped and starts again from zero. Once a block ends with enough, the pair stays
    for good. So the pair keeps what it counted from the first block on that is large enough by itself, or is the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two, packed in zip(*(batch[c] for c in batch.columns)):
                (a, b, *block), units = total_sums(unpack_sums(s, int(one), int(two), groups) for s in packed)
                if last is not None:
                    starts = _starts([a, b])
                    enough = np.cumsum((units >= min_units) | (block[0] == last))
                    before = np.concatenate([[0], enough])[starts]
                    stays = enough > np.repeat(before, np.diff(starts, append=len(a)))
                    kept = np.logical_or.reduceat(stays, starts)
                    a, b, units = a[starts][kept], b[starts][kept], np.add.reduceat(np.where(stays, units, 0), starts)[kept]
                a, b = a.astype(kind), b.astype(kind)
                for i in range(0, len(a), SENT):
                    yield pd.DataFrame({"a": a[i : i + SENT], "b": b[i : i + SENT], "units": units[i : i + SENT]})

    return run


def _pairs(
    tokens: dict[str, np.ndarray], old: int, step: int, window: int, dynamic_weight: bool, keep: list[str]
) -> tuple[list[np.ndarray], np.ndarray]:
    """``(a, b, keep)`` and units of near tokens that are ``step`` rows apart, the later one behind the first ``old``."""
    later = max(step, old)
    sent, pos, idx = tokens["sent"], tokens["pos"], tokens["idx"]
    distance = pos[later:] - pos[later - step : len(pos) - step]
    near = np.flatnonzero((sent[later:] == sent[later - step : len(sent) - step]) & (distance <= window))
    x, y = idx[near + later - step], idx[near + later]
    units = window + 1 - distance[near] if dynamic_weight else np.ones(len(near), np.int32)
    # A word next to itself is counted from both ends.
    units = np.where(x == y, 2 * units, units).astype(np.int64)
    return [np.minimum(x, y), np.maximum(x, y), *(tokens[k][near + later] for k in keep)], units


def near_pairs(
    window: int, dynamic_weight: bool, keep: list[str], groups: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from tokens ``(keep, sent, pos, idx)`` to packed sums by ``(a, b, keep)`` of near pairs.

    Sentences follow one another whole and their places rise. Integer columns ``keep`` belong to the sentence.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        before = None
        for table in stretches(batches, TAKEN, lambda b: b.num_rows):
            tokens = {name: table[name].to_numpy() for name in table.column_names}
            if not len(tokens["idx"]):
                continue
            old = 0
            if before is not None:
                old = len(before["idx"])
                tokens = {name: np.concatenate([before[name], c]) for name, c in tokens.items()}
            # Unknown words have no row, so tokens within the window are at most as many rows apart.
            for step in range(1, min(window, len(tokens["idx"]) - 1) + 1):
                yield _pairs(tokens, old, step, window, dynamic_weight, keep)
            before = {name: c[-window:] for name, c in tokens.items()}

    return lambda batches: (row for sums in running_sums(parts(batches)) for row in pack_sums(*sums, groups))


def code_words(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from sentences ``(keep, words)`` to rows ``(chunk, keep, codes, code, word)`` of two kinds.

    One per sentence, with the codes of its words, and one per code and word of a chunk of sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, table in enumerate(stretches(batches, CODED, _words)):
            lengths, names, codes = _of_lists(table, "words")
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            texts = {k: table[k] for k in keep}
            texts["codes"] = pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32)))
            words = {"code": pa.array(np.arange(len(names), dtype=np.int32)), "word": names}
            for columns, rows in ((texts, len(lengths)), (words, len(names))):
                kinds = {"chunk": pa.int64(), **dict.fromkeys(keep, pa.int32()), "codes": pa.list_(pa.int32()), "code": pa.int32(), "word": pa.string()}
                columns = {"chunk": pa.array(np.full(rows, first + n)), **columns}
                full = pa.table({k: columns[k] if k in columns else pa.nulls(rows, kind) for k, kind in kinds.items()})
                yield from full.to_batches(max_chunksize=SENT)

    return run


def coded_pairs(
    window: int, dynamic_weight: bool, keep: list[str], groups: int
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function from a chunk's ``(chunk, keep, codes)`` and ``(of, code, idx)`` to packed sums by ``(a, b, keep)``."""

    def run(texts: pa.Table, ids: pa.Table) -> pa.Table:
        idx = ids["idx"].to_numpy()
        lists = texts["codes"].combine_chunks()
        codes, lengths = pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy()
        index = np.full(max(codes.max(initial=-1), ids["code"].to_numpy().max(initial=-1)) + 1, -1, idx.dtype)
        index[ids["code"].to_numpy()] = idx
        known = np.flatnonzero(index[codes] >= 0)
        tokens = {k: np.repeat(texts[k].to_numpy(), lengths)[known] for k in keep}
        tokens["sent"] = np.repeat(np.arange(len(lengths)), lengths)[known]
        tokens |= {"pos": _within(lengths)[known], "idx": index[codes[known]]}
        steps = range(1, min(window, len(known) - 1) + 1)
        found = (_pairs(tokens, 0, step, window, dynamic_weight, keep) for step in steps)
        rows = (row for sums in running_sums(found) for row in pack_sums(*sums, groups))
        return pa.Table.from_batches(rows, _packed_fields)

    return run


def _of_lists(table: pa.Table, name: str) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Of a column of lists of strings: the lists' lengths, their strings, and the strings' codes."""
    lists = table[name].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(lists), null_encoding="encode")
    return lengths.astype(np.int64), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _places(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The sentences by ``(doc_id, sent_no)``, and the first place among them of each one's key."""
    keys = table.select(["doc_id", "sent_no"])
    order = pc.sort_indices(keys, [("doc_id", "ascending"), ("sent_no", "ascending")]).to_numpy()
    keys = keys.take(order)
    same = np.ones(max(len(order) - 1, 0), bool)
    for name in keys.column_names:
        c = keys[name].combine_chunks()
        same &= pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
    places = np.empty(len(order), np.int64)
    places[order] = np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, np.arange(len(order))))
    return keys, places


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _counted(
    keys: list[tuple[str, np.ndarray, pa.Array]], place: np.ndarray, pos: np.ndarray, sentences: pa.Table
) -> Iterator[pa.RecordBatch]:
    """How often each row of coded keys occurs, and its first place."""
    *codes, place, pos = _sorted([*(code for _, code, _ in keys), place, pos])
    starts = _starts(codes)
    first = sentences.take(place[starts])
    columns = {name: names.take(pa.array(code[starts])) for (name, _, names), code in zip(keys, codes)}
    columns["cnt"] = pa.array(np.diff(starts, append=len(pos)).astype(np.int64))
    columns |= {name: first[name].combine_chunks() for name in ("doc_id", "sent_no")}
    columns["pos"] = pa.array(pos[starts].astype(np.int32))
    for batch in pa.table(columns).to_batches(max_chunksize=SENT):
        yield batch


def _words(batch: pa.RecordBatch) -> int:
    return len(batch["words"].flatten())


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sentences ``(doc_id, sent_no, words)`` to ``(word, cnt, doc_id, sent_no, pos)``, the last three the first place.

    Words are counted over bounded stretches, so a word may come more than once.
    """
    for table in stretches(batches, COUNTED, _words):
        lengths, names, codes = _of_lists(table, "words")
        if len(codes):
            sentences, places = _places(table)
            yield from _counted([("word", codes, names)], np.repeat(places, lengths), _within(lengths), sentences)


def count_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sentences ``(doc_id, sent_no, labels, words)`` to ``(label, word, cnt, doc_id, sent_no, pos)``.

    Each word counts once for each label of its sentence; the first place is that of the label in its list.
    """
    for table in stretches(batches, COUNTED, _words):
        n_words, words, word_codes = _of_lists(table, "words")
        n_labels, labels, label_codes = _of_lists(table, "labels")
        sentences, places = _places(table)
        # One entry for each label of a sentence, with all words of that sentence.
        of, pos = np.repeat(np.arange(len(n_words)), n_labels), _within(n_labels)
        begins, ends = (np.cumsum(n_words) - n_words)[of], np.cumsum(n_words[of])
        at = 0
        while at < len(of):
            # As many entries as make a bounded number of rows, or one.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * COUNTED)))
            some = slice(at, to)
            lengths = n_words[of[some]]
            if lengths.any():
                word = word_codes[np.repeat(begins[some], lengths) + _within(lengths)]
                label = np.repeat(label_codes[some], lengths)
                keys = [("label", label, labels), ("word", word, words)]
                yield from _counted(keys, np.repeat(places[of[some]], lengths), np.repeat(pos[some], lengths), sentences)
            at = to
