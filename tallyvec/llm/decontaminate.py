"""Benchmark decontamination with one Aho-Corasick automaton.

All windows of all test items, normalised, become patterns of one automaton; a normalised
text is scanned once, and the matched words are mapped to places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the original text, whose capitals are not lowered yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AUTOMATON_BYTES = 8 << 20  # item text per automaton; more items are scanned for block by block

_letter = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_built: dict[int, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_letter).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    """Consecutive words between spaces; one window for an item of fewer words."""
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def _automaton(items: list[tuple[str, str | None]], width: int) -> ahocorasick.Automaton:
    """Values: (number of words, item numbers). Built once per Python worker."""
    key = hash((tuple(items), width))
    if key not in _built:
        owners: dict[bytes, list[int]] = {}
        for number, (_, text) in enumerate(items):
            words = normal_words(text)
            for window in set(windows(words, width)) if words else ():
                owners.setdefault(window, []).append(number)
        made = ahocorasick.Automaton()
        for window, numbers in owners.items():
            made.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(numbers)))
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def _hits(text: str, words: list[bytes], automaton) -> tuple[list[int], set[int]]:
    """Numbers of the words inside matches, ascending, and of the items that match."""
    line = b" " + b" ".join(words) + b" "
    ends = list(automaton.iter(line.decode("latin-1")))
    hit, items = set(), set()
    at = done = 0  # words before the end of the match: spaces up to it, less the first
    for end, (n, numbers) in ends:
        done += line.count(b" ", at, end + 1)
        at = end + 1
        hit.update(range(done - 1 - n, done - 1))
        items.update(numbers)
    return sorted(hit), items


def scan(docs: DataFrame, items: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_words``, ``n_hit``, ``item_ids`` and ``spans``.

    Letters A-Z are lowered; words are runs of letters, digits and anything beyond ASCII.
    ``spans`` holds the places (in characters of the original text) of maximal runs of hit
    words, ``item_ids`` the ids, as strings, of the items with a window in the text. Null
    texts and items have no words, an item without words has no window, a null id counts
    as an empty string, repeated items as one; without items nothing is hit.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").distinct()
    blocks = _blocks(rows)
    result = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, ids, spans = [], [], [], []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py() or ""
                words = normal_words(text)
                hit, names = set(), set()
                for block in blocks:
                    own, numbers = _hits(text, words, _automaton(block, width))
                    hit.update(own)
                    names.update(block[i][0] for i in numbers)
                counts.append(len(words))
                found.append(len(hit))
                ids.append(sorted(names))
                spans.append(_places(text, hit))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(counts, pa.int64()), pa.array(found, pa.int64())]
            arrays += [pa.array(ids, pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "n_hit", "item_ids", "spans"])

    return docs.select(*keep, F.col("text").alias("__scanned")).mapInArrow(work, f"{kept}, {result}")


def _places(text: str, hit: set[int]) -> list[dict]:
    out: list[dict] = []
    if hit:
        for i, m in enumerate(WORD.finditer(text)):
            if i in hit:
                if i - 1 in hit:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end()})
    return out


def _blocks(rows: DataFrame) -> list[list[tuple[str, str]]]:
    """The items, which are few and of checked size, cut into blocks of one automaton each.

    A benchmark is a stated set that does not grow with the corpus. The driver holds it
    whole, up to a hundred automata; a larger one is refused rather than cut.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 100 * AUTOMATON_BYTES:
        raise ValueError(f"{size} bytes of items; split the benchmark")
    blocks: list[list[tuple[str, str]]] = []
    room = 0
    for row in sorted((r.id, r.text or "") for r in rows.toLocalIterator()):
        if not blocks or room < len(row[1].encode()):
            blocks.append([])
            room = AUTOMATON_BYTES
        blocks[-1].append(row)
        room -= len(row[1].encode())
    return blocks
