"""Importance resampling against brute force over whole texts."""

import collections
import hashlib
import math
import re
import zlib

from tallyvec.llm import resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def found(text):
    words = WORD.findall((text or "").translate(LOW))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target, percent=25, least=20):
    made = [(i, *found(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in made for b in f)
    t = collections.Counter(b for x in target for b in found(x)[1])
    whole, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in range(10000)]
    out = []
    for i, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = place
    return out


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r)) for r in want)


def test_resampling(spark):
    long = "Der Über-Mut\n" * 3 + " ".join(f"w{i % 977}" for i in range(200_000)) + "\n\n\nend A\tb\0c\n-- \nX"
    odd = [None, "", "\n", "One", "one\nTWO\n\nthree", "  a\n\n b", "Der Über-Mut", long, "é É\né", "same line\nsame line\nsame line"]
    rows = list(enumerate(odd)) + [(None, "word " * 30), (3, "dup"), (3, "dup"), (7, long)]
    rows += [(i, "a hot line\n" + " ".join(f"x{(i * j) % 89}" for j in range(i % 60))) for i in range(100, 400)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    # Columns named like those used inside.
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, a string").repartition(7)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    same(resampling.resample(docs, aim).collect(), brute(rows, target))
    same(resampling.resample(docs, aim.where("false")).collect(), brute(rows, []))
    assert resampling.resample(docs.where("false"), aim).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "the same twenty words " * 5) for i in range(8)] * 2
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string"))
    same(got.collect(), brute(rows, ["a b"]))
