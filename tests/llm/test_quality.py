"""The byte model against a plain implementation with dictionaries."""

import collections
import math
import random
import re
import tracemalloc

from pyspark.sql import functions as F

from tallyvec.llm import kneser_ney

ORDER, START, END = 6, 0xFF, 0xFE


def grams(text):
    units = bytes([START]) * (ORDER - 1) + text.encode() + bytes([END])
    return [units[i : i + ORDER] for i in range(len(units) - ORDER + 1)]


class Model:
    """Interpolated modified Kneser-Ney, looked up gram by gram."""

    def __init__(self, texts):
        self.counts = {ORDER: collections.Counter(g for t in texts for g in grams(t))}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])
        self.cut, self.total, self.off = {}, {}, {}
        for n, table in self.counts.items():
            few = collections.Counter(table.values())
            y = few[1] / (few[1] + 2 * few[2]) if few[1] else 0.5
            raw = [k - (k + 1) * y * few[k + 1] / few[k] if few[k] else k / 2 for k in (1, 2, 3)]
            self.cut[n] = [max(0.05, min(k - 0.05, d)) for k, d in zip((1, 2, 3), raw)]
            self.total[n], self.off[n] = collections.Counter(), collections.Counter()
            for g, c in table.items():
                self.total[n][g[:-1]] += c
                self.off[n][g[:-1]] += self.cut[n][min(c, 3) - 1]

    def p(self, gram):
        n = len(gram)
        c = self.counts[n][gram]
        own = c - self.cut[n][min(c, 3) - 1] if c else 0.0
        if n == 1:
            return (own + self.off[1][b""] / (len(self.counts[1]) + 1)) / self.total[1][b""]
        context = gram[:-1]
        if context not in self.total[n]:
            return self.p(gram[1:])
        return (own + self.off[n][context] * self.p(gram[1:])) / self.total[n][context]


def test_perplexity_is_that_of_dictionaries(spark):
    rng = random.Random(4)
    words = "the of and über thé wæther 中文 then \U0001f600 a b".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, "never seen: qqqq \0 zz", "the of " * 40_000, texts[3], texts[3]]
    rows = [(i, t, "en", "x") for i, t in enumerate(texts)] + [(None, "the of", None, "x"), (7, "the", "en", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(100)] * 2 + [(None,)], "doc_id long")
    got = kneser_ney.perplexity(docs, trusted).collect()
    assert len(got) == len(rows)
    held = {r.doc_id for r in got if r.split == "held"}
    assert held and held < set(range(100))
    model = Model([t for i, t, _, _ in rows if i is not None and i < 100 and i not in held])
    want = collections.defaultdict(list)
    for i, t, _, _ in rows:
        want[i].append((len((t or "").encode()), -sum(math.log2(model.p(g)) for g in grams(t or ""))))
    for r in got:
        # An answer is rounded to a 1024th of a bit.
        room = 0.0006 * (r.n_bytes + 1) + 0.001
        assert any(n == r.n_bytes and abs(bits - r.bits) <= room for n, bits in want[r.doc_id]), r
    assert kneser_ney.classify(docs.where("false"), trusted).collect() == []
    alone = kneser_ney.classify(docs, trusted.where("false"))
    assert alone.where(~F.col("kept")).count() == 0 and alone.count() == len(rows)


def test_lists_of_grams_are_dealt_once(spark, monkeypatch):
    written, write = {}, kneser_ney.write_stage

    def listed(df, name):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(kneser_ney, "write_stage", listed)
    rows = [(i, f"the text number {i} of some", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    scored = kneser_ney.perplexity(docs, trusted)
    assert scored.count() == 40 and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    # Written, the lists were dealt by bucket for the merge and again for the replies.
    assert "kn-asked" not in written
    assert not re.search(r"hashpartitioning\(bucket#\d+, \d+\), ENSURE_REQUIREMENTS", written["kn-scores"])


def test_parts_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 300))).encode() for _ in range(50)]
    whole = kneser_ney._distinct(texts)
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 500)
    parts = kneser_ney._distinct(texts)
    assert all((a == b).all() for a, b in zip(whole, parts)) and whole[1].sum() == sum(len(t) + 1 for t in texts)
    assert kneser_ney._distinct([])[0].size == 0 == kneser_ney._grams([])[1].size


def test_grams_of_a_chunk_take_bounded_memory():
    dealt = random.Random(5)
    texts = [dealt.randbytes(1 << 16) for _ in range(48)] + [b"abcabcabc" * 50, b"", b"abc"]
    want = collections.Counter()
    for part in kneser_ney._parts(texts):
        want.update(kneser_ney._grams(part)[0].tolist())
    tracemalloc.start()
    keys, times = kneser_ney._distinct(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (keys[1:] > keys[:-1]).all() and dict(zip(keys.tolist(), times.tolist())) == want
    # Two numbers of eight bytes a gram are the result; sorting it with every part took 81.
    assert peak < 60 * len(keys)
