import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvec.functions import sums
from tallyvec.operators import cooccurrence
from tallyvec.operators.cooccurrence import count_pairs, head_and_tail, word_context
from tallyvec.operators.labels import count_label_words, index_labels, label_word
from tallyvec.operators.matrix import pack_rows, slice_matrix, sparse_encode, stack_labels
from tallyvec.operators.pmi import count_marginals, train_pmi
from tallyvec.operators.vocabulary import index_sentences, index_vocabulary, scan_vocabulary, word_counts
from tallyvec.sources.stage import write_stage
from tests.test_corpus import sents

TINY = [["a", "b", "a", "c"], ["b", "c"]]


def counted(df):
    return {(r["word"], r["context"]): r["cnt"] for r in df.collect()}


def test_vocabulary_breaks_ties_by_first_appearance(spark):
    vocab, n = index_vocabulary(sents(spark, TINY), 2)
    assert n == 3
    assert [tuple(r) for r in vocab.orderBy("idx").collect()] == [(0, "a", 2), (1, "b", 2), (2, "c", 2)]
    assert scan_vocabulary(sents(spark, TINY), 3).count() == 0


def test_vocabulary_does_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    corpus = sents(spark, [[f"w{rng.randint(0, 40)}" for _ in range(20)] for _ in range(60)])
    one = index_vocabulary(corpus.coalesce(1), 2)[0].orderBy("idx").collect()
    many = index_vocabulary(corpus.repartition(8), 2)[0].orderBy("idx").collect()
    assert one == many


def test_sentence_index(spark):
    rows = [(7, 0, []), (7, 1, ["a"]), (2, 0, ["a"]), (9, 0, [])]
    corpus = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>")
    indexed, total = index_sentences(corpus)
    got = sorted((r["doc_id"], r["sent_no"], r["i_sent"]) for r in indexed.collect())
    assert (got, total) == ([(2, 0, 0), (7, 0, 1), (7, 1, 2), (9, 0, 3)], 4)


def test_word_context_fixture(spark):
    vocab, n = index_vocabulary(sents(spark, TINY), 1)
    fixed = {"aa": 2, "ab": 2, "ac": 1, "ba": 2, "bc": 2, "ca": 1, "cb": 2}
    dynamic = {"aa": 1.0, "ab": 2.0, "ac": 1.0, "ba": 2.0, "bc": 1.5, "ca": 1.0, "cb": 1.5}
    for size in (n, None):
        got = counted(word_context(sents(spark, TINY), vocab, 2, False, n_vocab=size))
        assert got == {tuple(k): v for k, v in fixed.items()}
        got = counted(word_context(sents(spark, TINY), vocab, 2, True, n_vocab=size))
        assert got == {tuple(k): v for k, v in dynamic.items()}


def test_unknown_words_keep_their_place(spark):
    corpus = sents(spark, [["a", "x", "b"], [], ["a"]])
    vocab = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "idx int, word string, cnt long")
    assert counted(word_context(corpus, vocab, 1, n_vocab=2)) == {}
    assert counted(word_context(corpus, vocab, 2, False, n_vocab=2)) == {("a", "b"): 1, ("b", "a"): 1}


def test_row_words_may_be_unknown(spark):
    corpus = sents(spark, [["x", "a", "y"], ["b"]])
    vocab = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "idx int, word string, cnt long")
    rows = spark.createDataFrame([("x",), ("z",)], "word string")
    assert counted(word_context(corpus, vocab, 5, False, row_words=rows)) == {("x", "a"): 1}
    assert counted(word_context(corpus, vocab, 5, False, row_words=rows.limit(0))) == {}


def replay(sentences, vocab, window, min_count, prune_point):
    """Brute force over exact fractions of the window."""
    counts = defaultdict(int)
    for i_sent, words in enumerate(sentences):
        if min_count > 1 and i_sent % prune_point == 0:
            counts = defaultdict(int, {k: v for k, v in counts.items() if v >= min_count * window})
        for i, word in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if i != j and word in vocab and words[j] in vocab:
                    counts[word, words[j]] += window - abs(i - j) + 1
    return {k: v / window for k, v in counts.items()}


def test_block_pruning_after_a_hold_out(spark):
    rng = random.Random(7)
    lists = [[f"w{rng.randint(0, 9)}" for _ in range(6)] for _ in range(40)]
    rows = [(i // 20, i % 20, words) for i, words in enumerate(lists)]  # gaps within documents
    whole = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>")
    vocab, n = index_vocabulary(whole, 3)
    known = {r["word"] for r in vocab.collect()}
    left = [words for words in lists if "w4" not in words]
    kept = whole.where("not array_contains(words, 'w4')")
    got = counted(word_context(kept, vocab, 3, True, 2, 5, n_vocab=n))
    want = {k: v for k, v in replay(left, known, 3, 2, 5).items() if v}
    assert len(left) not in (0, len(lists))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("min_count,prune_point", [(1, 10), (2, 7), (3, 10), (2, 1000)])
def test_block_pruning_against_a_replay(spark, min_count, prune_point):
    rng = random.Random(min_count)
    lists = [
        [f"w{min(rng.randint(0, 12), rng.randint(0, 12))}" for _ in range(rng.randint(0, 9))]
        for _ in range(45)
    ]
    vocab, n = index_vocabulary(sents(spark, lists), 3)
    known = {r["word"] for r in vocab.collect()}
    for size in (n, None):
        got = counted(
            word_context(sents(spark, lists), vocab, 3, True, min_count, prune_point, n_vocab=size)
        )
        want = replay(lists, known, 3, min_count, prune_point)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k]) for k in want)


def test_surviving_units_fixture(spark):
    def left(units, last):
        rows = [(0, 0, b, u) for b, u in enumerate(units)]
        counts = spark.createDataFrame(rows, "a int, b int, block int, units long")
        return [r["units"] for r in cooccurrence._surviving_units(counts, ["a", "b"], 5, last).collect()]

    assert left([2, 2, 4, 1], 3) == [1]
    assert left([3, 3], 1) == [3]
    assert left([5, 1], 1) == [6]
    assert left([2], 0) == [2]
    assert left([2, 4], 2) == []


def test_one_word_in_a_third_of_all_tokens(spark):
    lists = [["hot", f"w{i % 50}", "hot"] for i in range(300)]
    vocab, n = index_vocabulary(sents(spark, lists), 1)
    pairs = {(r["row"], r["col"]): r["units"] for r in count_pairs(sents(spark, lists), vocab, n, 2, False).collect()}
    assert pairs[0, 0] == 600
    assert sum(pairs.values()) == 300 * 6


def labelled(spark):
    rows = [(0, 0, ["L1", "L2"], ["x", "y"]), (1, 0, ["L1"], ["x"]), (2, 0, ["__doc2__"], ["z"])]
    return spark.createDataFrame(rows, "doc_id long, sent_no int, labels array<string>, words array<string>")


def test_label_words(spark):
    vocab = spark.createDataFrame([(0, "x", 2), (1, "y", 1)], "idx int, word string, cnt long")
    got = {(r["label"], r["word"]): r["cnt"] for r in label_word(labelled(spark), vocab, 2).collect()}
    assert got == {("L1", "x"): 2, ("L1", "y"): 1, ("L2", "x"): 1, ("L2", "y"): 1}
    labels, n = index_labels(count_label_words(labelled(spark), vocab, 2))
    assert ([tuple(r) for r in labels.orderBy("idx").collect()], n) == ([(0, "L1"), (1, "L2")], 2)


def test_repeated_labels_count_repeatedly(spark):
    rows = [(0, 0, ["L", "L"], ["x", "x"])]
    corpus = spark.createDataFrame(rows, "doc_id long, sent_no int, labels array<string>, words array<string>")
    vocab = spark.createDataFrame([(0, "x", 2)], "idx int, word string, cnt long")
    assert [r["cnt"] for r in label_word(corpus, vocab, 1).collect()] == [4]


def matrix(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for r, c, v in cells], "row int, col int, v double")


def test_matrix_operators(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, key string")
    counts = spark.createDataFrame([("a", "b", 2), ("b", "b", 1)], "r string, c string, n long")
    encoded = sparse_encode(counts, index, index)
    assert sorted(map(tuple, encoded.collect())) == [(0, 1, 2.0), (1, 1, 1.0)]
    unknown = spark.createDataFrame([("a", "q", 2)], "r string, c string, n long")
    with pytest.raises(Exception, match="no index for col key q"):
        sparse_encode(unknown, index, index).collect()

    packed = pack_rows(matrix(spark, [(0, 2, 5), (0, 1, 4), (3, 0, 1)])).orderBy("row").collect()
    assert [tuple(r) for r in packed] == [(0, [1, 2], [4.0, 5.0]), (3, [0], [1.0])]

    stacked = stack_labels(matrix(spark, [(0, 1, 2)]), matrix(spark, [(0, 1, 7)]), 2)
    assert sorted(map(tuple, stacked.collect())) == [(0, 1, 2.0), (1, 2, 7.0), (2, 1, 7.0)]

    kept = spark.createDataFrame([(1, 0), (3, 1)], "old int, idx int")
    sliced = slice_matrix(matrix(spark, [(1, 3, 4), (1, 2, 5), (0, 3, 6)]), kept, kept)
    assert [tuple(r) for r in sliced.collect()] == [(0, 1, 4.0)]


def test_pmi_fixture(spark):
    vocab, n = index_vocabulary(sents(spark, TINY), 1)
    ww = count_pairs(sents(spark, TINY), vocab, n, 2, False).withColumnRenamed("units", "v")
    names = {r["idx"]: r["word"] for r in vocab.collect()}

    def got(**options):
        pmi, _ = train_pmi(ww, n_rows=n, n_cols=n, **options)
        return {names[r["row"]] + names[r["col"]]: round(r["pmi"], 6) for r in pmi.collect()}

    own = {"ab": 0.182322, "ba": 0.182322, "bc": 0.693147, "cb": 0.693147}
    assert got() == own
    counts = count_marginals(vocab)
    smooth = {"aa": 0.182322, "ab": 0.182322, "ba": 0.405465, "bc": 0.405465, "cb": 0.693147}
    assert got(py=counts, beta=0.75) == smooth
    # A cut-off, not a shift.
    assert got(min_pmi=math.log(1.5)) == {"bc": 0.693147, "cb": 0.693147}


def test_pmi_alpha_and_empty_contexts(spark):
    m = matrix(spark, [(0, 0, 1), (0, 1, 1), (1, 1, 0)])
    py = spark.createDataFrame([(0, 0.25), (1, 0.0)], "col int, p double")
    pmi, _ = train_pmi(m, py, alpha=0.05)
    assert [(r["row"], r["col"], round(r["pmi"], 9)) for r in pmi.collect()] == [
        (0, 0, round(math.log(0.5 / 0.30), 9))
    ]


@pytest.mark.parametrize("head_bytes", [1, 120, 400])
def test_rare_words_are_looked_up_by_a_join(spark, head_bytes):
    """A word with a third of the tokens, and a vocabulary of which only a part may be broadcast."""
    rng = np.random.default_rng(3)
    lines = [["hot" if rng.random() < 0.33 else f"w{rng.integers(0, 40)}" for _ in range(25)] for _ in range(60)]
    sents = spark.createDataFrame([(i, 0, w) for i, w in enumerate(lines)], "doc_id long, sent_no int, words array<string>")
    vocab, n_vocab = index_vocabulary(sents, 3)
    head, tail = head_and_tail(vocab, head_bytes)
    assert head.count() >= 1 and tail.count() >= n_vocab - 11
    assert head.orderBy("idx").first()["word"] == "hot"
    whole = count_pairs(sents, vocab, n_vocab, 3)
    parts = count_pairs(sents, vocab, n_vocab, 3, head_bytes=head_bytes)
    assert sorted(parts.collect()) == sorted(whole.collect()) and whole.count() > 100


def test_sentences_are_numbered_where_they_are(spark):
    """Neither an exchange nor a sort of the words; numbers without gaps after a filter."""
    rows = [(d, n, [f"a{d}", f"b{n}"]) for d in range(20) for n in range(d % 5 + 1)]
    sents = write_stage(spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>"), "numbered")
    for kept in (sents, sents.filter("(doc_id + sent_no) % 3 <> 0")):
        indexed, total = index_sentences(kept)
        got = [(r.doc_id, r.sent_no, r.i_sent) for r in indexed.orderBy("doc_id", "sent_no").collect()]
        assert [i for _, _, i in got] == list(range(total)) == list(range(kept.count()))
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    texts, numbers = plan.split("BroadcastExchange", 1)
    assert "words" in texts and "Exchange" not in texts and "Sort" not in texts and "words" not in numbers


def test_counts_of_a_block_do_not_move(spark):
    """With many blocks the sentences are dealt out by block: one shuffle of counts less, with the same result."""
    words = [["a", "b"], ["a", "b", "c"], ["b", "c"], ["c", "a"]]
    lines = spark.createDataFrame([(i, 0, words[i * i % 4]) for i in range(200)], "doc_id long, sent_no int, words array<string>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, word string")
    found = {}
    for prune_point in (4, 4 * 200):
        counts = word_context(lines, vocab, 2, False, 3, prune_point, n_vocab=3)
        found[prune_point] = {(r["word"], r["context"]): r["cnt"] for r in counts.collect()}
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(a#" in plan and "block#" in plan) == (prune_point == 4)
        keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(a#" in line]
        assert not any("block#" in line.split("),")[0] for line in keys)
    near = {}
    for i in range(200):
        line = words[i * i % 4]
        for x in range(len(line)):
            for y in range(max(0, x - 2), min(len(line), x + 3)):
                if x != y:
                    blocks = near.setdefault((line[x], line[y]), {})
                    blocks[i // 4] = blocks.get(i // 4, 0) + 1
    want = {}
    for pair, blocks in near.items():
        starts = [b for b, n in blocks.items() if n >= 3 or b == 49]
        if starts:
            want[pair] = float(sum(n for b, n in blocks.items() if b >= min(starts)))
    assert found[4] == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_lines(n=80):
    rng = random.Random(11)
    return [[f"w{min(rng.randint(0, 30), rng.randint(0, 30))}" for _ in range(rng.randint(0, 12))] for _ in range(n)]


@pytest.mark.parametrize("head_bytes", [100, 1 << 20])
@pytest.mark.parametrize("min_count", [1, 2])
def test_pairs_are_added_up_in_bounded_stretches(spark, monkeypatch, head_bytes, min_count):
    """Stretches shorter than a sentence, sentences of one key, null words; no aggregation before the shuffle."""
    for name, size in (("TAKEN", 5), ("HELD", 7), ("SENT", 3), ("CODED", 20)):
        monkeypatch.setattr(sums, name, size)
    lines = random_lines()
    rows = [(0, i, [*words, None, "w0"]) for i, words in enumerate(lines)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>").repartition(3)
    vocab, n = index_vocabulary(sents.withColumn("words", F.array_compact("words")), 3)
    known = {r["word"] for r in vocab.collect()}
    counts = word_context(sents, vocab, 3, True, min_count, 10, n_vocab=n, head_bytes=head_bytes)
    want = replay([words for _, _, words in rows], known, 3, min_count, 10)
    assert counted(counts) == pytest.approx({k: v for k, v in want.items() if v})
    if min_count == 1:
        same_key = sents.withColumn("sent_no", F.lit(0))
        assert counted(word_context(same_key, vocab, 3, n_vocab=n, head_bytes=head_bytes)) == pytest.approx(want)
        plan = plan_of(count_pairs(sents, vocab, n, head_bytes=head_bytes))
        after, _, before = plan.partition("MapInArrow" if head_bytes > 100 else "FlatMapCoGroupsInArrow")
        assert "HashAggregate" in after and "HashAggregate" not in before
        assert after.rindex("HashAggregate") < after.index("Exchange hashpartitioning")


def test_rare_words_move_once_per_chunk(spark, monkeypatch):
    """Words that are not broadcast are shuffled by chunk and word, not by token."""
    chunks = []
    monkeypatch.setattr(cooccurrence, "write_stage", lambda df, name: chunks.append(write_stage(df, name)) or chunks[-1])
    rows = [(i, 0, ["x", "y", "x", "z"] * 5) for i in range(40)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>").coalesce(2)
    vocab, n = index_vocabulary(sents, 1)
    count_pairs(sents, vocab, n, head_bytes=40).collect()
    assert chunks[0].filter("word is not null").count() == 3 * 2


def test_words_and_labels_are_counted_in_bounded_stretches(spark, monkeypatch):
    monkeypatch.setattr(sums, "COUNTED", 15)
    monkeypatch.setattr(sums, "SENT", 3)
    lines, rng = random_lines(), random.Random(5)
    rows = [(i // 2 % 30, i % 2, rng.choices(["a", "b", "c", f"d{i}"], k=i % 4), words) for i, words in enumerate(lines)]
    rows += [(-3, 0, ["c", "b"], ["w0", "w1"]), (900, 0, None, ["w0"]), (901, 0, ["a"], None)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_no int, labels array<string>, words array<string>").repartition(4)

    def place(doc, sent, pos):
        return doc * 5 * 10**18 + (sent << 31 | pos)

    words, labels = {}, {}
    for doc, sent, named, line in rows:
        for pos, word in enumerate(line or []):
            words.setdefault(word, []).append(place(doc, sent, pos))
            for at, label in enumerate(named or []):
                if word != "w3":
                    labels.setdefault((label, word), []).append(place(doc, sent, at))
    counts = word_counts(sents)
    assert {r["word"]: (r["cnt"], int(r["first"])) for r in counts.collect()} == {k: (len(v), min(v)) for k, v in words.items()}
    vocab = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words)) if w != "w3"], "idx int, word string")
    found = count_label_words(sents, vocab, 40)
    names = {r["idx"]: r["word"] for r in vocab.collect()}
    got = {(r["label"], names[r["col"]]): (r["cnt"], int(r["first"])) for r in found.collect()}
    assert got == {k: (len(v), min(v)) for k, v in labels.items()}
    for df in (counts, found):
        after, _, before = plan_of(df.select("*")).partition("MapInArrow")
        assert "HashAggregate" in after and "HashAggregate" not in before
        assert after.rindex("HashAggregate") < after.index("Exchange hashpartitioning")


def test_sums_of_keys_that_fit_no_single_number():
    big = np.array([2**40, 1, 2**40, 2**40])
    keys, values = sums.sum_by_key([big, big[::-1].copy()], np.array([1, 2, 3, 4]))
    assert [list(k) for k in keys] == [[1, 2**40, 2**40], [2**40, 1, 2**40]]
    assert list(values) == [2, 3, 5]


def test_sums_of_pairs_travel_packed(spark):
    """A few bytes a sum, whatever the keys; with many blocks neither sentences nor counts of each block move as rows."""
    rng = np.random.default_rng(1)
    keys, values = sums.sum_by_key(list(np.sort(rng.integers(0, 5_000, (2, 200_000)), axis=0)), rng.integers(1, 4, 200_000))
    wide = [np.array([0, 5, 2**45]), np.array([2**40, 2**41, 2**46]), np.array([7, 2**30, 3])]
    for own, units in ((keys, values), (wide, np.array([1, 2**50, 3])), ([k[:3] for k in keys], values[:3])):
        for groups in (1, 3, 300):
            rows = [r for batch in sums.pack_sums(own, units, groups) for r in batch.to_pylist()]
            assert len({(r["a"], r["b"]) for r in rows}) == len(rows)
            found = sums.total_sums(sums.unpack_sums(r["sums"], r["a"], r["b"], groups) for r in rows)
            assert all((x == y).all() for x, y in zip([*own, units], [*found[0], found[1]]))
            if len(units) > 3 and groups < 300:
                assert sum(len(r["sums"]) for r in rows) < 4 * len(units)
    lines = spark.createDataFrame([(i, 0, ["a", "b", "a"]) for i in range(200)], "doc_id long, sent_no int, words array<string>")
    vocab, n = index_vocabulary(lines, 1)
    counts = count_pairs(lines, vocab, n, 2, False, 3, 4)
    assert {(r["row"], r["col"]): r["units"] for r in counts.collect()} == {(0, 0): 400, (0, 1): 400, (1, 0): 400}
    plan = plan_of(counts)
    assert "hashpartitioning(block#" not in plan and "sums#" in plan


def test_three_million_words_are_looked_up_where_the_pairs_are(spark):
    """Neither the words of the text nor the pairs are shuffled to a vocabulary of such a size."""
    lines = spark.createDataFrame([(i, 0, ["a", "b", f"c{i % 3}"]) for i in range(30)], "doc_id long, sent_no int, words array<string>")
    vocab, n = index_vocabulary(lines, 1)
    rows = spark.createDataFrame([("a",)], "word string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for chosen in (None, rows):
            large = word_context(lines, vocab, 2, row_words=chosen, n_vocab=3_000_000, n_rows=1)
            assert "SortMergeJoin" not in plan_of(large)
            assert counted(large) == counted(word_context(lines, vocab, 2, row_words=chosen, n_vocab=n, n_rows=1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
