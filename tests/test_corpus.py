from pyspark.sql import functions as F

from tallyvec.sources.corpus import (
    corpus_length,
    distinct_words,
    drop_stopwords,
    holdout_sentences,
    labelled_sentences,
    limit_documents,
    read_text_corpus,
    read_word_list,
    scan_corpus,
    tokenize_sentences,
)
from tallyvec.sources.store import export_words, load_tables, save_tables


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sents(spark, lists):
    rows = [(i, 0, words) for i, words in enumerate(lists)]
    return spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>")


def listed(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id", "sent_no").select(*columns).collect()]


def test_scan_lowercases_strips_and_drops_blank(spark):
    found = scan_corpus(docs(spark, ["  A b\x1c", " \t ", "C"])).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(0, "a b"), (2, "C".lower())]
    kept = scan_corpus(docs(spark, [" A "]), lowercase=False).collect()
    assert kept[0]["text"] == "A"


def test_whitespace_is_that_of_python(spark):
    text = "".join("x" if 0xD800 <= c < 0xE000 else chr(c) for c in range(1, 0x3100))
    words = tokenize_sentences(docs(spark, [text]), separator="\x00", lowercase=False).collect()
    assert words[0]["words"] == text.split()


def test_limit_counts_blank_documents(spark):
    corpus = docs(spark, ["", "a", "b"])
    assert [r["text"] for r in scan_corpus(limit_documents(corpus, 2)).collect()] == ["a"]
    assert corpus_length(corpus).first()["n_docs"] == 3
    assert limit_documents(corpus, -1).count() == 3


def test_sentences_keep_whitespace_only_pieces(spark):
    got = listed(tokenize_sentences(docs(spark, ["a b\n \n\nc"])), "sent_no", "words")
    assert got == [(0, ["a", "b"]), (1, []), (2, ["c"])]
    got = listed(tokenize_sentences(docs(spark, ["a b  c"]), separator="  "), "words")
    assert got == [(["a", "b"],), (["c"],)]


def test_labelled_sentences(spark):
    corpus = docs(spark, ["L1 L2\tx y", "L1\tx\nq\tz", "z", "\tw v"])
    got = listed(labelled_sentences(corpus, lowercase=False), "doc_id", "sent_no", "labels", "words")
    assert got == [
        (0, 0, ["L1", "L2"], ["x", "y"]),
        (1, 0, ["L1"], ["x"]),
        (1, 1, ["L1"], ["q"]),
        (1, 2, ["L1"], ["z"]),
        (2, 0, ["__doc2__"], ["z"]),
        # The leading tab is stripped with the other whitespace.
        (3, 0, ["__doc3__"], ["w", "v"]),
    ]


def test_holdout(spark):
    corpus = sents(spark, [["a", "b", "a", "c"], ["b", "c"], []])
    for terms, kept in ((["c"], [2]), (["a"], [1, 2])):
        frame = spark.createDataFrame([(t,) for t in terms], "word string")
        for given in (terms, frame):
            train = holdout_sentences(corpus, given, True)
            infer = holdout_sentences(corpus, given, False)
            assert sorted(r["doc_id"] for r in train.collect()) == kept
            assert sorted(r["doc_id"] for r in infer.collect()) == [i for i in range(3) if i not in kept]


def test_stopwords_close_the_gap_and_keep_repeats(spark):
    corpus = sents(spark, [["a", "the", "a", "b"]])
    assert drop_stopwords(corpus, ["the"]).first()["words"] == ["a", "a", "b"]
    rule = lambda w: F.length(w) > 1
    assert drop_stopwords(corpus, is_stopword=rule).first()["words"] == ["a", "a", "b"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("three\nfour", encoding="utf-8")
    got = sorted(tuple(r) for r in read_text_corpus(spark, str(tmp_path)).collect())
    assert got == [(0, "one"), (1, ""), (2, "two"), (3, "three"), (4, "four")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)), encoding="utf-8")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4096")
    try:
        corpus = read_text_corpus(spark, str(path))
        assert corpus.rdd.getNumPartitions() > 4
        assert all(r["text"] == f"line {r['doc_id']}" for r in corpus.collect())
        assert corpus.select("doc_id").distinct().count() == 5000
    finally:
        spark.conf.set(size, before)


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text(" clichès \n\nfilm\nfilm\n", encoding="utf-8")
    assert sorted(r["word"] for r in read_word_list(spark, str(path)).collect()) == ["clichès", "film"]
    lines = spark.createDataFrame([(" x",), ("",), ("x ",)], "word string")
    assert [r["word"] for r in distinct_words(lines).collect()] == ["x"]


def test_store(spark, tmp_path):
    vocab = spark.createDataFrame([(1, "b", 2), (0, "a", 3)], "idx int, word string, cnt long")
    full, part = str(tmp_path / "full"), str(tmp_path / "part")
    save_tables({"vocab": vocab, "other": vocab.limit(1)}, full)
    save_tables({"other": vocab}, part)
    loaded = load_tables(spark, part, ["vocab", "other"], fallback=full)
    assert sorted(map(tuple, loaded["vocab"].collect())) == [(0, "a", 3), (1, "b", 2)]
    assert loaded["other"].count() == 2
    export_words(vocab, str(tmp_path / "words"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "words")).collect()] == ["a", "b"]
