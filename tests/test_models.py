import ast
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvec.operators.keywords import proportion_keywords
from tallyvec.operators.subwords import subword_counts, subword_table
from tallyvec.plans.doc2vec import train_label_vectors
from tallyvec.plans.reconstruction import (
    common_vectors,
    hit_at_k,
    infer_held_out_words,
    infer_masked_words,
    neighbour_report,
    reconstruction_accuracy,
    restrict_vectors,
    word_neighbours,
)
from tallyvec.plans.word2vec import EmbeddingParams, pair_matrix, train_word_vectors
from tallyvec.sources.corpus import labelled_sentences, tokenize_sentences
from tallyvec.sources.models import load_model, save_model
from tallyvec.sources.neighbours import read_neighbour_lists, write_neighbour_lists
from tests.test_counting import matrix
from tests.test_vectors import array_of

SF = "/root/testdata/sf0.001"
PARAMS = EmbeddingParams(size=12, min_count=20, negative=1, dynamic_weight=True, n_iter=3, min_cooccurrence=1)


def test_keywords_fixture(spark):
    scores = matrix(spark, [(0, 0, 3), (0, 1, 1), (1, 0, 1), (1, 1, 1), (1, 2, 2)])
    got = [(r["row"], r["rank"], r["col"], r["score"]) for r in proportion_keywords(scores).collect()]
    assert sorted(got) == [(0, 1, 0, 0.75), (0, 2, 1, 0.5), (1, 1, 2, 1.0), (1, 2, 1, 0.5)]
    assert proportion_keywords(matrix(spark, [(0, 0, 3)])).count() == 0
    best = proportion_keywords(scores, topk=1).collect()
    assert sorted((r["row"], r["col"]) for r in best) == [(0, 0), (1, 2)]


def test_stopwords_leave_before_the_last_cut(spark):
    scores = matrix(spark, [(0, 0, 3), (0, 1, 1), (1, 0, 1), (1, 1, 1), (1, 2, 2)])
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, word string")
    stop = spark.createDataFrame([("a",)], "word string")
    for rule in ({"stopwords": stop}, {"is_stopword": lambda w: w == "a"}):
        got = proportion_keywords(scores, topk=1, words=words, **rule).collect()
        assert sorted((r["row"], r["rank"], r["word"]) for r in got) == [(0, 1, "b"), (1, 1, "c")]


def test_subwords_fixture(spark):
    words = spark.createDataFrame([("ab", 2), ("a", 3)], "word string, cnt long")
    rows = subword_table(words).orderBy("word", "pos").collect()
    assert [r["subword"] for r in rows if r["word"] == "ab"] == ["<ab>", "<ab", "ab>", "<ab>"]
    assert [r["subword"] for r in rows if r["word"] == "a"] == ["<a>", "<a>"]
    counts = {r["subword"]: r["cnt"] for r in subword_counts(words).collect()}
    assert counts == {"<ab>": 4, "<ab": 2, "ab>": 2, "<a>": 6}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return tokenize_sentences(docs.select("doc_id", "text"))


@pytest.fixture(scope="module")
def model(corpus):
    return train_word_vectors(corpus, PARAMS)


def test_training_and_look_up(model):
    assert model.n_vocab == model.wv.count() == model.transformer.count()
    assert model["the"].count() == 1 and model["nobody"].count() == 0
    assert model.similar_words("the", 5).count() == 5
    assert model.similar_words("nobody").count() == 0
    with pytest.raises(ValueError):
        model.similar_words_from_vector([1.0])
    with pytest.raises(ValueError):
        EmbeddingParams(beta=0)


def test_known_words_are_inferred_where_they_were_trained(model, corpus):
    """With the same text, threshold and counts, inference repeats training."""
    words = [r["word"] for r in model.vocab.filter("idx < 20").collect()]
    inferred, extended = model.infer_words(corpus, [*words, "unheardof"])
    trained = {r["word"]: np.array(r["vec"]) for r in model.wv.filter("idx < 20").collect()}
    got = {r["word"]: np.array(r["vec"]) for r in inferred.collect()}
    assert all(np.allclose(got[w], trained[w], atol=1e-6) for w in words)
    assert not got["unheardof"].any()
    assert extended.n_words == model.n_words + 1
    last = extended.wv.filter(f"idx = {model.n_words}").collect()
    assert [r["word"] for r in last] == ["unheardof"]


def test_label_vectors(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.concat_ws("\t", "lang", "text")
    corpus = labelled_sentences(docs.select("doc_id", text.alias("text")))
    model = train_label_vectors(corpus, PARAMS)
    assert model.n_labels == 4 and model.dv.count() == 4
    inferred = model.infer_labels(corpus)
    assert np.allclose(
        array_of(inferred.select("idx", "vec"), 4), array_of(model.dv.select("idx", "vec"), 4)
    )
    first = model.similar_labels(inferred.select("idx", "vec"), 1).collect()
    assert all(r["query"] == r["id"] for r in first)
    keywords = model.label_keywords(corpus)
    assert keywords.select("label").distinct().count() == 4
    influence = model.label_influence(corpus)
    assert influence.count() == model.n_vocab and influence.filter("influence < 0").count() == 0


def test_reconstruction(spark, corpus, model):
    hidden = model.vocab.filter("idx % 40 = 7").select("word")
    n_hidden = hidden.count()
    ww = pair_matrix(corpus, model.vocab, model.n_vocab, PARAMS)
    masked = infer_masked_words(model.vocab, ww, hidden, PARAMS)
    assert masked.count() == model.n_vocab
    base = word_neighbours(model.wv, hidden, PARAMS.size, 30)
    again = word_neighbours(masked, hidden, PARAMS.size, 30)
    shares = {r["k"]: r["share"] for r in hit_at_k(base, again, hidden).collect()}
    assert shares[1] <= shares[3] <= shares[30] and shares[30] > 0.5

    held_out = infer_held_out_words(corpus, hidden, PARAMS)
    assert held_out.wv.join(hidden, "word").count() == n_hidden


def test_reports(spark):
    columns = "query string, rank int, word string, sim double"
    answer = spark.createDataFrame(
        [("q", 1, "a", 0.9), ("q", 2, "b", 0.8), ("q", 3, "c", 0.7), ("p", 1, "z", 0.5), ("o", 1, "a", 0.9)],
        columns,
    )
    candidate = spark.createDataFrame(
        [("q", 1, "b", 0.9), ("q", 2, "a", 0.8), ("q", 3, "c", 0.7), ("p", 1, "y", 0.05), ("o", 1, "a", 1.0)],
        columns,
    )
    got = {r["k"]: (r["correct"], r["total"]) for r in reconstruction_accuracy(answer, candidate).collect()}
    assert got == {1: (0, 1), 3: (1, 1), 5: (1, 1)}
    masked = spark.createDataFrame([("q",), ("p",), ("nobody",)], "word string")
    hits = {r["k"]: (r["hits"], r["total"]) for r in hit_at_k(answer, candidate, masked).collect()}
    assert hits[1] == (0, 3) and hits[3] == (1, 3)
    counts = spark.createDataFrame([(w, i) for i, w in enumerate("abczyqpo")], "word string, cnt long")
    assert neighbour_report(answer, candidate, counts).count() == 5


def test_aligned_vocabularies(spark):
    full = spark.createDataFrame([(0, "b", [1.0]), (1, "a", [2.0])], "idx int, word string, vec array<double>")
    part = spark.createDataFrame([(0, "a")], "idx int, word string")
    assert [tuple(r) for r in restrict_vectors(full, part).collect()] == [(0, "a", [2.0])]
    with pytest.raises(Exception, match="unknown word q"):
        restrict_vectors(full, spark.createDataFrame([(0, "q")], "idx int, word string")).collect()
    shared = common_vectors(full, full).select("idx", "word").orderBy("idx").collect()
    assert [tuple(r) for r in shared] == [(0, "a"), (1, "b")]


def test_models_come_back(spark, model, corpus, tmp_path):
    full, part = f"{tmp_path}/full", f"{tmp_path}/part"
    with pytest.raises(FileNotFoundError):
        load_model(spark, full)
    with pytest.raises(FileNotFoundError):
        save_model(model, part, base=full)
    assert save_model(model, full) == 0
    again = load_model(spark, full)
    assert (again.params, again.n_vocab, again.sigma) == (model.params, model.n_vocab, model.sigma)
    assert sorted(map(str, again.wv.collect())) == sorted(map(str, model.wv.collect()))
    words = ["the", "unheardof"]

    def inferred(m):
        return {(r.word, d): x for r in m.infer_words(corpus, words)[0].collect() for d, x in enumerate(r.vec)}

    want = pytest.approx(inferred(model))
    assert inferred(again) == want
    # A partial model holds its own words only, and infers with what the full one has.
    few = replace(model, wv=model.wv.filter("idx < 5"))
    assert save_model(few, part, base=full) == 0 and save_model(few, part, base=full) == 1
    half = load_model(spark, part)
    assert half.wv.count() == 5 and half.sigma == model.sigma
    assert inferred(half) == want
    with pytest.raises(ValueError):
        save_model(half, f"{tmp_path}/third", base=part)
        load_model(spark, f"{tmp_path}/third")
    # Tables without a manifest are no model.
    model.wv.write.parquet(f"{tmp_path}/broken/wv-1")
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{tmp_path}/broken")


def test_label_models_come_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "concat(lang, '\t', text) AS text").limit(60)
    model = train_label_vectors(labelled_sentences(docs), EmbeddingParams(size=4, min_count=5, window=2))
    save_model(model, f"{tmp_path}/labels")
    again = load_model(spark, f"{tmp_path}/labels")
    assert type(again) is type(model) and again.n_labels == model.n_labels
    assert sorted(map(str, again.dv.collect())) == sorted(map(str, model.dv.collect()))
    sentences = labelled_sentences(docs)
    assert sorted(map(str, again.infer_labels(sentences).collect())) == sorted(map(str, model.infer_labels(sentences).collect()))


def test_neighbour_lists_come_back(spark, tmp_path):
    words = ["plain", "it's", 'say"so', "both'\"", "back\\slash", "ends\\", "[(", "(x, 1)", "é"]
    rows = [("s", w, i + 1, v, (i - 3) / 7) for w in words for i, v in enumerate(words) if v != w]
    rows += [("t u", "plain", 1, "it's", 1e-9)]
    table = spark.createDataFrame(rows, "set string, query string, rank int, word string, sim double")
    table = table.withColumn("rank", F.row_number().over(Window.partitionBy("set", "query").orderBy("rank")))
    write_neighbour_lists(table, f"{tmp_path}/lists")
    assert sorted(read_neighbour_lists(spark, f"{tmp_path}/lists").collect()) == sorted(table.collect())
    lines = spark.read.text(f"{tmp_path}/lists/set=s").collect()
    for line in lines:  # as Python reads it
        query, pairs = line.value.split(",[", 1)
        assert [p[0] for p in ast.literal_eval("[" + pairs)] == [w for w in words if w != query]
