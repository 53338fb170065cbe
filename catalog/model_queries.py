"""Factorisation, training and inference.

Inference is checked with a fixed stand-in for the trained transformer, which has exact
SQL; training itself is checked by its row counts here and by invariants in the tests.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog.common import (
    BASE_SQL,
    BENCHMARK_WORDS_SQL,
    CONVERSATIONS_SQL,
    DIMS,
    DW_SQL,
    ENCODED_SQL,
    LABELLED_SQL,
    MIN_COUNT,
    WINDOW,
    benchmark_words,
    conversation_sentences,
    label_counts,
    labelled,
    once,
    pairs,
    pmi_sql,
    r,
    rounded,
    sentences,
    sents_sql,
    stand_in,
    stand_in_sql,
    table,
    vector_cells,
    vocab_sql,
    vocabulary,
)
from catalog.counting_queries import CUT, MODEL_PY_SQL, NEW_ROWS_SQL, THRESHOLD, model_contexts, new_rows
from tallyvec.operators.factor import fill_rows, representation, sparse_dot, truncated_svd
from tallyvec.operators.pmi import train_pmi
from tallyvec.plans.doc2vec import label_matrix, matrix_influence, train_label_vectors, train_word_transformer
from tallyvec.plans.reconstruction import infer_held_out_words, infer_masked_words
from tallyvec.plans.word2vec import EmbeddingParams, WordVectors, append_words, infer_rows, train_word_vectors
from tallyvec.operators.influence import mean_influence
from tallyvec.sources.corpus import labelled_sentences
from tallyvec.sources.models import load_model, save_model
from tallyvec.sources.stage import shared_folder, spread, write_stage

# As published for the example corpus, with a smaller size for the small test tables.
PARAMS = EmbeddingParams(size=50, window=3, min_count=10, negative=10, beta=0.75)


def trained_pmi(spark, sf_dir):
    def make():
        n_vocab = vocabulary(spark, sf_dir)[1]
        pmi, _ = train_pmi(
            pairs(spark, sf_dir), model_contexts(spark, sf_dir), THRESHOLD, n_rows=n_vocab, n_cols=n_vocab
        )
        return write_stage(pmi, "trained-pmi")

    return once(spark, sf_dir, "pmi", make)


def _factors(spark, sf_dir):
    n_vocab = vocabulary(spark, sf_dir)[1]
    return once(
        spark,
        sf_dir,
        "factors",
        lambda: truncated_svd(
            trained_pmi(spark, sf_dir), PARAMS.size, n_vocab, n_vocab, PARAMS.n_iter, value="pmi"
        ),
    )


def svd(spark, sf_dir):
    u, sigma, v = _factors(spark, sf_dir)
    sizes = spark.createDataFrame(list(enumerate(sigma)), "d int, sigma double")
    rows = v.select("col", F.posexplode("vec").alias("d", "x"))
    tops = rows.groupBy("d").agg(F.sum(F.col("x") * F.col("x")).alias("norm"))
    return tops.join(F.broadcast(sizes), "d")


def representation_transformer(spark, sf_dir):
    wv, transformer = representation(*_factors(spark, sf_dir))
    return wv.select(F.lit("word").alias("part"), F.col("row").alias("idx"), "vec").unionByName(
        transformer.select(F.lit("context").alias("part"), F.col("col").alias("idx"), "vec")
    )


def project_rows(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    projected = sparse_dot(trained_pmi(spark, sf_dir), stand_in(vocab), DIMS, n_vocab, value="pmi")
    return vector_cells(fill_rows(projected, n_vocab, DIMS), "row")


def projected_words(spark, sf_dir, n=17):
    """``wv(idx, word, vec)`` of the vocabulary under the stand-in transformer."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    projected = sparse_dot(trained_pmi(spark, sf_dir), stand_in(vocab, n), DIMS, n_vocab, value="pmi")
    vectors = fill_rows(projected, n_vocab, DIMS).withColumnRenamed("row", "idx")
    return vectors.join(F.broadcast(vocab.select("idx", "word")), "idx").select("idx", "word", "vec")


def word2vec_train(spark, sf_dir):
    return train_word_vectors(sentences(spark, sf_dir), PARAMS).wv


def word_lookup(spark, sf_dir):
    wv = projected_words(spark, sf_dir)
    return vector_cells(wv.join(benchmark_words(spark, sf_dir), "word"), "idx", "word")


def unseen_word_matrix(spark, sf_dir):
    """Words that never occur keep a row, without entries; it is shown as column -1."""
    rows, index, _ = new_rows(spark, sf_dir)
    cells = index.join(rows, "row", "left").fillna({"col": -1, "v": 0.0})
    return cells.select("row", "word", "col", rounded("v").alias("v"))


def inferred_words(spark, sf_dir):
    rows, index, n_rows = new_rows(spark, sf_dir)
    vocab, n_vocab = vocabulary(spark, sf_dir)
    contexts = model_contexts(spark, sf_dir)
    vectors = infer_rows(rows, n_rows, contexts, stand_in(vocab), n_vocab, DIMS)
    return vectors.join(index, "row").select("row", "word", "vec")


def infer_wordvec(spark, sf_dir):
    return vector_cells(inferred_words(spark, sf_dir), "row", "word")


def model_load(spark, sf_dir):
    """A full model and a partial one of other words are saved and loaded; the partial one infers, the full one is searched."""
    folder = f"{shared_folder(spark)}/tallyvec/models-{uuid.uuid4().hex}"
    vocab, n_vocab = vocabulary(spark, sf_dir)
    params = EmbeddingParams(size=DIMS, window=WINDOW, min_count=MIN_COUNT, dynamic_weight=True)
    full = WordVectors(
        params, vocab, n_vocab, model_contexts(spark, sf_dir), stand_in(vocab), projected_words(spark, sf_dir), n_vocab
    )
    # Both models are written from it, so it is made once.
    full = replace(full, wv=write_stage(full.wv, "full-words"))
    save_model(full, f"{folder}/full")
    rare = full.wv.where(F.col("idx") % 2 == 1)
    save_model(replace(full, wv=rare), f"{folder}/odd", base=f"{folder}/full")
    odd = load_model(spark, f"{folder}/odd")
    inferred, grown = odd.infer_words(conversation_sentences(spark, sf_dir), benchmark_words(spark, sf_dir))
    known = load_model(spark, f"{folder}/full").wv.join(grown.wv.select("word"), "word", "left_semi")
    return vector_cells(inferred, "row", "word").select(F.lit("inferred").alias("part"), "*").unionByName(
        vector_cells(known, "idx", "word").select(F.lit("known").alias("part"), F.col("idx").alias("row"), "word", "d", "x")
    )


def append_inferred(spark, sf_dir):
    # Both are read twice: to find the new words, and for the vectors.
    known = write_stage(projected_words(spark, sf_dir), "known-words")
    new = write_stage(inferred_words(spark, sf_dir), "new-words")
    wv, _ = append_words(known, vocabulary(spark, sf_dir)[1], new)
    return vector_cells(wv, "idx", "word")


def _label_params():
    return EmbeddingParams(size=50, window=3, min_count=10, beta=0.75)


def doc2vec_train(spark, sf_dir):
    model = train_label_vectors(labelled(spark, sf_dir), _label_params())
    return model.wv.select("idx", F.col("word").alias("name"), "vec").unionByName(
        model.dv.select((F.col("idx") + model.n_vocab).alias("idx"), F.col("label").alias("name"), "vec")
    )


def word_only_transformer(spark, sf_dir):
    return train_word_transformer(
        pairs(spark, sf_dir), model_contexts(spark, sf_dir), vocabulary(spark, sf_dir)[1], _label_params()
    )


def role_labels(spark, sf_dir):
    """The conversations as a new corpus, labelled by role."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.concat_ws("\t", "role", "text").alias("text"),
    )
    return labelled_sentences(spread(turns))


def infer_docvec(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    bags, labels, n_labels = label_matrix(role_labels(spark, sf_dir), vocab, n_vocab)
    contexts = model_contexts(spark, sf_dir)
    vectors = infer_rows(bags, n_labels, contexts, stand_in(vocab), n_vocab, DIMS)
    return vector_cells(vectors.withColumnRenamed("row", "idx").join(labels, "idx"), "idx", "label")


def document_labels(spark, sf_dir):
    """``dv(idx, label, vec)`` of the labels of the documents under the stand-in."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    bags, labels, n_labels = label_counts(spark, sf_dir)
    contexts = model_contexts(spark, sf_dir)
    vectors = infer_rows(bags, n_labels, contexts, stand_in(vocab), n_vocab, DIMS)
    return vectors.withColumnRenamed("row", "idx").join(labels, "idx").select("idx", "label", "vec")


def benchmark_bags(spark, sf_dir):
    """``m(row, col, v)``: each benchmark text as a bag of known words."""
    vocab, _ = vocabulary(spark, sf_dir)
    words = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("row"), F.explode(F.split(F.lower("text"), r"\s+")).alias("word")
    )
    known = words.join(F.broadcast(vocab.select("word", F.col("idx").alias("col"))), "word")
    return known.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("v"))


def _influences(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    return matrix_influence(
        pairs(spark, sf_dir),
        model_contexts(spark, sf_dir),
        stand_in(vocab, 17),
        stand_in(vocab, 23),
        n_vocab,
        DIMS,
    )


def label_influence(spark, sf_dir):
    return _influences(spark, sf_dir).withColumn("influence", rounded("influence"))


def mean_label_influence(spark, sf_dir):
    return mean_influence(_influences(spark, sf_dir)).withColumn("influence", rounded("influence"))


def masked_matrix_inference(spark, sf_dir):
    vocab, _ = vocabulary(spark, sf_dir)
    hidden = benchmark_words(spark, sf_dir)
    return infer_masked_words(vocab, pairs(spark, sf_dir), hidden, PARAMS)


def holdout_inference(spark, sf_dir):
    """The rare words of the vocabulary are held out."""
    vocab, _ = vocabulary(spark, sf_dir)
    terms = vocab.filter(F.col("cnt") == PARAMS.min_count).select("word")
    return infer_held_out_words(sentences(spark, sf_dir), terms, PARAMS).wv


QUERIES = {
    "truncated_svd": svd,
    "representation_transformer": representation_transformer,
    "project_rows": project_rows,
    "word2vec_train": word2vec_train,
    "word_lookup": word_lookup,
    "unseen_word_matrix": unseen_word_matrix,
    "infer_wordvec": infer_wordvec,
    "model_load": model_load,
    "append_words": append_inferred,
    "doc2vec_train": doc2vec_train,
    "word_only_transformer": word_only_transformer,
    "infer_docvec": infer_docvec,
    "label_influence": label_influence,
    "mean_label_influence": mean_label_influence,
    "masked_matrix_inference": masked_matrix_inference,
    "holdout_inference": holdout_inference,
}


def _project_sql(name: str, pmi: str, tr: str = "tr") -> str:
    return f"""
{name} AS (SELECT row, d, sum(pmi * t) AS x FROM {pmi} p JOIN {tr} USING (col) GROUP BY row, d)"""


# All words in the space of the stand-in: proj(row, d, x), zero rows included.
PROJECTED_SQL = f"""{BASE_SQL},{MODEL_PY_SQL},{pmi_sql('pm', 'ww', 'model_py', CUT)},{stand_in_sql()},
    {_project_sql('found', 'pm')},
    proj AS (SELECT idx AS row, g.d, coalesce(x, 0) AS x FROM vocab CROSS JOIN (SELECT unnest(range({DIMS})) AS d) g
        LEFT JOIN found ON found.row = vocab.idx AND found.d = g.d)"""

_NEW_SQL = f"""{NEW_ROWS_SQL},{pmi_sql('npm', 'new_ww', 'model_py')},{_project_sql('nfound', 'npm')},
    nproj AS (SELECT bindex.row, word, g.d, coalesce(x, 0) AS x FROM bindex CROSS JOIN (SELECT unnest(range({DIMS})) AS d) g
        LEFT JOIN nfound ON nfound.row = bindex.row AND nfound.d = g.d)"""

_TOKENS = f"WITH {sents_sql()},{vocab_sql()},{ENCODED_SQL}"

# The labels of the documents in the space of the stand-in: dproj(row, d, x).
DOCUMENT_LABELS_SQL = f"""{_TOKENS},{LABELLED_SQL},{DW_SQL},{MODEL_PY_SQL},{stand_in_sql()},
    {pmi_sql('dpm', 'dw', 'model_py')},{_project_sql('dfound', 'dpm')},
    dproj AS (SELECT labs.idx AS row, g.d, coalesce(x, 0) AS x FROM labs CROSS JOIN (SELECT unnest(range({DIMS})) AS d) g
        LEFT JOIN dfound ON dfound.row = labs.idx AND dfound.d = g.d)"""

BENCHMARK_BAGS_SQL = f"""
    bags AS (SELECT item_id AS row, idx AS col, CAST(count(*) AS DOUBLE) AS v
        FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM benchmark) JOIN vocab USING (word)
        GROUP BY item_id, idx),{pmi_sql('bpm', 'bags', 'model_py')},{_project_sql('bproj', 'bpm')}"""

_INFLUENCE_SQL = f"""{BASE_SQL},{MODEL_PY_SQL},{pmi_sql('pm', 'ww', 'model_py')},
    {stand_in_sql('tw', 17)},{stand_in_sql('td', 23)},{_project_sql('pw', 'pm', 'tw')},{_project_sql('pd', 'pm', 'td')},
    lw AS (SELECT row, list(x ORDER BY d) AS v FROM pw GROUP BY row),
    ld AS (SELECT row, list(x ORDER BY d) AS v FROM pd GROUP BY row),
    zero AS (SELECT list_transform(range({DIMS}), lambda i: CAST(0 AS DOUBLE)) AS z),
    both_v AS (SELECT idx AS row, coalesce(lw.v, z) AS w, coalesce(ld.v, z) AS l FROM vocab CROSS JOIN zero
        LEFT JOIN lw ON lw.row = idx LEFT JOIN ld ON ld.row = idx),
    lens AS (SELECT row, w, l, sqrt(list_dot_product(w, w)) AS nw, sqrt(list_dot_product(l, l)) AS nl FROM both_v),
    unit AS (SELECT row, CASE WHEN nw > 0 THEN list_transform(w, lambda q: q / nw) ELSE w END AS w,
        CASE WHEN nl > 0 THEN list_transform(l, lambda q: q / nl) ELSE l END AS l FROM lens),
    shift AS (SELECT a.row, abs(list_dot_product(a.w, b.w) - list_dot_product(a.l, b.l)) AS s FROM unit a, unit b),
    top AS (SELECT row, unnest(max(s, 100)) AS s FROM shift GROUP BY row),
    infl AS (SELECT row, avg(s) AS influence FROM top GROUP BY row)"""

ORACLES = {
    "project_rows": f"{PROJECTED_SQL} SELECT row, CAST(d AS INT) AS d, {r('x')} AS x FROM proj",
    "word_lookup": f"""{PROJECTED_SQL},{BENCHMARK_WORDS_SQL}
        SELECT idx, word, CAST(d AS INT) AS d, {r('x')} AS x FROM proj JOIN vocab ON idx = row JOIN bwords USING (word)""",
    "unseen_word_matrix": f"""{_TOKENS},{NEW_ROWS_SQL}
        SELECT bindex.row, word, coalesce(col, -1) AS col, {r('coalesce(v, 0)')} AS v FROM bindex LEFT JOIN new_ww USING (row)""",
    "infer_wordvec": f"""{_TOKENS},{MODEL_PY_SQL},{stand_in_sql()},{_NEW_SQL}
        SELECT row, word, CAST(d AS INT) AS d, {r('x')} AS x FROM nproj""",
    "model_load": f"""{PROJECTED_SQL},{_NEW_SQL}
        SELECT 'inferred' AS part, row, word, CAST(d AS INT) AS d, {r('x')} AS x FROM nproj
        UNION ALL SELECT 'known', row, word, CAST(d AS INT), {r('x')} FROM proj JOIN vocab ON idx = row
        WHERE idx % 2 = 1 OR word IN (SELECT word FROM bwords)""",
    "append_words": f"""{PROJECTED_SQL},{_NEW_SQL},
        added AS (SELECT row, word, (SELECT count(*) FROM vocab) + row_number() OVER (ORDER BY row) - 1 AS idx FROM bindex
            WHERE word NOT IN (SELECT word FROM vocab))
        SELECT idx, word, CAST(d AS INT) AS d, {r('x')} AS x FROM proj JOIN vocab ON idx = row
        UNION ALL SELECT CAST(idx AS INT), a.word, CAST(d AS INT), {r('x')} FROM nproj n JOIN added a USING (row)""",
    "infer_docvec": f"""{_TOKENS},{MODEL_PY_SQL},{stand_in_sql()},{CONVERSATIONS_SQL},
        rwords AS (SELECT doc_id, sent_no, lower(role) AS label, idx AS col FROM ctoks JOIN vocab USING (word)
            JOIN (SELECT conv_id * 1000 + turn AS doc_id, role FROM conversations) USING (doc_id)),
        rlabs AS (SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS idx, label
            FROM (SELECT label, min({{'d': doc_id, 's': sent_no}}) AS f FROM rwords GROUP BY label)),
        rw AS (SELECT rlabs.idx AS row, col, CAST(count(*) AS DOUBLE) AS v FROM rwords JOIN rlabs USING (label) GROUP BY rlabs.idx, col),
        {pmi_sql('rpm', 'rw', 'model_py')},{_project_sql('rproj', 'rpm')}
        SELECT rlabs.idx, label, CAST(d AS INT) AS d, {r('x')} AS x FROM rproj JOIN rlabs ON rlabs.idx = row""",
    "label_influence": f"{_INFLUENCE_SQL} SELECT row, {r('influence')} AS influence FROM infl",
    "mean_label_influence": f"{_INFLUENCE_SQL} SELECT {r('avg(influence)')} AS influence FROM infl",
}
