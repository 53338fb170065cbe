"""Cosine search over the embeddings table, label search, and search in PMI space."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    BASE_SQL,
    BENCHMARK_WORDS_SQL,
    DIMS,
    benchmark_words,
    nine_digits,
    pmi_sql,
    stand_in,
    table,
    vocabulary,
)
from catalog.counting_queries import CUT, MODEL_PY_SQL, model_contexts
from catalog.model_queries import (
    BENCHMARK_BAGS_SQL,
    DOCUMENT_LABELS_SQL,
    benchmark_bags,
    document_labels,
    trained_pmi,
)
from tallyvec.operators.factor import sparse_dot
from tallyvec.operators.pmi import train_pmi
from tallyvec.operators.search import (
    cosine_search,
    knn_join,
    SparseSpace,
    most_similar,
    name_hits,
    similar_to_vector,
    sparse_cosine_search,
)

EMBEDDING_DIMS = 64
QUERY = 7


def embeddings(spark, sf_dir):
    """``wv(idx, word, vec)`` of the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("idx"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def centroids(spark, sf_dir):
    """``dv(idx, label, vec)``: the mean vector of each label."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("idx"), F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x")
    )
    means = cells.groupBy("idx", "d").agg(F.avg("x").alias("x"))
    vectors = means.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    return vectors.select(
        "idx", F.concat(F.lit("label"), F.col("idx").cast("string")).alias("label"), F.col("c.x").alias("vec")
    )


def _words(df):
    return df.select("rank", "word", nine_digits("sim").alias("sim"))


def _hits(df):
    return df.select("query", "rank", "id", nine_digits("sim").alias("sim"))


def similar_words(spark, sf_dir):
    wv = embeddings(spark, sf_dir)
    return _words(most_similar(f"v{QUERY}", wv, EMBEDDING_DIMS, 10, everything=False))


def similar_from_vector(spark, sf_dir):
    """Without an excluded index the vector finds its own word first."""
    wv = embeddings(spark, sf_dir)
    vector = wv.filter(F.col("idx") == QUERY).first()["vec"]
    return _words(similar_to_vector(vector, wv, 10))


def most_similar_all(spark, sf_dir):
    return _words(most_similar(f"v{QUERY}", embeddings(spark, sf_dir), EMBEDDING_DIMS, topk=-1))


def all_neighbours(spark, sf_dir):
    wv = embeddings(spark, sf_dir).select("idx", "vec")
    return _hits(knn_join(wv, wv, EMBEDDING_DIMS, 10))


def similar_docs(spark, sf_dir):
    dv = centroids(spark, sf_dir)
    queries = embeddings(spark, sf_dir).select("idx", "vec")
    hits = name_hits(cosine_search(queries, dv.select("idx", "vec"), EMBEDDING_DIMS, 3), dv, "label")
    return hits.select("query", "rank", "label", nine_digits("sim").alias("sim"))


def similar_docs_from_bow(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    dv = document_labels(spark, sf_dir)
    pmi, _ = train_pmi(benchmark_bags(spark, sf_dir), model_contexts(spark, sf_dir), n_cols=n_vocab)
    queries = sparse_dot(pmi, stand_in(vocab), DIMS, n_vocab, value="pmi")
    hits = name_hits(cosine_search(queries, dv.select("idx", "vec"), DIMS, 10), dv, "label")
    return hits.select("query", "rank", "label", nine_digits("sim").alias("sim"))


def similar_in_pmi_space(spark, sf_dir):
    """Known words, also those without contexts, among all words."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    pmi = trained_pmi(spark, sf_dir)
    asked = vocab.join(benchmark_words(spark, sf_dir), "word").select(F.col("idx").alias("row"))
    return _hits(sparse_cosine_search(pmi.join(asked, "row"), pmi, 10, n_rows=n_vocab, n_cols=n_vocab, ids=asked))


def unseen_in_pmi_space(spark, sf_dir):
    """New texts, whose numbers mean no word of the model, among all words."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    bags = benchmark_bags(spark, sf_dir)
    new, _ = train_pmi(bags, model_contexts(spark, sf_dir), n_cols=n_vocab)
    space = SparseSpace.build(trained_pmi(spark, sf_dir), n_vocab, n_vocab)
    return _hits(space.search(new, 10, known=False))


QUERIES = {
    "similar_words": similar_words,
    "similar_from_vector": similar_from_vector,
    "most_similar": most_similar_all,
    "knn_join": all_neighbours,
    "similar_docs": similar_docs,
    "similar_docs_from_bow": similar_docs_from_bow,
    "similar_in_pmi_space": similar_in_pmi_space,
    "unseen_in_pmi_space": unseen_in_pmi_space,
}

# Ranks use the similarity to nine digits and then the smaller id.
_RANK = "CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS INT)"

EMBEDDINGS_SQL = """
emb AS (SELECT vec_id AS idx, 'v' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two list columns; a zero vector is similar to nothing."""
    return f"""coalesce(list_dot_product({a}, {b})
        / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"""


def ranked_sql(name: str, queries: str, items: str, where: str = "true") -> str:
    """``name(query, id, s, rank)`` over ``queries(idx, vec)`` and ``items(idx, vec)``."""
    return f"""
{name}_sims AS (SELECT q.idx AS query, i.idx AS id, {cosine_sql('q.vec', 'i.vec')} AS s
    FROM {queries} q, {items} i WHERE {where}),
{name} AS (SELECT query, id, round(s, 9) AS s, {_RANK} AS rank FROM {name}_sims)"""


_ONE = f"WITH {EMBEDDINGS_SQL}, one AS (SELECT * FROM emb WHERE idx = {QUERY}),"

ORACLES = {
    "similar_words": f"""{_ONE}{ranked_sql('h', 'one', 'emb', 'q.idx <> i.idx')}
        SELECT rank, word, s + 0.0 AS sim FROM h JOIN emb ON emb.idx = id WHERE rank <= 10""",
    "similar_from_vector": f"""{_ONE}{ranked_sql('h', 'one', 'emb')}
        SELECT rank, word, s + 0.0 AS sim FROM h JOIN emb ON emb.idx = id WHERE rank <= 10""",
    "most_similar": f"""{_ONE}{ranked_sql('h', 'one', 'emb', 'q.idx <> i.idx')}
        SELECT rank, word, s + 0.0 AS sim FROM h JOIN emb ON emb.idx = id""",
    "knn_join": f"""WITH {EMBEDDINGS_SQL},{ranked_sql('h', 'emb', 'emb', 'q.idx <> i.idx')}
        SELECT query, rank, id, s + 0.0 AS sim FROM h WHERE rank <= 10""",
    "similar_docs": f"""WITH {EMBEDDINGS_SQL},
        cells AS (SELECT label AS idx, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM emb),
        means AS (SELECT idx, d, avg(x) AS x FROM cells GROUP BY idx, d),
        dv AS (SELECT idx, list(x ORDER BY d) AS vec FROM means GROUP BY idx),{ranked_sql('h', 'emb', 'dv')}
        SELECT query, rank, 'label' || id AS label, s + 0.0 AS sim FROM h WHERE rank <= 3""",
    "similar_docs_from_bow": f"""{DOCUMENT_LABELS_SQL},{BENCHMARK_BAGS_SQL},
        dv AS (SELECT row AS idx, list(x ORDER BY d) AS vec FROM dproj GROUP BY row),
        bq AS (SELECT row AS idx, list(x ORDER BY d) AS vec FROM bproj GROUP BY row),{ranked_sql('h', 'bq', 'dv')}
        SELECT query, rank, label, s + 0.0 AS sim FROM h JOIN labs ON labs.idx = id WHERE rank <= 10""",
    "similar_in_pmi_space": f"""{BASE_SQL},{MODEL_PY_SQL},{pmi_sql('pm', 'ww', 'model_py', CUT)},{BENCHMARK_WORDS_SQL},
        lens AS (SELECT row, sqrt(sum(pmi * pmi)) AS len FROM pm GROUP BY row),
        asked AS (SELECT pm.* FROM pm JOIN vocab ON idx = row JOIN bwords USING (word)),
        dots AS (SELECT q.row AS query, p.row AS id, sum(q.pmi * p.pmi) AS dot FROM asked q JOIN pm p USING (col)
            WHERE q.row <> p.row GROUP BY q.row, p.row),
        near AS (SELECT query, id, dot / (x.len * y.len) AS s FROM dots JOIN lens x ON x.row = query JOIN lens y ON y.row = id),
        sims AS (SELECT a.idx AS query, v.idx AS id, coalesce(s, 0) AS s FROM vocab a JOIN bwords USING (word)
            JOIN vocab v ON v.idx <> a.idx LEFT JOIN near ON query = a.idx AND id = v.idx),
        h AS (SELECT query, id, round(s, 9) AS s, {_RANK} AS rank FROM sims)
        SELECT query, rank, id, s + 0.0 AS sim FROM h WHERE rank <= 10""",
    "unseen_in_pmi_space": f"""{BASE_SQL},{MODEL_PY_SQL},{pmi_sql('pm', 'ww', 'model_py', CUT)},{BENCHMARK_BAGS_SQL},
        lens AS (SELECT row, sqrt(sum(pmi * pmi)) AS len FROM pm GROUP BY row),
        newlens AS (SELECT row, sqrt(sum(pmi * pmi)) AS len FROM bpm GROUP BY row),
        near AS (SELECT q.row AS query, p.row AS id, sum(q.pmi * p.pmi) / (any_value(x.len) * any_value(y.len)) AS s
            FROM bpm q JOIN pm p USING (col) JOIN newlens x ON x.row = q.row JOIN lens y ON y.row = p.row GROUP BY q.row, p.row),
        sims AS (SELECT a.row AS query, v.idx AS id, coalesce(s, 0) AS s FROM newlens a CROSS JOIN vocab v
            LEFT JOIN near ON query = a.row AND id = v.idx),
        h AS (SELECT query, id, round(s, 9) AS s, {_RANK} AS rank FROM sims)
        SELECT query, rank, id, s + 0.0 AS sim FROM h WHERE rank <= 10""",
}
