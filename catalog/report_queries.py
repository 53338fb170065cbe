"""Keywords, subwords and reconstruction reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.common import (
    DW_SQL,
    ENCODED_SQL,
    LABELLED_SQL,
    label_counts,
    labelled,
    nine_digits,
    pmi_sql,
    r,
    rounded,
    sents_sql,
    vocab_sql,
    vocabulary,
)
from catalog.corpus_queries import STOPWORDS
from catalog.counting_queries import MODEL_PY_SQL, model_contexts
from catalog.search_queries import EMBEDDING_DIMS, EMBEDDINGS_SQL, embeddings, ranked_sql
from tallyvec.operators.keywords import proportion_keywords
from tallyvec.operators.subwords import subword_counts, subword_table
from tallyvec.plans.doc2vec import label_keywords
from tallyvec.plans.reconstruction import (
    common_vectors,
    export_neighbours,
    frequent_queries,
    hit_at_k,
    neighbour_report,
    neighbour_sets,
    reconstruction_accuracy,
    restrict_vectors,
    word_neighbours,
)
from tallyvec.sources.neighbours import read_neighbour_lists, write_neighbour_lists
from tallyvec.sources.stage import shared_folder

HALF = EMBEDDING_DIMS // 2
TOP = 30


def keywords_by_proportion(spark, sf_dir):
    """Over plain label-word counts."""
    n_vocab = vocabulary(spark, sf_dir)[1]
    keywords = proportion_keywords(label_counts(spark, sf_dir)[0], n_words=n_vocab)
    return keywords.select("row", "rank", "col", rounded("score").alias("score"))


def keywords_of_labels(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    keywords = label_keywords(
        labelled(spark, sf_dir), vocab, n_vocab, model_contexts(spark, sf_dir), stopwords=stop
    )
    return keywords.withColumn("score", rounded("score"))


def subwords(spark, sf_dir):
    return subword_table(vocabulary(spark, sf_dir)[0])


def subword_frequencies(spark, sf_dir):
    return subword_counts(vocabulary(spark, sf_dir)[0])


def half_embeddings(spark, sf_dir):
    """A second model of the same words: the first half of the dimensions."""
    return embeddings(spark, sf_dir).withColumn("vec", F.slice("vec", 1, HALF))


def label_sizes(spark, sf_dir):
    """``vocab(idx, word, cnt)``: a word counts as often as its label has vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    named = rows.join(F.broadcast(sizes), "label")
    return named.select(
        F.col("vec_id").cast("int").alias("idx"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"),
        "cnt",
    )


def _both_neighbours(spark, sf_dir, topk):
    full, half = embeddings(spark, sf_dir), half_embeddings(spark, sf_dir)
    return (
        word_neighbours(full, full, EMBEDDING_DIMS, topk),
        word_neighbours(half, half, HALF, topk),
    )


def align_vocab(spark, sf_dir):
    """The full model under the indices of a partial one, which holds the labels below 5."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label < 5")
    partial = rows.select(
        (F.col("vec_id") * 2).alias("idx"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"),
    )
    aligned = restrict_vectors(embeddings(spark, sf_dir), partial)
    return aligned.select(
        "idx", "word", F.posexplode("vec").alias("d", "x")
    ).select("idx", "word", F.col("d").cast("int").alias("d"), rounded("x").alias("x"))


def common_vocab(spark, sf_dir):
    """Words shared by the embeddings with a label below 7 and those with one above 3."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "label")
    wv = embeddings(spark, sf_dir).join(rows, "idx")
    shared = common_vectors(wv.filter("label < 7"), wv.filter("label > 3"))
    return shared.select(
        "idx",
        "word",
        rounded(F.get("left_vec", F.lit(0))).alias("left_x"),
        rounded(F.get("right_vec", F.lit(0))).alias("right_x"),
    )


def neighbours_side_by_side(spark, sf_dir):
    """The queries are chosen first; only these are searched for."""
    counts = label_sizes(spark, sf_dir)
    queries = frequent_queries(counts, counts)
    full = word_neighbours(embeddings(spark, sf_dir), queries, EMBEDDING_DIMS, 10)
    half = word_neighbours(half_embeddings(spark, sf_dir), queries, HALF, 10)
    report = neighbour_report(full, half, counts)
    return report.withColumn("full_sim", nine_digits("full_sim")).withColumn("infer_sim", nine_digits("infer_sim"))


def accuracy(spark, sf_dir):
    full, half = _both_neighbours(spark, sf_dir, 5)
    return reconstruction_accuracy(full, half).withColumn("accuracy", rounded("accuracy"))


def hits(spark, sf_dir):
    full, half = _both_neighbours(spark, sf_dir, TOP)
    return hit_at_k(full, half, embeddings(spark, sf_dir)).withColumn("share", rounded("share"))


def neighbour_export(spark, sf_dir):
    exported = export_neighbours(_both_neighbours(spark, sf_dir, TOP)[1])
    pair = lambda n: F.concat(n["word"], F.lit(":"), F.round(n["sim"], 9).cast("decimal(12,9)").cast("string"))
    return exported.select("query", F.array_join(F.transform("neighbours", pair), ",").alias("neighbours"))


def neighbour_lists(spark, sf_dir):
    """The lists of two sets of test words and of their union, written as text and read back."""
    full = embeddings(spark, sf_dir)
    half = full.select("idx", "word", F.slice("vec", 1, HALF).alias("vec"))
    by_label = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "label")
    tests = full.join(by_label, "idx")
    sets = {
        "low": (half, HALF, tests.where("label < 3").select("word")),
        "mixed": (half.where("idx % 3 <> 0"), HALF, tests.where("label between 2 and 4").select("word")),
    }
    found = neighbour_sets(sets, full, EMBEDDING_DIMS, TOP)
    path = f"{shared_folder(spark)}/tallyvec/neighbours-{uuid.uuid4().hex}"
    write_neighbour_lists(found, path)
    back = read_neighbour_lists(spark, path)
    return back.withColumn("sim", nine_digits("sim"))


QUERIES = {
    "proportion_keywords": keywords_by_proportion,
    "label_keywords": keywords_of_labels,
    "subword_table": subwords,
    "subword_counts": subword_frequencies,
    "align_vocab": align_vocab,
    "common_vocab": common_vocab,
    "neighbour_report": neighbours_side_by_side,
    "reconstruction_accuracy": accuracy,
    "hit_at_k": hits,
    "neighbour_export": neighbour_export,
    "neighbour_lists": neighbour_lists,
}

_LABELS = f"WITH {sents_sql()},{vocab_sql()},{ENCODED_SQL},{LABELLED_SQL},{DW_SQL}"


def _keywords_sql(scores: str, stop: str = "true") -> str:
    return f"""
    lsum AS (SELECT row, sum(v) AS ls FROM {scores} GROUP BY row),
    tsum AS (SELECT col, sum(v) AS ts FROM {scores} GROUP BY col),
    total AS (SELECT sum(v) AS t FROM {scores}),
    cand AS (SELECT *, v / ls AS p, (ts - v) / (t - ls) AS n FROM {scores} JOIN lsum USING (row) JOIN tsum USING (col), total
        WHERE v > 0 AND t - ls > 0
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY v DESC, col) <= 100),
    kept AS (SELECT row, col, v, p / (p + n) AS score FROM cand WHERE p / (p + n) >= 0.5),
    kw AS (SELECT row, col, score, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, v DESC, col) AS INT) AS rank
        FROM kept JOIN vocab ON vocab.idx = col WHERE {stop} QUALIFY rank <= 30)"""


_SUBWORDS = f"""WITH {sents_sql()},{vocab_sql()},
    marked AS (SELECT word, cnt, '<' || word || '>' AS m FROM vocab),
    grams AS (SELECT word, cnt, m, unnest(range(3, 7)) AS n FROM marked),
    starts AS (SELECT word, cnt, n, unnest(range(1, CAST(length(m) - n + 2 AS BIGINT))) AS b, m FROM grams WHERE n <= length(m)),
    subs AS (SELECT word, cnt, 0 AS n, 0 AS b, m AS subword FROM marked
        UNION ALL SELECT word, cnt, n, b, substring(m, b, n) FROM starts)"""

_PAIR = f"""WITH {EMBEDDINGS_SQL},
    emb2 AS (SELECT idx, word, vec[1:{HALF}] AS vec FROM emb),
    {ranked_sql('f', 'emb', 'emb', 'q.idx <> i.idx')},{ranked_sql('h', 'emb2', 'emb2', 'q.idx <> i.idx')},
    fn AS (SELECT q.word AS query, rank, i.word, round(s, 9) AS sim FROM f JOIN emb q ON q.idx = query JOIN emb i ON i.idx = id),
    hn AS (SELECT q.word AS query, rank, i.word, round(s, 9) AS sim FROM h JOIN emb q ON q.idx = query JOIN emb i ON i.idx = id)"""

ORACLES = {
    "proportion_keywords": f"{_LABELS},{_keywords_sql('dw')} SELECT row, rank, col, {r('score')} AS score FROM kw",
    "label_keywords": f"""{_LABELS},{MODEL_PY_SQL},{pmi_sql('dpm', 'dw', 'model_py', extra=', v')},
        weighted AS (SELECT row, col, v * pmi AS v FROM dpm),
        {_keywords_sql('weighted', "word NOT IN (" + ', '.join(repr(w) for w in STOPWORDS) + ")")}
        SELECT label, rank, word, {r('score')} AS score FROM kw JOIN labs ON labs.idx = row JOIN vocab ON vocab.idx = col""",
    "subword_table": f"""{_SUBWORDS}
        SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY n, b) - 1 AS INT) AS pos, subword FROM subs""",
    "subword_counts": f"{_SUBWORDS} SELECT subword, CAST(sum(cnt) AS BIGINT) AS cnt FROM subs GROUP BY subword",
    "align_vocab": f"""WITH {EMBEDDINGS_SQL},
        cells AS (SELECT idx * 2 AS idx, word, generate_subscripts(vec, 1) - 1 AS d, unnest(vec) AS x FROM emb WHERE label < 5)
        SELECT idx, word, CAST(d AS INT) AS d, {r('x')} AS x FROM cells""",
    "common_vocab": f"""WITH {EMBEDDINGS_SQL}
        SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INT) AS idx, word, {r('vec[1]')} AS left_x, {r('vec[1]')} AS right_x
        FROM emb WHERE label IN (4, 5, 6)""",
    "neighbour_report": f"""{_PAIR},
        counts AS (SELECT word, idx, count(*) OVER (PARTITION BY label) AS cnt FROM emb),
        asked AS (SELECT word, cnt FROM counts ORDER BY cnt DESC, idx LIMIT 1000)
        SELECT fn.query, asked.cnt AS query_cnt, fn.rank, fn.word AS full_word, x.cnt AS full_word_cnt, fn.sim + 0.0 AS full_sim,
            hn.word AS infer_word, y.cnt AS infer_word_cnt, hn.sim + 0.0 AS infer_sim
        FROM fn JOIN hn ON hn.query = fn.query AND hn.rank = fn.rank JOIN asked ON asked.word = fn.query
            JOIN counts x ON x.word = fn.word JOIN counts y ON y.word = hn.word WHERE fn.rank <= 10""",
    "reconstruction_accuracy": f"""{_PAIR},
        ks AS (SELECT unnest([1, 3, 5]) AS k),
        good AS (SELECT query FROM hn WHERE rank = 1 AND sim >= 0.1 AND sim <> 1.0),
        a AS (SELECT k, query, list(word ORDER BY word) AS ws FROM fn, ks WHERE rank <= k GROUP BY k, query),
        b AS (SELECT k, query, list(word ORDER BY word) AS ws FROM hn, ks WHERE rank <= k GROUP BY k, query),
        res AS (SELECT b.k, CAST(sum(CASE WHEN a.ws = b.ws THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total
            FROM b JOIN good USING (query) LEFT JOIN a ON a.k = b.k AND a.query = b.query GROUP BY b.k)
        SELECT k, correct, total, {r('correct / total')} AS accuracy FROM res""",
    "hit_at_k": f"""{_PAIR},
        ks AS (SELECT unnest([1, 3, 5, 10, 30]) AS k),
        res AS (SELECT k, count(*) AS total, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM fn JOIN hn ON hn.query = fn.query AND hn.word = fn.word
            WHERE fn.query = emb.word AND fn.rank <= k AND hn.rank <= k) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM emb, ks GROUP BY k)
        SELECT k, hits, total, {r('hits / total')} AS share FROM res""",
    "neighbour_export": f"""{_PAIR}
        SELECT query, string_agg(word || ':' || CAST(CAST(round(sim, 9) AS DECIMAL(12, 9)) AS VARCHAR), ',' ORDER BY rank) AS neighbours
        FROM hn WHERE rank <= {TOP} GROUP BY query""",
    "neighbour_lists": f"""WITH {EMBEDDINGS_SQL}, half AS (SELECT idx, word, vec[1:{HALF}] AS vec, label FROM emb),
        low AS (SELECT * FROM half WHERE label < 3), part AS (SELECT * FROM half WHERE idx % 3 <> 0),
        mixed AS (SELECT * FROM part WHERE label BETWEEN 2 AND 4),
        every AS (SELECT * FROM emb WHERE idx IN (SELECT idx FROM low UNION SELECT idx FROM mixed)),
        {ranked_sql('a', 'low', 'half', 'q.idx <> i.idx')},{ranked_sql('b', 'mixed', 'part', 'q.idx <> i.idx')},
        {ranked_sql('c', 'every', 'emb', 'q.idx <> i.idx')},
        found AS (SELECT 'low' AS set, * FROM a UNION ALL SELECT 'mixed', * FROM b UNION ALL SELECT 'full_answer', * FROM c)
        SELECT set, 'v' || query AS query, rank, 'v' || id AS word, s + 0.0 AS sim FROM found WHERE rank <= {TOP}""",
}
