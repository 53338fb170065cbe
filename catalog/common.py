"""Shared inputs of the queries and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.operators.cooccurrence import count_pairs_once, mirrored, weights
from tallyvec.operators.vocabulary import index_vocabulary
from tallyvec.plans.doc2vec import label_matrix
from tallyvec.sources.corpus import distinct_words, labelled_sentences, tokenize_sentences
from tallyvec.sources.stage import spread, write_stage

MIN_COUNT, WINDOW, DIMS = 10, 3, 8
DIGITS = 6

_made: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """Keep a written table that several queries read, per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_sentences(documents(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return once(
        spark, sf_dir, "vocab", lambda: index_vocabulary(sentences(spark, sf_dir), MIN_COUNT)
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word matrix ``m(row, col, v)`` with dynamic weights."""

    def make():
        vocab, n = vocabulary(spark, sf_dir)
        counts = write_stage(count_pairs_once(sentences(spark, sf_dir), vocab, n, WINDOW), "pairs")
        return mirrored(counts).select("row", "col", weights(F.col("units"), WINDOW, True).alias("v"))

    return once(spark, sf_dir, "pairs", make)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by source and language; German ones have no labels of their own."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    marked = F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit("\t"), F.col("text"))
    text = F.when(F.col("lang") == "de", F.col("text")).otherwise(marked)
    return labelled_sentences(docs.select("doc_id", text.alias("text")))


def label_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    def make():
        vocab, n = vocabulary(spark, sf_dir)
        matrix, labels, n_labels = label_matrix(labelled(spark, sf_dir), vocab, n)
        return write_stage(matrix, "label-matrix"), labels, n_labels

    return once(spark, sf_dir, "labels", make)


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New text: one document per turn."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"
    )
    return tokenize_sentences(spread(turns))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark texts, used as test words."""
    words = F.explode(F.split(F.lower("text"), r"\s+")).alias("word")
    return distinct_words(table(spark, sf_dir, "benchmark").select(words))


def transformer(n: int) -> Column:
    """A fixed stand-in for a trained transformer, over an integer column ``col``."""
    return F.array(
        *[((F.col("col") * 31 + d * n) % 101 - 50) / F.lit(50.0) for d in range(DIMS)]
    )


def stand_in(vocab: DataFrame, n: int = 17) -> DataFrame:
    return vocab.select(F.col("idx").alias("col")).select("col", transformer(n).alias("vec"))


def rounded(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, DIGITS) + F.lit(0.0)


def nine_digits(column: Column | str) -> Column:
    """Similarities as they are ranked: rounded once, from the unrounded value."""
    return F.round(column, 9) + F.lit(0.0)


def vector_cells(df: DataFrame, *keys: str) -> DataFrame:
    """One row per dimension, as the engines round and compare numbers, not arrays."""
    return df.select(*keys, F.posexplode("vec").alias("d", "x")).select(
        *keys, F.col("d").cast("int").alias("d"), rounded("x").alias("x")
    )


# SQL ---------------------------------------------------------------------------------


def sents_sql(
    table_sql: str = "SELECT doc_id, text FROM documents", prefix: str = ""
) -> str:
    p = prefix
    return f"""
{p}docs AS (SELECT doc_id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS t FROM ({table_sql})),
{p}raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS piece,
    generate_subscripts(string_split(t, chr(10)), 1) AS ord FROM {p}docs WHERE t <> ''),
{p}sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS sent_no,
    list_filter(regexp_split_to_array(piece, '\\s+'), lambda x: x <> '') AS words FROM {p}raw WHERE piece <> ''),
{p}toks AS (SELECT doc_id, sent_no, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM {p}sents)"""


def vocab_sql(min_count: int = MIN_COUNT, prefix: str = "") -> str:
    return f"""
vocab AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, first) - 1 AS INT) AS idx, word, cnt FROM (
    SELECT word, count(*) AS cnt, min({{'d': doc_id, 's': sent_no, 'p': pos}}) AS first FROM {prefix}toks GROUP BY word
    HAVING count(*) >= {min_count}))"""


def units_sql(window: int = WINDOW, dynamic: bool = True) -> str:
    return f"sum({f'{window} + 1 - abs(b.pos - a.pos)' if dynamic else '1'})"


def near_sql(a: str, b: str, window: int = WINDOW) -> str:
    """A join of two token tables on nearby places of one sentence."""
    offsets = [o for o in range(-window, window + 1) if o]
    return f"""{a} a CROSS JOIN (SELECT unnest({offsets}) AS o) o
    JOIN {b} b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND b.pos = a.pos + o.o"""


ENCODED_SQL = """
enc AS (SELECT doc_id, sent_no, pos, idx FROM toks JOIN vocab USING (word))"""

PAIRS_SQL = f"""
ww AS (SELECT a.idx AS row, b.idx AS col, {units_sql()} / {float(WINDOW)} AS v
    FROM {near_sql('enc', 'enc')} GROUP BY a.idx, b.idx)"""

BASE_SQL = f"WITH {sents_sql()},{vocab_sql()},{ENCODED_SQL},{PAIRS_SQL}"

LABELLED_SQL = """
ldocs AS (SELECT doc_id, CASE WHEN lang = 'de' THEN ['__doc' || doc_id || '__'] ELSE [source, lang] END AS labels
    FROM documents)"""

DW_SQL = """
lwords AS (SELECT doc_id, sent_no, idx AS col, lower(unnest(labels)) AS label,
    generate_subscripts(labels, 1) AS lpos FROM enc JOIN ldocs USING (doc_id)),
lcounts AS (SELECT label, col, count(*) AS cnt, min({'d': doc_id, 's': sent_no, 'l': lpos}) AS first
    FROM lwords GROUP BY label, col),
labs AS (SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS idx, label
    FROM (SELECT label, min(first) AS first FROM lcounts GROUP BY label)),
dw AS (SELECT labs.idx AS row, col, CAST(cnt AS DOUBLE) AS v FROM lcounts JOIN labs USING (label))"""

CONVERSATIONS_SQL = sents_sql("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations", "c")

BENCHMARK_WORDS_SQL = """
bwords AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM benchmark)
    WHERE word <> '')"""


def transformer_sql(n: int = 17) -> str:
    return f"((j * 31 + d * {n}) % 101 - 50) / 50.0"


def stand_in_sql(name: str = "tr", n: int = 17) -> str:
    return f"""
{name} AS (SELECT idx AS col, d, {transformer_sql(n).replace('j', 'idx')} AS t
    FROM vocab CROSS JOIN (SELECT unnest(range({DIMS})) AS d))"""


def pmi_sql(
    name: str, matrix: str, py: str, min_pmi: str = "1.0 - 1e-12", alpha: float = 0.0, extra: str = ""
) -> str:
    """PMI of a matrix with the context probabilities of ``py(col, p)``."""
    return f"""
{name}_sums AS (SELECT row, sum(v) AS s FROM {matrix} GROUP BY row),
{name}_all AS (SELECT m.row, m.col, m.v, (m.v / s) / (p + {float(alpha)}) AS e FROM {matrix} m JOIN {name}_sums USING (row)
    JOIN {py} py ON py.col = m.col WHERE s > 0 AND p > 0),
{name} AS (SELECT row, col{extra}, ln(e) AS pmi FROM {name}_all WHERE e >= {min_pmi} AND abs(ln(e)) > 1e-12)"""


COUNT_PY_SQL = """
raw_py AS (SELECT idx AS col, cnt / (SELECT sum(cnt) FROM vocab) AS p FROM vocab)"""


def smooth_sql(name: str, py: str, beta: float = 0.75) -> str:
    return f"""
{name} AS (SELECT col, p ** {beta} / (SELECT sum(p ** {beta}) FROM {py}) AS p FROM {py})"""


def r(expr: str) -> str:
    return f"round({expr}, {DIGITS}) + 0.0"
