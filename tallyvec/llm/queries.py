"""Queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.llm import (
    alignment, decontaminate, html_text, jaccard_tree, kneser_ney, mixing, outliers, resampling, secrets, simhash,
    substring_dedup, suffix_dedup, tokens,
)
from tallyvec.sources.stage import shared_folder

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _removed(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400-byte strings that occur anywhere else, removed."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 400)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", _removed(), F.size("spans").cast("long").alias("n_spans"), digest)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """35-word windows that occur anywhere else, removed."""
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 35)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", "n_words", _removed(), digest)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back."""
    folder = f"{shared_folder(spark)}/tallyvec"
    docs = _table(spark, sf_dir, "documents")
    path = tokens.write_tokens(docs, public_tokenizers.path(TOKENIZER), folder, end_id=2)
    return tokens.read_tokens(spark, path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at three bits."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, most=3, seed=42)
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return out.select("doc_id", text, "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all windows of ten words of the benchmark."""
    out = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids,
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_text.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of the trusted ones."""
    out = kneser_ney.classify(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials in every document."""
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    digest = F.sha2("base", 256).alias("base_sha256")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the robust estimates."""
    out = outliers.judge(_table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *base, "distance")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3."""
    out = mixing.sample(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and scores of two tokenizers over every document."""
    a, b = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    return alignment.align(_table(spark, sf_dir, "documents"), a, b)[0]


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are nine tenths alike."""
    return jaccard_tree.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the words of the benchmark."""
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_binary": op3_token_binary,
    "op4_simhash": op4_simhash,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_outliers": op9_outliers,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_importance": op13_importance,
}
ORACLES: dict[str, str] = {
    # All pairs with a shingle in common, and all that can be reached from each document.
    "op12_jaccard_join": r"""WITH RECURSIVE
        ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM ws),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
        links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id < q.doc_id
            AND 10 * least(p.n, q.n) >= 9 * greatest(p.n, q.n) GROUP BY p.doc_id, q.doc_id, p.n, q.n
            HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS root FROM sh
            UNION SELECT b, root FROM reach JOIN both_ways ON a = doc_id)
        SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(root) AS component_id
        FROM reach JOIN sh USING (doc_id) GROUP BY doc_id""",
}
