"""From documents to token files: filter, deduplicate, decontaminate, mix, encode.

Each stage works on the documents that its predecessor kept; ``run`` writes what a stage
returns and reads it again for the next one.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.llm import decontaminate, kneser_ney, mixing, simhash, tokens
from tallyvec.llm.queries import TOKENIZER, trusted_ids


def _folder(spark: SparkSession) -> str:
    """The session's shared folder; local sessions that name none get one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyvec-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__tie", F.xxhash64("text"))


def _same(keys: DataFrame):
    return F.col("doc_id").eqNullSafe(keys["key"]) & (F.col("__tie") == keys["text_key"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    _folder(spark)
    # Heap that grows for the packed documents stays with the executors, and the next stage has less.
    judged = kneser_ney.classify(docs, trusted_ids(spark, sf_dir), StorageLevel.DISK_ONLY).where("kept")
    keys = judged.select(F.col("doc_id").alias("key"), F.col("tie").alias("text_key"))
    return _keyed(docs).join(keys, _same(keys), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    _folder(spark)
    own = simhash.near_duplicates(docs, width=3, most=3, seed=42)
    # Without any id, a group is known by its fingerprint.
    group = F.when(F.col("component_id").isNull(), F.col("fp")).alias("nameless")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")
    best = own.groupBy("component_id", group).agg(first)
    keys = best.select(F.col("first.doc_id").alias("key"), F.col("first.tie").alias("text_key"))
    kept = _keyed(docs).join(keys, _same(keys), "left_semi")
    return kept.dropDuplicates(["doc_id", "__tie"]).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; columns may have any names."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = {f"kept{i}": c for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(c).alias(n) for n, c in names.items()], "text")
    clean = decontaminate.scan(given, items, 10, tuple(names)).where("n_hit = 0")
    return clean.select(*[F.col(n).alias(c) for n, c in names.items()])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _folder(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    folder = f"{_folder(spark)}/tallyvec"
    path = tokens.write_tokens(docs, public_tokenizers.path(TOKENIZER), folder, end_id=2)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", encoded),
]

# Model training, sampling and tokenizers are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{_folder(spark)}/tallyvec/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{path}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{path}/{number}")
    return docs
