"""Model folders: saving, loading, partial models.

A model is a folder of parquet tables, each written under a new name, and manifests. A
manifest is one row with the kind of the model, its parameters, sizes and singular values, and the names of
its tables. It is written last, under the next number, so a save that breaks off leaves the
model before it in force; a reader takes the manifest of the highest number.

A partial model names the folder of a full one. It holds only the tables that it has for itself, such
as its word vectors; contexts, transformer and whatever else is missing are read from the full model.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyvec.plans.doc2vec import LabelVectors
from tallyvec.plans.word2vec import EmbeddingParams, WordVectors

MANIFEST = (
    "version long, kind string, params string, n_vocab long, n_words long, n_labels long, "
    "sigma array<double>, tables map<string, string>, base string"
)


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifest/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None  # none has been written yet


def read_manifest(spark: SparkSession, folder: str) -> Row:
    """The manifest in force; an error if the folder holds no complete model."""
    found = _manifests(spark, folder.rstrip("/"))
    rows = found.orderBy(F.desc("version")).take(1) if found is not None else []
    if not rows:
        raise FileNotFoundError(f"no complete model in {folder}")
    return rows[0]


def save_model(model: WordVectors, folder: str, base: str | None = None, only: list[str] | None = None) -> int:
    """Write a model and return the number of its manifest.

    ``base`` is the folder of a full model and makes this a partial one, for which ``only``
    the named tables are written (the word vectors, if none are named). A full model has all its tables.
    """
    spark, folder = model.vocab.sparkSession, folder.rstrip("/")
    tables = {name: df for name, df in model.tables().items() if df is not None}
    if base is not None:
        read_manifest(spark, base)  # a full model has to be there
        wanted = ["wv"] if only is None else only
        tables = {name: tables[name] for name in wanted}
    names = {}
    for name, df in tables.items():
        names[name] = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{folder}/{names[name]}")
    before = _manifests(spark, folder)
    last = before.agg(F.max("version")).first()[0] if before is not None else None
    version = 0 if last is None else last + 1
    row = (
        version, "labels" if isinstance(model, LabelVectors) else "words", _params_text(model.params), model.n_vocab,
        model.n_words, getattr(model, "n_labels", 0), list(map(float, model.sigma)), names, base and base.rstrip("/"),
    )
    # Of two savers of the same number one fails here, and leaves the other's manifest.
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/manifest/{version:06d}")
    return version


def _params_text(params: EmbeddingParams) -> str:
    return "\n".join(f"{name}={value!r}" for name, value in asdict(params).items())


def _params(text: str) -> EmbeddingParams:
    kinds = {f.name: type(f.default) for f in fields(EmbeddingParams)}
    pairs = dict(line.split("=", 1) for line in text.splitlines())
    values = {n: v == "True" if kinds[n] is bool else kinds[n](v) for n, v in pairs.items() if n in kinds}
    return replace(EmbeddingParams(), **values)


def load_model(spark: SparkSession, folder: str) -> WordVectors:
    """A saved model, ready to search and to infer; its tables are read when they are used."""
    folder = folder.rstrip("/")
    own = read_manifest(spark, folder)
    places = {name: f"{folder}/{place}" for name, place in own.tables.items()}
    full = own
    if own.base is not None:
        full = read_manifest(spark, own.base)
        if full.base is not None:
            raise ValueError(f"{own.base} is itself a partial model")
        places = {name: f"{own.base}/{place}" for name, place in full.tables.items()} | places
    tables = {name: spark.read.parquet(place) for name, place in places.items()}
    common = dict(
        params=_params(own.params), vocab=tables["vocab"], n_vocab=own.n_vocab, py=tables["py"],
        transformer=tables["transformer"], wv=tables["wv"], n_words=own.n_words,
        sigma=list(own.sigma or full.sigma),
    )
    if full.kind == "words":
        return WordVectors(**common)
    return LabelVectors(
        **common, dv=tables["dv"], n_labels=full.n_labels, word_transformer=tables.get("word_transformer")
    )
