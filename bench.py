"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` optionally the queries, separated by commas.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sentence_tokenize",
    "vocab_index",
    "sentence_index",
    "word_context_dynamic",
    "cooc_block_prune",
    "label_word",
    "train_pmi",
    "truncated_svd",
    "project_rows",
    "word2vec_train",
    "infer_wordvec",
    "vocabulary_neighbours",
    "knn_join",
    "label_keywords",
    "label_influence",
    "subword_counts",
    "hit_at_k",
]


def vocabulary_neighbours(spark, sf_dir):
    """The ten nearest words of every word of the vocabulary."""
    from catalog.common import DIMS
    from catalog.model_queries import projected_words
    from tallyvec.operators.search import knn_join
    from tallyvec.sources.stage import write_stage

    wv = write_stage(projected_words(spark, sf_dir).select("idx", "vec"), "bench-words")
    return knn_join(wv, wv, DIMS, 10)


def main() -> None:
    import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyvec-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**catalog.QUERIES, "vocabulary_neighbours": vocabulary_neighbours}
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
