"""Compare queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) for v in row) for row in frame.itertuples(index=False, name=None))


def difference(spark_frame, duck_frame) -> str | None:
    """None if both frames hold the same rows, else a short description."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"{len(spark_frame)} rows against {len(duck_frame)}"
    ours, theirs = rows_of(spark_frame), rows_of(duck_frame)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}"
    return None


def main():
    import __spark_entry__ as entry
    from tests.conftest import local_session

    sf, names = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            start = time.time()
            verdict = "rows only" if sql is None else difference(frame, con.execute(sql).df()) or "same"
            print(f"{name:28s} {took:6.1f}s {time.time() - start:6.1f}s {len(frame):8d} {verdict}", flush=True)
            bad += verdict not in ("same", "rows only")
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} FAILED {str(error)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
