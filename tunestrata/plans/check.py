"""Run every query beside its SQL in DuckDB and compare rows: ``python -m tunestrata.plans.check``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _bag(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str) -> str:
    """Empty when rows agree (or there is no SQL); otherwise what differs."""
    import duckdb

    from tunestrata.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return "" if rows else "no rows"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    ours, theirs = _bag(df.columns, rows), _bag(names, expected)
    if ours != theirs:
        return f"rows differ, e.g. {list((ours - theirs).items())[:2]} against {list((theirs - ours).items())[:2]}"
    return "" if rows else "no rows"


def main() -> int:
    from pyspark.sql import SparkSession

    from tunestrata.plans import ORACLES, QUERIES
    from tunestrata.session import apply_skew_settings, use_local_scratch

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_skew_settings(use_local_scratch(spark))
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree in {Path(sf_dir).name}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
