"""Run registered queries next to their SQL on the same tables and compare the values.

    python tests/compare.py [name ...]        names may be prefixes; SF_DIR picks the tables
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("n", v + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v)) if abs(v) < 2**53 else ("n", v)
    if v is None:
        return ("z", "")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return ("l", repr([_cell(x) for x in v]))
    if hasattr(v, "asDict"):
        return ("d", repr({k: _cell(x) for k, x in v.asDict().items()}))
    if isinstance(v, dict):
        return ("d", repr({k: _cell(x) for k, x in v.items()}))
    return ("s", str(v))


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    n1, r1 = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    n2, r2 = canonical(*sql_rows(con, sql))
    if n1 != n2:
        return f"columns {n1} != {n2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}; first {r1[:1]} / {r2[:1]}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    return f"{len(bad)} of {len(r1)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                said = compare(df, con, oracles[name])
            else:
                said = f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        ok = not said or said.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
