"""Query registration and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import Ordered, order_rows
from strandline.functions.times import epoch_seconds
from strandline.plans.layout import ROW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, by=()) -> Ordered:
    """The event stream in time order with its axis `x` in epoch seconds."""
    df = table(spark, sf_dir, "events")
    df = df.withColumn("x", epoch_seconds(df, "ts"))
    return order_rows(df, ["ts", "event_id"], by)


def lines(spark: SparkSession, sf_dir: str) -> Ordered:
    return order_rows(table(spark, sf_dir, "lineitem"), LINE_KEY)


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# SQL building blocks: the same inputs, and the upper median of a list.
EV = (
    "ev AS (SELECT *, epoch_us(ts) / 1e6 AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx, "
    "count(*) OVER () AS n FROM events)"
)
EV_BY = (
    "ev AS (SELECT *, epoch_us(ts) / 1e6 AS x, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM events)"
)
LI = (
    f"li AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_idx, "
    "count(*) OVER () AS n FROM lineitem)"
)


def um(v: str, cond: str = "TRUE") -> str:
    return f"list_sort(list({v}) FILTER ({v} IS NOT NULL AND {cond}))[(count({v}) FILTER ({cond})) // 2 + 1]"


__all__ = [
    "EV", "EV_BY", "LI", "LINE_KEY", "MEASURES", "ORACLES", "QUERIES", "ROW", "events", "lines", "query", "rounded", "table", "um",
]
