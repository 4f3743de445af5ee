"""Columns computed from other columns of the same row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import fx


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name (2)`, `name (3)`, ... if taken (names that differ in case only are the same to Spark)."""
    taken, k, out = {c.lower() for c in df.columns}, 2, name
    while out.lower() in taken:
        out, k = f"{name} ({k})", k + 1
    return out


def derive(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a formula column; anything not finite is stored as NULL."""
    return df.withColumn(free_name(df, name), fx.stored(fx.num(value)))


def _need(cols: Sequence[str], op: str, at_least: int, exact: bool = False) -> None:
    if len(cols) < at_least or (exact and len(cols) != at_least):
        raise ValueError(f"{op} needs {'exactly' if exact else 'at least'} {at_least} column(s)")


def derive_op(
    df: DataFrame, op: str, cols: Sequence[str], name: str | None = None, a: float = 1.0, b: float = 0.0
) -> DataFrame:
    """magnitude / add / mean over columns, subtract / ratio of two, scale a * x + b of one."""
    _need(cols, op, {"subtract": 2, "ratio": 2}.get(op, 1), op in ("subtract", "ratio", "scale"))
    v = [fx.num(c) for c in cols]
    if op == "magnitude":
        out = F.sqrt(reduce(Column.__add__, [c * c for c in v]))
    elif op == "add":
        out = reduce(Column.__add__, v)
    elif op == "mean":
        out = reduce(Column.__add__, v) / len(v)
    elif op == "subtract":
        out = v[0] - v[1]
    elif op == "ratio":
        out = fx.div(v[0], v[1])
    elif op == "scale":
        out = v[0] * a + b
    else:
        raise ValueError(f"unknown derive op {op}")
    return derive(df, name or f"{op}_{'_'.join(cols)}", out)


def map_series(df: DataFrame, kind: str, y: str) -> DataFrame:
    """abs / log / sqrt of a series' values in place."""
    fn = {"abs": fx.abs_, "log": fx.ln, "sqrt": fx.sqrt}[kind]
    return df.withColumn(y, fx.stored(fn(y)))
