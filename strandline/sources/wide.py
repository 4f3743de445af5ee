"""Plotted series as one wide CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.layout import ROW
from strandline.plans.ordering import Ordered


def number_text(c: Column) -> Column:
    """Up to 15 decimals without trailing zeros; empty when not finite."""
    text = F.regexp_replace(F.format_string("%.15f", c), r"\.?0+$", "")
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), text), F.lit(""))


def wide_series(o: Ordered, series: str, x: str, y: str, names: Sequence[str], x_name: str = "x") -> DataFrame:
    """Series side by side by position: (row_idx, x of the first series, one column per series), as text.

    `o` is ordered within each `series`; shorter series leave blanks.
    """
    asked = o.df.filter(F.col(series).isin(list(names)))  # others would add rows of blanks
    wide = asked.groupBy(ROW).pivot(series, list(names)).agg(F.first(x).alias("x"), F.first(y).alias("y"))
    cols = [number_text(F.col(f"{names[0]}_x")).alias(x_name)]
    cols += [number_text(F.col(f"{n}_y")).alias(n) for n in names]
    return wide.select(ROW, *cols)


def export_wide(wide: DataFrame, path: str) -> None:
    """Write in row order; range partitions keep the file parts in order."""
    wide.orderBy(ROW).drop(ROW).write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="")
