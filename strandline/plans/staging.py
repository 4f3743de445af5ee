"""Intermediate tables in the cluster's shared folder, for results that several passes read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from strandline.plans.ordering import Ordered

SETTING = "spark.checkpoint.dir"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("staged_scopes", default=())


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Removes what is staged inside once the block ends: write or collect results before that.

    A scope holds for its own thread, and for others that run in a copy of its context.
    """
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local session without it."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(SETTING, folder)
    return folder


def stage(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write once, read many: the plan above becomes a column-pruned scan that any lost task can repeat.

    With `outer` it stays when the innermost `staged_scope` ends.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _scopes.get()[:-1] if outer else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_rows(o: Ordered, *cols: str) -> Ordered:
    """An ordered table with its index kept, so that later operators need no sort."""
    s = o.select(*cols) if cols else o
    return s.with_df(stage(s.df))


def local_copy(df: DataFrame) -> DataFrame:
    """A result of proven small size (a row per column, segment or event) as a literal table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def settled(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Stop a small aggregate from being computed again by each reader: as literals when it has at most
    `rows` rows, else as a staged table."""
    # one partition, so that the limit is one job instead of growing attempts
    got = df.limit(rows + 1).coalesce(1).collect()
    return df.sparkSession.createDataFrame(got, df.schema) if len(got) <= rows else stage(df)
