"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Spark then removes the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("tables written for the result that is being built", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; without it the folder of the session's warehouse, which is shared
    by definition."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/skyweave-tables"
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, readable by every executor. What was shuffled
    for it goes as soon as it is whole."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyweave-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    if (noted := _passing.get()) is not None:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _gone(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows as a table. What build() wrote on the way goes once that table is whole, so that a chain of
    operators holds the results of its steps and not all tables between them."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        df = build()
    finally:
        _passing.reset(token)
    out = written(df)
    _gone(spark, paths)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        _gone(spark, paths)
