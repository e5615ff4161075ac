"""Upserts by key into a table of hash buckets.

A bucket is a partition folder. A merge reads the buckets that its keys fall in, and only those, takes for each key the new
row where there is one, and overwrites these folders; the others are not touched. There is no lock: merges into one
table must follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 64


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows of one key the last in order; those without a whole key are left out."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*key, "_b.*").select(*rows.columns)


def merge(updates: DataFrame, folder: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> list[int]:
    """Of each key the last of `updates`, or what the table had; gives the buckets that were rewritten.

    A newer update wins over the table whatever its order column says: merges count in the order in which they come. The
    number of buckets belongs to the table and must be the same in each call.
    """
    spark = updates.sparkSession
    new = written(latest(updates, key, order).withColumn("bucket", bucket_of(key, buckets)))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return []
    old = current(spark, folder, new)
    if old is not None:
        held = old.where(F.col("bucket").isin(touched)).join(new.select(*key), key, "left_anti")
        new = written(new.unionByName(held.select(new.columns)))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return touched


def current(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame | None:
    """The table with the columns of `like`, or None before the first merge."""
    try:
        return spark.read.schema(like.schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
