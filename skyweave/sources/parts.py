"""Work in parts that can be resumed (J03, B31): a digest of inputs and parameters names each part.

A part is what rows of one key give. Its digest is taken over all its rows, in any order, and the parameters; results are
kept by (part, digest), so that a changed row or parameter makes another part and an unchanged one is found again. What a run
works out lies in one folder of its own, for any number of parts. Markers that name the run are added when its results are
written, also for parts that have none. Parts with a marker are left out by an anti join; rows of a run that broke off have
none: they are not read, and its parts are worked out again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "part string, digest string, run string"


def row_hash(df: DataFrame, columns: list[str] | None = None):
    """A 64-bit hash of a row; nulls and empty texts differ, as each value goes with whether it is null."""
    names = sorted(columns or df.columns)
    return F.xxhash64(*(x for c in names for x in (F.col(c), F.col(c).isNull())))


def table_print(df: DataFrame, parameters: dict | None = None) -> str:
    """Ten hexadecimal digits for the rows of a table, in any order, and parameters."""
    h = df.select(row_hash(df).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    text = json.dumps([parameters or {}, sorted(df.columns), h["n"], h["x"], h["s"]], sort_keys=True)
    return sha256(text.encode()).hexdigest()[:10]


def part_prints(rows: DataFrame, part: str, parameters: dict | None = None) -> DataFrame:
    """(part as text, digest) of each part of the rows."""
    by = rows.select(F.col(part).cast("string").alias("part"), row_hash(rows).alias("h")).groupBy("part")
    sums = by.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    given = F.lit(json.dumps([parameters or {}, sorted(rows.columns)], sort_keys=True))
    return sums.select("part", F.sha2(F.concat_ws("|", given, "part", "n", "x", "s"), 256).substr(1, 16).alias("digest"))


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of all parts that are done, each with one run that has its results; none where nothing was written."""
    try:
        done = spark.read.schema(MARK).parquet(f"{folder}/done").where("run IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], MARK)
    return done.groupBy("part", "digest").agg(F.min("run").alias("run"))


def resume(rows: DataFrame, part: str, work: Callable[[DataFrame], DataFrame], folder: str, parameters: dict | None = None) -> tuple[DataFrame, int]:
    """What `work` gives for all parts of the rows, and how many parts had to be worked out now.

    `work` takes rows of any parts and gives rows with the column `part` (the part's key as text); it must treat parts
    apart. Rows without a part are left out. Results of earlier digests stay in the folder but are not read.
    """
    from .shared import written

    spark = rows.sparkSession
    prints = written(part_prints(rows.where(F.col(part).isNotNull()), part, parameters))
    todo = written(prints.join(marked(spark, folder), ["part", "digest"], "left_anti"))
    n = todo.count()
    if n:
        mine = rows.join(todo.select(F.col("part").alias("_part")), F.col(part).cast("string") == F.col("_part"), "left_semi")
        run = f"r{uuid.uuid4().hex}"  # with a letter first, as it is read back as text
        work(mine).withColumn("part", F.col("part").cast("string")).join(todo, "part").write.parquet(f"{folder}/rows/run={run}")
        todo.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/done")
    wanted = written(prints.join(marked(spark, folder), ["part", "digest"]))
    runs = sorted(r.run for r in wanted.select("run").distinct().collect())
    if not runs:
        return work(rows.limit(0)).withColumn("part", F.col("part").cast("string")).join(todo, "part"), n
    # by the runs' own paths: Spark takes two reads of one folder for the same, also when a run was added between them
    whole = spark.read.option("basePath", f"{folder}/rows").parquet(*(f"{folder}/rows/run={r}" for r in runs))
    return whole.join(wanted, ["part", "digest", "run"], "left_semi").drop("run"), n
