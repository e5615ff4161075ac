"""Files of exactly so many rows in order (A21), and folders by plate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.segment import running


def write_chunks(df: DataFrame, order: list[str], size: int, folder: str, form: str = "csv") -> None:
    """chunk=0000001, 0000002, ... in folder: one file each, of `size` rows (the last of what is left), in order.

    `order` must be total. Rows are numbered by a range sort; a chunk's rows then meet in one task by its number, so a file is
    whole and a task writes as many as fall to it.
    """
    numbered = running(df, order, {"_n": F.lit(1)})
    chunked = numbered.withColumn("chunk", F.format_string("%07d", F.floor((F.col("_n") - 1) / size) + 1))
    out = chunked.repartition("chunk").sortWithinPartitions("chunk", "_n").drop("_n")
    options = {"header": True} if form == "csv" else {}
    out.write.mode("overwrite").format(form).options(**options).partitionBy("chunk").save(folder)


def write_plates(df: DataFrame, plate: str, order: list[str], folder: str, columns: list[str], form: str = "csv") -> None:
    """Lean rows (columns) by plate, in order within it. A plate of many rows is parted over tasks, in order of file
    names."""
    lean = df.select(plate, *dict.fromkeys([*columns, *order]))
    out = lean.repartitionByRange(plate, *order).sortWithinPartitions(plate, *order).select(plate, *columns)
    options = {"header": True} if form == "csv" else {}
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(form).options(**options).partitionBy(plate).save(folder)
