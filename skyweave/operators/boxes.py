"""Plate boxes as the first level of a scan (A07, A07b): which plates a cone overlaps, and only their files are read.

Boxes are (plate_id, ra_min, ra_max, dec_min, dec_max) with ra_min <= ra_max; a box never goes over 0 degrees, a cone may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.sources.shared import written

from . import cells
from .skyjoin import pairs
from .validate import manifest

LEAST_COS = 0.05  #: fixed value: near a pole a cone's reach in right ascension grows no further
THOUSANDTHS = 1000.0  #: fixed value: magnitudes are stored as whole thousandths


def overlapping(rows: DataFrame, key: str, boxes: DataFrame, radius: float, width: float = 2.0) -> DataFrame:
    """(key, plate_id) of all plates whose box the cone of `radius` arcsec around a row overlaps, each pair once.

    An equi-join on the cells that both touch, then the interval tests. Rows without a position overlap none.
    """
    r = radius / 3600
    reach = f"least({r!r} / greatest(cos(radians(dec)), {LEAST_COS}), 180e0)"
    asked = rows.where("ra IS NOT NULL AND dec IS NOT NULL").selectExpr(key, "ra", "dec", f"pmod(ra - {reach}, 360e0) AS _lo", f"pmod(ra + {reach}, 360e0) AS _hi", f"explode({cells.touched(f'ra - {reach}', f'ra + {reach}', f'dec - {r!r}', f'dec + {r!r}', width)}) AS _cell")
    boxed = boxes.withColumn("_cell", F.explode(F.expr(cells.touched("ra_min", "ra_max", "dec_min", "dec_max", width))))
    met = asked.join(boxed, "_cell").where(f"dec_max >= dec - {r!r} AND dec_min <= dec + {r!r}")
    met = met.where("CASE WHEN _lo <= _hi THEN ra_max >= _lo AND ra_min <= _hi ELSE ra_max >= _lo OR ra_min <= _hi END")
    return met.select(key, "plate_id").distinct()


def coverage_count(rows: DataFrame, key: str, boxes: DataFrame, radius: float) -> DataFrame:
    """Key and covered, the number of plates that overlap; 0 is no coverage, which is not the same as no match."""
    n = overlapping(rows, key, boxes, radius).groupBy(key).agg(F.count("*").alias("covered"))
    return rows.select(key).join(n, key, "left").select(key, F.coalesce("covered", F.lit(0)).alias("covered"))


def write_plates(objects: DataFrame, folder: str) -> None:
    """Objects with plate_id, a folder for each plate; a rerun overwrites the plates that it has."""
    objects.repartition("plate_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plate_id").parquet(folder)


def plate_scan(spark: SparkSession, folder: str, rows: DataFrame, key: str, boxes: DataFrame, radius: float, magnitudes: tuple[str, ...] = (), clean_only: bool = True) -> DataFrame:
    """Objects within `radius` arcsec of each row on the plates that its cone overlaps.

    The plates that any cone needs (at most the manifest, which is checked) are broadcast, and prune the partitions of
    the object table before it is read. Objects are clean where flag % 100 = 0. Columns: key, plate_id, the object's with
    r_ before them, magnitudes in magnitudes, sep_arcsec; nearest first by orderBy of the caller.
    """
    want = overlapping(rows, key, manifest(boxes), radius)
    objects = spark.read.parquet(folder)
    needed = written(want.groupBy(F.col("plate_id").cast(objects.schema["plate_id"].dataType).alias("plate_id")).agg(F.count("*").alias("asked")))
    needed = needed.where("asked > 0").select("plate_id")  # a filter, so that Catalyst takes it for one that prunes
    objects = objects.join(F.broadcast(needed), "plate_id", "left_semi")
    if clean_only:
        objects = objects.where("flag % 100 = 0")
    objects = objects.withColumns({m: F.col(m) / THOUSANDTHS for m in magnitudes}) if magnitudes else objects
    asked = rows.select(key, "ra", "dec").join(want, key)
    return pairs(asked, objects, radius, ["plate_id"])
