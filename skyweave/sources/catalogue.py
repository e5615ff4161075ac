"""Catalogues as Parquet partitioned by HEALPix cell: ingest (A17, A18, A19), pruned cones (A01 to A06), resumable parts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import healpix, sky
from skyweave.operators import skyjoin

from .parts import table_print

#: Fixed value: what stands for a missing magnitude.
MISSING = -999.0


def pixel_of_source(source_id: Column) -> Column:
    """Cell of order 5 from the upper bits of a source id."""
    return F.shiftright(source_id, 49).cast("int")


def dec_zone(dec: Column, width: float = 0.1) -> Column:
    """Declination zone [lo, hi); the last one is closed."""
    last = round(180 / width) - 1
    return F.least(F.floor((dec + 90) / width), F.lit(last)).cast("int")


def ingest(df: DataFrame, folder: str, columns: dict[str, str], cell: Column | None = None, nside: int = 32, name: str = "healpix_5") -> None:
    """Cast and name columns (new name: type of a column of df by 'name AS type'), add the cell, write by cell.

    Files of a cell come from one task (one exchange by cell); overwriting replaces only the cells that df has, so a
    rerun of a part gives the same table.
    """
    typed = df.select(*(F.col(x.split(" AS ")[0]).cast(x.split(" AS ")[1]).alias(to) for to, x in columns.items()), (cell if cell is not None else healpix.nested_id(F.col("ra"), F.col("dec"), nside)).alias(name))
    typed.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(folder)


def prepared(df: DataFrame, folder: str, columns: dict[str, str], nside: int = 32) -> DataFrame:
    """The catalogue of df, by cell, in a folder below `folder` that is named by its content: ingested once, then read."""
    at = f"{folder}/catalogue-{table_print(df, {'columns': columns, 'nside': nside})}"
    try:
        return opened(df.sparkSession, at)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    ingest(df, at, columns, nside=nside)
    return opened(df.sparkSession, at)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """A01."""
    return spark.read.parquet(folder)


def cone(catalogue: DataFrame, ra: float, dec: float, radius_arcmin: float, columns: list[str], where: str | None = None, magnitudes: tuple[str, ...] = (), empty: tuple[str, ...] = (), nside: int = 32, name: str = "healpix_5") -> DataFrame:
    """A pruned cone with filters that reach the scan; missing magnitudes become null, and columns that the
    layout wants but the catalogue lacks are empty."""
    df = catalogue.where(where) if where else catalogue
    out = skyjoin.cone(df, ra, dec, radius_arcmin, columns, name, nside)
    out = out.withColumns({m: F.when(F.col(m) > MISSING, F.col(m)) for m in magnitudes}) if magnitudes else out
    return out.withColumns({e: F.lit(None).cast("double") for e in empty}) if empty else out


def gaia_cone(catalogue: DataFrame, ra: float, dec: float, radius_arcmin: float, nside: int = 32) -> DataFrame:
    """The layout of a neighbourhood file; colours and parallax are not in the catalogue and stay empty."""
    c = cone(catalogue, ra, dec, radius_arcmin, ["ra", "dec", "phot_g_mean_mag", "pmra", "pmdec"], None, (), ("BPmag", "RPmag", "Plx"), nside)
    number = lambda x: F.when(~F.isnan(x), F.col(x))
    return c.select("ra", "dec", number("phot_g_mean_mag").alias("Gmag"), "BPmag", "RPmag", number("pmra").alias("pmRA"), number("pmdec").alias("pmDE"), "Plx", "_r")


def bright_cone(catalogue: DataFrame, ra: float, dec: float, radius_arcmin: float = 45, faintest: float = 16, detections: int = 2, nside: int = 32) -> DataFrame:
    """Bright stars: seen `detections` times or more, with a valid r magnitude up to `faintest`."""
    c = cone(catalogue, ra, dec, radius_arcmin, ["ra", "dec", "nDetections", "rmag"], f"nDetections >= {detections}", ("rmag",), (), nside)
    return c.where(F.expr(sky.valid_magnitude("rmag")) & (F.col("rmag") <= faintest)).select("ra", "dec", "rmag")


def usnob_cone(catalogue: DataFrame, ra: float, dec: float, radius_arcmin: float, nside: int = 32) -> DataFrame:
    """The layout of a neighbourhood file; NaN magnitudes are empty, motions are whole numbers."""
    magnitudes = ["R1mag", "R2mag", "B1mag", "B2mag", "Imag"]
    c = cone(catalogue, ra, dec, radius_arcmin, ["ra", "dec", *magnitudes, "pmRA", "pmDE"], nside=nside)
    number = lambda x: F.when(~F.isnan(x), F.col(x))
    return c.select("ra", "dec", *(number(m).alias(m) for m in magnitudes), *(number(p).cast("int").alias(p) for p in ("pmRA", "pmDE")), "_r")


def undone(tasks: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Tasks whose state is not ok; failed and unknown ones are run again."""
    return tasks.join(state.where("status = 'ok'").select(key), key, "left_anti")
