"""Validation analytics: recall (E06), null controls (D14), histograms (E07), coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.functions import sky

from . import cells
from .segment import running
from .skyjoin import matched_keys, nearest, pairs


MOD = 2147483647


def seeded_text(key: str, seed: int = 1) -> str:
    """SQL for a number below 2 ** 31 of an integer expression, by the same integer arithmetic in any engine."""
    return f"(((CAST({key} AS BIGINT) + 1) * 15485863 % {MOD} + {seed} * 104729) * 48271 % {MOD} * 48271 % {MOD})"


def nearest_distance(reference: DataFrame, detections: DataFrame, radius: float, key: str = "id", on: list[str] | None = None) -> DataFrame:
    """Every reference row with the distance of its nearest detection (null beyond radius)."""
    best = pairs(reference.select(key, "ra", "dec", *(on or [])), detections, radius, on).groupBy(key, *(on or [])).agg(F.min("sep_arcsec").alias("dist"))
    return reference.join(best, [key, *(on or [])], "left")


def recall(distances: DataFrame, radii: list[float], by: list[str] | None = None) -> DataFrame:
    """Share of rows with a detection within each radius."""
    hits = F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.coalesce((F.col("dist") <= r).cast("int"), F.lit(0)).alias("hit")) for r in radii))
    rows = distances.select(*(by or []), F.explode(hits).alias("h")).select(*(by or []), "h.*")
    return rows.groupBy(*(by or []), "radius").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))


def null_arms(detections: DataFrame, shift_deg: float) -> DataFrame:
    """The rows and the same rows displaced in RA, in one frame with an arm column, so one join serves both."""
    real = detections.withColumn("arm", F.lit("real"))
    return real.union(detections.withColumn("ra", F.expr(sky.wrap360(f"ra + {shift_deg}e0"))).withColumn("arm", F.lit("null")))


def histogram(distances: DataFrame, most: int) -> DataFrame:
    """Bins (lo, lo + 1] of real and null arms with the excess; a distance of 0 falls in no bin."""
    b = distances.where("dist > 0").withColumn("lo", (F.ceil("dist") - 1).cast("int")).where(F.col("lo") < most)
    n = lambda arm: F.sum((F.col("arm") == arm).cast("long"))
    return b.groupBy("lo").agg(n("real").alias("n_real"), n("null").alias("n_null")).withColumn("excess", F.col("n_real") - F.col("n_null"))


MANIFEST = 10_000


def manifest(plates: DataFrame) -> DataFrame:
    """A table of plates, checked to be no more than a manifest of MANIFEST rows."""
    if plates.limit(MANIFEST + 1).count() > MANIFEST:
        raise ValueError(f"plates are expected to be a manifest of at most {MANIFEST} rows")
    return plates


CELL = 5.0  #: degrees of the cells whose candidate plates are listed


def plate_candidates(spark: SparkSession, plates: DataFrame, k: int, width: float = CELL) -> DataFrame:
    """(cell, plates) of every cell of the sky: the plates that can be among the k nearest of any point in it: those no
    farther from its centre than the k-th is, and twice the cell's own reach."""
    zone = spark.range(round(180 / width) + 1).withColumnRenamed("id", "zone")
    cell = zone.selectExpr("zone", f"zone * {width!r} - 90 AS lo", f"{cells.parts('zone', width)} AS parts").selectExpr("*", "explode(sequence(0L, parts - 1)) AS part")
    cell = cell.selectExpr("zone * 1048576 + part AS _cell", "(part + 0.5e0) * 360 / parts AS c_ra", f"lo + {width / 2!r} AS c_dec", f"{width / 2!r} + 180e0 / parts * cos(radians(CASE WHEN lo >= 0 THEN lo ELSE -lo - {width!r} END)) AS reach")
    p = manifest(plates).agg(F.collect_list(F.struct(F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"), F.col("id").alias("plate_id"))).alias("_plates"))
    far = f"transform(_plates, x -> {sky.haversine('c_ra', 'c_dec', 'x.p_ra', 'x.p_dec')} / 3600)"
    at = cell.crossJoin(F.broadcast(p)).withColumn("_far", F.expr(far)).withColumn("_most", F.expr(f"coalesce(get(array_sort(_far), {k - 1}), 360) + 2 * reach + 1e-6"))
    return at.select("_cell", F.expr("filter(_plates, (x, i) -> _far[i] <= _most)").alias("_plates"))


def nearest_plates(rows: DataFrame, plates: DataFrame, k: int) -> DataFrame:
    """The k nearest plate centres of each row (near: sep in degrees, plate_id; ties to the smaller id), without a shuffle
    of the rows: the cells of the sky, with the few plates that can be nearest there, are a table of fixed length.

    The plates are a checked manifest. A row without a position has the plates with null separations.
    """
    near = f"slice(array_sort(transform(_plates, x -> struct({sky.haversine('ra', 'dec', 'x.p_ra', 'x.p_dec')} / 3600 AS sep, x.plate_id AS plate_id))), 1, {k})"
    listed = plate_candidates(rows.sparkSession, plates, k)
    placed = rows.withColumn("_cell", F.coalesce(F.expr(cells.own("ra", "dec", CELL)), F.lit(0).cast("long")))
    return placed.join(F.broadcast(listed), "_cell").withColumn("near", F.expr(near)).drop("_plates", "_cell")


def boxed(rows: DataFrame, plates: DataFrame, half: float) -> DataFrame:
    """Rows with each plate whose square of `half` degrees (offsets on the sky) has them, as an equi-join on
    cells. Plate columns come as plate_id, p_ra, p_dec."""
    half = float(half)
    p = plates.select(F.col("id").alias("plate_id"), F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"))
    wide = f"least(180e0, {half!r} / greatest(1e-6, cos(radians(p_dec))))"
    p = p.withColumn("_cell", F.explode(F.expr(cells.touched(f"p_ra - {wide}", f"p_ra + {wide}", f"p_dec - {half!r}", f"p_dec + {half!r}", half))))
    return rows.withColumn("_cell", F.expr(cells.own("ra", "dec", half))).join(p, "_cell").where(F.expr(sky.chebyshev("ra", "dec", "p_ra", "p_dec")) <= half).drop("_cell")


def coverage(plates: DataFrame, rows: DataFrame, half: float) -> DataFrame:
    """Of each plate the rows it covers; 0 where it covers none."""
    n = boxed(rows.select("ra", "dec"), plates, half).groupBy("plate_id").agg(F.count("*").alias("covered"))
    return plates.select("id").join(n, F.col("id") == F.col("plate_id"), "left").select("id", F.coalesce("covered", F.lit(0)).alias("covered"))


def other_plates(rows: DataFrame, key: str, own: str, plates: DataFrame, half: float) -> DataFrame:
    """Key and others, the number of plates that have the row in their square besides its own."""
    n = boxed(rows.select(key, own, "ra", "dec"), plates, half).where(F.col(own).isNull() | (F.col("plate_id") != F.col(own))).groupBy(key).agg(F.count("*").alias("others"))
    return rows.select(key).join(n, key, "left").select(key, F.coalesce("others", F.lit(0)).alias("others"))


def per_plate_nearest(reference: DataFrame, detections: DataFrame, plates: DataFrame, half: float, radius: float) -> DataFrame:
    """Of each reference row and each plate that covers it the nearest detection on that plate."""
    at = boxed(reference.select("id", "ra", "dec"), plates, half).select("id", "plate_id", "ra", "dec")
    return nearest(at, detections.select("plate_id", "id", "ra", "dec"), radius, ["id", "plate_id"], "id", ["plate_id"])


def two_epochs(catalogue: DataFrame, detections: DataFrame, years: float, radius: float) -> DataFrame:
    """Nearest detection of each catalogue row at its own and at its moved position, nulls without one."""
    moved = sky.propagate("ra", "dec", "pmra", "pmdec", repr(float(years)))
    out = catalogue.select("id")
    for k, at in (("0", ("ra", "dec")), ("1", moved)):
        placed = catalogue.select("id", F.expr(at[0]).alias("x"), F.expr(at[1]).alias("y")).toDF("id", "ra", "dec")
        best = nearest(placed, detections.select("id", "ra", "dec"), radius, ["id"], "id")
        out = out.join(best.select("id", F.col("r_id").alias(f"match{k}"), F.col("sep_arcsec").alias(f"sep{k}")), "id", "left")
    return out


def recovered(rows: DataFrame, catalogue: DataFrame, by: str, wide: float, narrow: float) -> DataFrame:
    """Per group the median offset of nearest matches within `wide`, and the rows matched within `narrow` before and
    after it is taken off."""
    best = nearest(rows.select("id", by, "ra", "dec"), catalogue.select("id", "ra", "dec"), wide, ["id"], "id")
    x, y = sky.tangent_offsets("r_ra", "r_dec", "ra", "dec")
    best = best.select(by, "ra", "dec", "id", F.expr(x).alias("x"), F.expr(y).alias("y"))
    offset = best.groupBy(by).agg(F.count("*").alias("n"), F.median("x").alias("mx"), F.median("y").alias("my"))
    moved = best.join(offset, by).select("id", by, F.expr("ra + mx / 3600 / cos(radians(dec))").alias("ra"), F.expr("dec + my / 3600").alias("dec"))
    hits = lambda t, name: matched_keys(t, catalogue, narrow, ["id"]).join(t.select("id", by), "id").groupBy(by).agg(F.count("*").alias(name))
    out = offset.join(hits(best, "before"), by, "left").join(hits(moved, "after"), by, "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("before", "after")})


def field_points(centres: DataFrame, times: int, reach: float, seed: int = 1) -> DataFrame:
    """`times` points in a disc of `reach` degrees around each centre, uniform by area, from an arithmetic hash of
    centre, number and seed, so that a rerun gives the same points."""
    h = lambda m: f"(((CAST(id AS BIGINT) + 1) * {m} + CAST(k AS BIGINT) * 7919 + {seed} * 104729) * 48271 % 2147483647 * 48271 % 2147483647 / 2147483647e0)"
    p = centres.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    ra, dec = sky.destination("ra", "dec", f"({reach}e0*sqrt({h(15485863)}))", f"(360*{h(32452843)})")
    return p.select("id", "k", F.expr(ra).alias("ra"), F.expr(dec).alias("dec"))


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows numbered from 0 in one order."""
    return running(df, [order], {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def bootstrap(rows: DataFrame, by: str, value: str, times: int, seed: int = 1) -> DataFrame:
    """Cluster bootstrap of the mean: clusters (integer keys) get Poisson weights per replicate from a seeded hash."""
    tile = rows.groupBy(by).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    r = tile.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = F.expr(f"({seeded_text(f'CAST({by} AS BIGINT) * 1009 + rep', seed)} / {MOD}e0)")
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    r = r.withColumn("w", sum((F.when(u > c, 1).otherwise(0) for c in cuts[1:]), F.when(u > cuts[0], 1).otherwise(0)))
    means = r.groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.count("m").alias("replicates"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def stratified_sample(rows: DataFrame, by: list[str], key: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows of each stratum, by a seeded hash of an integer key."""
    w = Window.partitionBy(*by).orderBy(F.expr(seeded_text(key, seed)), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def unique_mapping(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value (must be empty)."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def peak_significance(df: DataFrame, values: str) -> DataFrame:
    """(largest - median) / (1.4826 MAD) of an array column, as peak_sigma; null for empty arrays and a MAD of 0.

    Null and NaN values are left out.
    """

    def middle(a):
        n = F.size(a)
        s = F.sort_array(a)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    v = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    out = df.withColumn("_v", v).withColumn("_m", F.when(F.size("_v") > 0, middle(F.col("_v"))))
    out = out.withColumn("_mad", middle(F.transform("_v", lambda x: F.abs(x - F.col("_m")))))
    return out.withColumn("peak_sigma", F.when(F.col("_mad") > 0, (F.array_max("_v") - F.col("_m")) / (1.4826 * F.col("_mad")))).drop("_v", "_m", "_mad")
