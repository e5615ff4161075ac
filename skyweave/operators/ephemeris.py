"""Epoch-aware matching (A12, SKYBOT): tabulated positions of moving bodies against detections, each at its own epoch.

The table is turned into segments, from each tabulated time of a body to the next. A detection's epoch lies in one segment
of a body; the position there is interpolated between its ends. This as-of join is an equi-join on (time bucket, sky
cell): a detection has one of each, a segment one row for each bucket it lasts and each cell that its path in that
bucket comes near to. Segments of buckets without detections are dropped before they are parted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import sky

from . import cells


def segments(table: DataFrame, body: str = "body_id", longest: float | None = None) -> DataFrame:
    """(body, t0, ra0, dec0, t1, ra1, dec1, closed) of a table (body, t, ra, dec); ra1 continues ra0 over 0 and 360 degrees.

    Rows without a time or position are left out; of rows of one body and time the first by position counts. A gap
    of more than `longest` days is no segment: nothing is known there. closed: no segment follows at t1, which then counts.
    """
    known = table.where("t IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL").groupBy(body, "t").agg(F.min(F.struct("ra", "dec")).alias("p"))
    w = Window.partitionBy(body).orderBy("t")
    s = known.select(body, F.col("t").alias("t0"), F.col("p.ra").alias("ra0"), F.col("p.dec").alias("dec0"), F.lead(F.struct("t", "p.ra", "p.dec")).over(w).alias("n"), F.lead("t", 2).over(w).alias("then")).where("n IS NOT NULL")
    s = s.withColumn("closed", F.col("then").isNull() if longest is None else F.coalesce(F.col("then") - F.col("n.t") > longest, F.lit(True)))
    s = s.select(body, "t0", "ra0", "dec0", F.col("n.t").alias("t1"), F.expr(f"ra0 + {sky.wrap180('n.ra - ra0')}").alias("ra1"), F.col("n.dec").alias("dec1"), "closed")
    return s if longest is None else s.where(F.col("t1") - F.col("t0") <= longest)


def _at(t: str) -> tuple[str, str]:
    share = f"(({t}-t0)/(t1-t0))"
    return f"(ra0+{share}*(ra1-ra0))", f"(dec0+{share}*(dec1-dec0))"


def positions(rows: DataFrame, key: str, paths: DataFrame, reach: float, body: str = "body_id", days: float = 1.0, width: float = 1.0) -> DataFrame:
    """Rows (key, ra, dec, mjd) with the bodies within `reach` arcsec at their epoch: key, body, r_ra, r_dec, sep_arcsec.

    `days` is the length of a time bucket, `width` the size of a cell in degrees. A time at which two segments meet
    belongs to the later one.
    """
    bucket = lambda t: f"CAST(floor({t}/{days!r}) AS BIGINT)"
    asked = rows.where("ra IS NOT NULL AND dec IS NOT NULL AND mjd IS NOT NULL").selectExpr(key, "ra", "dec", "mjd", f"{bucket('mjd')} AS _time", f"{cells.own('ra', 'dec', width)} AS _cell")
    parted = paths.withColumn("_time", F.explode(F.expr(f"sequence({bucket('t0')}, {bucket('t1')})")))
    parted = parted.join(asked.select("_time").distinct(), "_time", "left_semi")
    ends = [_at(t) for t in (f"greatest(t0, _time*{days!r})", f"least(t1, (_time+1)*{days!r})")]
    sides = [(f"least({a}, {b})", f"greatest({a}, {b})") for a, b in zip(*ends, strict=True)]
    pad = reach / 3600
    wide = f"least(180e0, {pad!r}/greatest(1e-3, cos(radians(least(90e0, greatest(abs({sides[1][0]}), abs({sides[1][1]}))+{pad!r})))))"
    near = cells.touched(f"{sides[0][0]}-{wide}", f"{sides[0][1]}+{wide}", f"{sides[1][0]}-{pad!r}", f"{sides[1][1]}+{pad!r}", width)
    parted = parted.withColumn("_cell", F.explode(F.expr(near)))
    met = asked.join(parted, ["_time", "_cell"]).where("mjd >= t0 AND (mjd < t1 OR mjd = t1 AND closed)")
    ra, dec = _at("mjd")
    met = met.selectExpr(key, body, "ra", "dec", f"{sky.wrap360(ra)} AS r_ra", f"{dec} AS r_dec")
    return met.withColumn("sep_arcsec", F.expr(sky.haversine("ra", "dec", "r_ra", "r_dec"))).where(F.col("sep_arcsec") <= reach).select(key, body, "r_ra", "r_dec", "sep_arcsec")


def moving_flags(rows: DataFrame, key: str, table: DataFrame, strict: float = 5.0, wide: float = 60.0, body: str = "body_id", longest: float | None = None) -> DataFrame:
    """Of each row body_id and best_sep (nearest body within `wide` at the row's epoch, smallest id at ties), matched_count, and
    epoch_status: no_epoch, not_tabulated (before the first or after the last tabulated time), or ok."""
    near = positions(rows, key, segments(table, body, longest), wide, body)
    best = near.groupBy(key).agg(F.min_by(F.struct(body, "sep_arcsec"), F.struct("sep_arcsec", body)).alias("b"), F.count("*").alias("n"))
    span = table.where("ra IS NOT NULL AND dec IS NOT NULL").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    out = rows.select(key, "mjd").crossJoin(F.broadcast(span)).join(best, key, "left")  # span is one row
    state = F.when(F.col("mjd").isNull(), "no_epoch").when(F.col("mjd").between(F.col("_lo"), F.col("_hi")), "ok").otherwise("not_tabulated")
    sep = F.col("b.sep_arcsec")
    return out.select(key, F.col(f"b.{body}").alias(body), sep.alias("best_sep"), F.coalesce("n", F.lit(0)).alias("matched_count"), F.coalesce(sep <= strict, F.lit(False)).alias("strict_match"), F.coalesce((sep > strict) & (sep <= wide), F.lit(False)).alias("wide_match"), state.alias("epoch_status"))
