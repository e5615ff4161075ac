"""Audits of finished catalogues: contamination, motion strata, survey classes, veto bias, neighbour plates, runs, fields.

Each is a radius join or two and grouped sums; populations are never sampled but where a cap is the rule (E11), and then by
a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import sky

from .skyjoin import matched_keys, nearest, pairs, tagged_matches
from .validate import nearest_plates, seeded_text

def contamination(rows: DataFrame, stars: DataFrame, key: str, tile: str, cap: int = 200, radius: float = 5, least: int = 5, most: float = 0.2, seed: int = 1) -> DataFrame:
    """Per tile n_rows, checked (at most `cap`, by a seeded hash of the integer key), matched (a star nearer than radius;
    strictly), fraction, exempt (fewer than `least` rows) and passes (exempt, or a fraction of at most `most`)."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(tile).orderBy(F.expr(seeded_text(key, seed)), key)))
    some = ranked.where(F.col("_n") <= cap).select(key, tile, "ra", "dec")  # the limit is applied before the shuffle
    hits = pairs(some.select(key, "ra", "dec"), stars.select("ra", "dec"), radius, strict=True).select(key).distinct().withColumn("_hit", F.lit(1))
    held = rows.groupBy(tile).agg(F.count("*").alias("n_rows"))
    out = some.join(hits, key, "left").groupBy(tile).agg(F.count("*").alias("checked"), F.count("_hit").alias("matched")).join(held, tile)
    out = out.withColumn("fraction", F.col("matched") / F.col("checked")).withColumn("exempt", F.col("n_rows") < least)
    return out.withColumn("passes", F.col("exempt") | (F.col("fraction") <= most))


def contamination_gate(tiles: DataFrame, most_total: float = 0.05) -> DataFrame:
    """E11, the release gate: the overall fraction counts small tiles too; a tile that fails fails the gate."""
    out = tiles.agg(F.sum("checked").alias("checked"), F.sum("matched").alias("matched"), F.count(F.when(~F.col("passes"), 1)).alias("bad_tiles"), F.count(F.when(F.col("exempt"), 1)).alias("exempt_tiles"))
    share = F.coalesce(F.col("matched") / F.col("checked"), F.lit(0.0))
    return out.withColumn("fraction", share).withColumn("passes", (share <= most_total) & (F.col("bad_tiles") == 0))


def survey_classes(rows: DataFrame, catalogue: DataFrame, key: str, radius: float = 5) -> DataFrame:
    """Of rows with a match the survey class of the nearest (id, ra, dec, b1mag, r1mag, b2mag, r2mag, imag): a second
    optical epoch, both first colours, the first red plate alone (circular), or other; with n, share and near-infrared."""
    has = {m: F.col(f"r_{m}").isNotNull() & ~F.isnan(f"r_{m}") for m in ("b1mag", "r1mag", "b2mag", "r2mag", "imag")}
    near = nearest(rows.select(key, "ra", "dec"), catalogue, radius, [key], "id")
    named = F.when(has["b2mag"] | has["r2mag"], "second_epoch_optical").when(has["b1mag"], "first_epoch_both").when(has["r1mag"], "first_epoch_red_only").otherwise("other")
    by = near.groupBy(named.alias("class")).agg(F.count("*").alias("n"), F.count(F.when(has["imag"], 1)).alias("near_infrared"))
    total = near.agg(F.count("*").alias("_all"))
    return by.crossJoin(F.broadcast(total)).select("class", "n", "near_infrared", (100 * F.col("n") / F.col("_all")).alias("share"))  # one row of totals


def motion_strata(claims: DataFrame, truth: DataFrame, area: float, years: float = -50, radius: float = 5, high: float = 100, low: float = 20, factor: float = 2) -> tuple[DataFrame, DataFrame]:
    """Are claimed proper motions real? claims (id, ra, dec, pmra, pmdec, r1mag), truth (id, ra, dec, pmra, pmdec).

    genuine: the source where the claim was at the earlier epoch (moved by `years`) moves as fast, within `factor`;
    fabricated: not genuine, and the source at the claim's own place moves less than `low`; else indeterminate. Strata: high
    (at least `high` mas a year), high_red (and seen on the red plate), control (below `low`). The second table has the fast
    sources of either catalogue for each square degree of `area`, and by how much claims exceed the truth.
    """
    speed = lambda a, b: F.sqrt(F.pow(F.coalesce(a, F.lit(0.0)), 2) + F.pow(F.coalesce(b, F.lit(0.0)), 2))
    known = truth.select("id", "ra", "dec", F.when(F.col("pmra").isNotNull() & F.col("pmdec").isNotNull(), speed(F.col("pmra"), F.col("pmdec"))).alias("pm"))
    out = claims.select("id", speed(F.col("pmra"), F.col("pmdec")).alias("pm"), (F.col("r1mag").isNotNull() & ~F.isnan("r1mag")).alias("red"))
    for k, (ra, dec) in enumerate((("ra", "dec"), sky.propagate_stage("ra", "dec", "pmra", "pmdec", repr(float(years))))):
        at = claims.select("id", F.expr(ra).alias("_ra"), F.expr(dec).alias("_dec")).toDF("id", "ra", "dec")
        out = out.join(nearest(at, known, radius, ["id"], "id").select("id", F.col("r_pm").alias(f"pm{k}")), "id", "left")
    ratio = F.col("pm") / F.col("pm1")
    genuine = F.coalesce((F.col("pm1") > 0) & (ratio <= factor) & (ratio >= 1 / factor), F.lit(False))
    fabricated = F.coalesce(F.col("pm0") < low, F.lit(False)) & ~genuine
    out = out.withColumns({"genuine": genuine, "fabricated": fabricated})
    fast, slow = F.col("pm") >= high, F.col("pm") < low
    strata = F.array_compact(F.array(F.when(fast, "high"), F.when(fast & F.col("red"), "high_red"), F.when(slow, "control")))
    table = out.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(F.count("*").alias("n"), F.count(F.when(F.col("genuine"), 1)).alias("genuine"), F.count(F.when(F.col("fabricated"), 1)).alias("fabricated"))
    table = table.withColumn("indeterminate", F.col("n") - F.col("genuine") - F.col("fabricated"))
    claimed = out.agg(F.count(F.when(fast, 1)).alias("claimed"))
    true = known.agg(F.count(F.when(F.col("pm") >= high, 1)).alias("true"))
    density = claimed.crossJoin(true).select("claimed", "true", (F.col("claimed") / area).alias("claimed_per_deg2"), (F.col("true") / area).alias("true_per_deg2"), (F.col("claimed") / F.nullif("true", F.lit(0))).alias("overclaim"))  # one row each
    return table, density


def veto_bias(rows: DataFrame, catalogues: dict[str, DataFrame], key: str, tile: str, moved: tuple[str, str], shift_arcmin: float = 5, radius: float = 5, least: int = 50) -> DataFrame:
    """Does a refit raise the match rate of the catalogue it was fitted to more than that of others?

    Rows have ra, dec and, by the names in `moved`, refitted positions. Per catalogue the mean over tiles (of `least` rows or
    more) of the share of rows matched, raw and refit, each with a null arm displaced by shift_arcmin, and delta = refit - raw.
    """
    off = shift_arcmin / 60
    arms = {"raw": ("ra", "dec"), "refit": moved}
    places = [(f"{a}{n}", f"{x} + {s!r} / cos(radians({y}))" if s else x, y) for a, (x, y) in arms.items() for n, s in (("", 0.0), ("_null", off))]
    one = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.expr(sky.wrap360(x)).alias("ra"), F.expr(y).cast("double").alias("dec")) for a, x, y in places)))
    armed = rows.select(key, tile, one.alias("p")).select(F.concat_ws(":", F.col(key).cast("string"), "p.arm").alias("_key"), tile, "p.*")
    hits = tagged_matches(armed, "_key", catalogues, radius)
    by = armed.join(hits, "_key", "left").groupBy(tile, "arm").agg(F.count("*").alias("n"), *((F.count(f"{c}_match_id") / F.count("*")).alias(c) for c in catalogues)).where(F.col("n") >= least)
    mean = by.groupBy("arm").agg(*(F.avg(c).alias(c) for c in catalogues))
    long = mean.select("arm", F.explode(F.create_map(*(x for c in catalogues for x in (F.lit(c), F.col(c))))).alias("catalogue", "share"))
    wide = long.groupBy("catalogue").agg(*(F.max(F.when(F.col("arm") == a, 100 * F.col("share"))).alias(a) for a, _, _ in places))
    return wide.withColumn("delta", F.col("refit") - F.col("raw"))


def bias_excess(bias: DataFrame, fitted: str) -> DataFrame:
    """The rise of the fitted catalogue's match rate, the mean rise of the others (controls), and the excess."""
    own = F.max(F.when(F.col("catalogue") == fitted, F.col("delta"))).alias("fitted_delta")
    out = bias.agg(own, F.avg(F.when(F.col("catalogue") != fitted, F.col("delta"))).alias("control_delta"))
    return out.withColumn("excess", F.col("fitted_delta") - F.col("control_delta"))


def neighbour_detections(rows: DataFrame, key: str, own: str, plates: DataFrame, detections: DataFrame, radius: float = 5, shift_arcmin: float = 3) -> DataFrame:
    """Of each row the nearest plate that is not its own, whether that plate has detections at all (searched), one at the
    row's place, and one at the place displaced by shift_arcmin (the null arm)."""
    near = nearest_plates(rows.select(key, own, "ra", "dec"), plates, 2)
    pick = F.when(F.col("near")[0]["plate_id"] == F.col(own), F.col("near")[1]["plate_id"]).otherwise(F.col("near")[0]["plate_id"])
    at = near.withColumn("plate_id", pick).drop("near")
    on = detections.select("plate_id", "ra", "dec")
    known = on.select("plate_id").distinct().withColumn("searched", F.lit(True))
    out = at.join(known, "plate_id", "left")
    moved = at.withColumn("ra", F.expr(sky.wrap360(f"ra + {shift_arcmin / 60!r} / cos(radians(dec))")))
    for name, place in (("detected", at), ("null_detected", moved)):
        out = out.join(matched_keys(place, on, radius, [key], ["plate_id"]).withColumn(name, F.lit(True)), key, "left")
    flags = ("searched", "detected", "null_detected")
    return out.select(key, own, F.col("plate_id").alias("neighbour"), *(F.coalesce(c, F.lit(False)).alias(c) for c in flags))


def decomposition(reference: DataFrame, final: DataFrame, detections: DataFrame, radius: float = 5) -> DataFrame:
    """Of the reference rows those found in the final list, those detected but not in it, and those never detected."""
    hit = lambda t, n: matched_keys(reference, t, radius, ["id"]).withColumn(n, F.lit(True))
    told = reference.select("id").join(hit(final, "_f"), "id", "left").join(hit(detections, "_d"), "id", "left")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    kept, seen = F.coalesce("_f", F.lit(False)), F.coalesce("_d", F.lit(False))
    return told.agg(F.count("*").alias("n_rows"), count(kept, "in_set"), count(seen & ~kept, "detected_not_in_set"), count(~seen, "not_detected"))


def run_funnel(tables: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Stage, and of each run the rows of its table (null where it has none): {stage: {run: table}}."""
    runs = list(dict.fromkeys(r for t in tables.values() for r in t))
    counts = None
    for k, (stage, by_run) in enumerate(tables.items()):
        for run, t in by_run.items():
            one = t.agg(F.lit(k).alias("step"), F.lit(stage).alias("stage"), F.lit(run).alias("run"), F.count("*").alias("n"))
            counts = one if counts is None else counts.union(one)
    return counts.groupBy("step", "stage").pivot("run", runs).agg(F.first("n")).orderBy("step")


def survivors_once(runs: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of all runs, of each key that of the first run which has it."""
    both = None
    for k, (run, t) in enumerate(runs.items()):
        one = t.withColumns({"run_id": F.lit(run), "_run": F.lit(k)})
        both = one if both is None else both.unionByName(one)
    rest = [c for c in both.columns if c not in (key, "_run")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_run", *rest)).alias("_b")).select(key, "_b.*")


def field_grid(rows: DataFrame, plate: str, epoch: str, step_arcmin: float) -> DataFrame:
    """Fields of a declination bucket, a right ascension bucket scaled by its own cosine, and a plate: median centre,
    most frequent epoch (the smallest of several) and rows."""
    step = step_arcmin / 60
    dec = F.expr(f"CAST(floor((dec + 90) / {step!r}) AS BIGINT)").alias("dec_bucket")
    ra = F.expr(f"CAST(floor({sky.wrap360('ra')} / ({step!r} / least(1e0, greatest(1e-4, cos(radians(dec)))))) AS BIGINT)").alias("ra_bucket")
    placed = rows.select(dec, ra, plate, epoch, F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
    by = ["dec_bucket", "ra_bucket", plate]
    often = placed.where(F.col(epoch).isNotNull()).groupBy(*by, epoch).agg(F.count("*").alias("_c")).groupBy(*by).agg(F.min(F.struct(-F.col("_c"), epoch))[epoch].alias(epoch))
    centres = placed.groupBy(*by).agg(F.median("_ra").alias("ra_f"), F.median("_dec").alias("dec_f"), F.count("*").alias("n"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    return centres.alias("c").join(often.alias("o"), same, "left").select("c.*", f"o.{epoch}")


def cumulative(distances: DataFrame, radii: list[float]) -> DataFrame:
    """Of distances with an arm (real or null) how many are within each radius, inclusive, and the excess."""
    within = lambda arm, r: F.count(F.when((F.col("arm") == arm) & (F.col("dist") <= r), 1))
    rows = distances.agg(F.array(*(F.struct(F.lit(float(r)).alias("radius"), within("real", r).alias("n_real"), within("null", r).alias("n_null")) for r in radii)).alias("c"))
    return rows.select(F.explode("c").alias("c")).select("c.*").withColumn("excess", F.col("n_real") - F.col("n_null"))


def joined_once(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their dimension row, or nulls; ValueError where a key of the dimension repeats."""
    if dimension.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats in the dimension")
    return rows.join(dimension, key, "left")


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that one of two sets has and the other lacks: added or lost."""
    a, b = before.select(key).withColumn("_a", F.lit(True)), after.select(key).withColumn("_b", F.lit(True))
    both = a.join(b, key, "full").where("_a IS NULL OR _b IS NULL")
    return both.select(key, F.when(F.col("_a").isNull(), "added").otherwise("lost").alias("change"))


def merged_headers(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables whose columns differ, under the union of their names; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
