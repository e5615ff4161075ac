"""Queries of the audits, with oracles by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import audit, filters, skyjoin
from skyweave.operators import veto as vetoes
from skyweave.sources import catalogue
from skyweave.sources.shared import shared_folder
from skyweave.sources.views import cte, view

from .registry import HAV, RADII, _arms, _armed, near, query

_M = 2147483647
_hash = lambda k, seed: f"((CAST({k} AS BIGINT) + 1) * 15485863 % {_M} + {seed} * 104729) * 48271 % {_M} * 48271 % {_M}"
_strict = f"EXISTS (SELECT 1 FROM cat_b b WHERE abs(a.dec - b.dec) <= 5 / 3600e0 + 1e-9 AND {HAV} < 5)"
_checked = f"k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY {_hash('id', 1)}, id) AS place, count(*) OVER (PARTITION BY tile_id) AS n_rows FROM det), t AS (SELECT tile_id, any_value(n_rows) AS n_rows, count(*) AS checked, count(*) FILTER ({_strict}) AS matched FROM k a WHERE place <= 40 GROUP BY tile_id), g AS (SELECT *, matched / checked AS fraction, n_rows < 10 AS exempt FROM t)"


def _audited(spark, d):
    return audit.contamination(view(spark, d, "det").select("id", "tile_id", "ra", "dec"), view(spark, d, "cat_b"), "id", "tile_id", 40, 5, 10, 0.12)


@query("E11 F04 R1", cte("det", "cat_b") + f", {_checked} SELECT tile_id, n_rows, checked, matched, round(fraction, 6) AS fraction, exempt, exempt OR fraction <= 0.12 AS passes FROM g")
def contaminated_tiles(spark, d):
    return _audited(spark, d).withColumn("fraction", F.round("fraction", 6))


@query("E11", cte("det", "cat_b") + f", {_checked} SELECT CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(matched) AS BIGINT) AS matched, count(*) FILTER (NOT exempt AND fraction > 0.12) AS bad_tiles, count(*) FILTER (exempt) AS exempt_tiles, round(sum(matched) / sum(checked), 6) AS fraction, sum(matched) / sum(checked) <= 0.08 AND count(*) FILTER (NOT exempt AND fraction > 0.12) = 0 AS passes FROM g")
def release_gate(spark, d):
    return audit.contamination_gate(_audited(spark, d), 0.08).withColumn("fraction", F.round("fraction", 6))


_survey = "id, ra, dec, pmra, pmdec, CASE WHEN band % 2 = 0 THEN 15e0 END AS b1mag, CASE WHEN band % 3 <> 1 THEN 14e0 END AS r1mag, CASE WHEN band % 5 = 2 THEN 15e0 END AS b2mag, CASE WHEN band % 7 = 3 THEN 14e0 END AS r2mag, CASE WHEN band % 4 = 1 THEN 13e0 END AS imag"


@query("E20", cte("det", "cat_b") + f", s AS (SELECT {_survey} FROM cat_b), p AS (SELECT a.id, b.id AS r, {HAV} AS d, CASE WHEN b2mag IS NOT NULL OR r2mag IS NOT NULL THEN 'second_epoch_optical' WHEN b1mag IS NOT NULL THEN 'first_epoch_both' WHEN r1mag IS NOT NULL THEN 'first_epoch_red_only' ELSE 'other' END AS class, imag IS NOT NULL AS ir FROM det a JOIN s b ON {near(10)}), n AS (SELECT id, arg_min(class, (d, r)) AS class, arg_min(ir, (d, r)) AS ir FROM p GROUP BY id) SELECT class, count(*) AS n, count(*) FILTER (ir) AS near_infrared, round(100e0 * count(*) / (SELECT count(*) FROM n), 6) AS share FROM n GROUP BY class")
def class_breakdown(spark, d):
    c = audit.survey_classes(view(spark, d, "det"), view(spark, d, "cat_b").selectExpr(*[x.strip() for x in _survey.split(", ")]), "id", 10)
    return c.withColumn("share", F.round("share", 6))


#: The second catalogue of motions: some claims agree with it, others do not.
_truth = "SELECT id, ra + ((id * 5) % 7) * 0.4e0 / 3600 AS ra, dec, CASE WHEN id % 4 <> 3 THEN (CASE WHEN id % 2 = 0 THEN ((id * 7) % 401) - 200e0 ELSE 3e0 END) END AS pmra, CASE WHEN id % 4 <> 3 THEN 4e0 END AS pmdec FROM {cat_a}"
_claims = "SELECT id, ra, dec, pmra, pmdec, CASE WHEN band % 3 <> 1 THEN 14e0 END AS r1mag FROM {cat_b}"
_speed = "sqrt(pow(coalesce(pmra, 0), 2) + pow(coalesce(pmdec, 0), 2))"
_shifted = "dec + coalesce(pmdec, 0) * -50 / 3.6e6"
_motions = cte("cat_a", "cat_b") + f""", tr AS (SELECT id, ra, dec, CASE WHEN pmra IS NOT NULL AND pmdec IS NOT NULL THEN {_speed} END AS pm FROM ({_truth.format(cat_a='cat_a')})), cl AS (SELECT *, {_speed} AS pm FROM ({_claims.format(cat_b='cat_b')})),
m AS (SELECT id, {_shifted} AS dec, ra + coalesce(pmra, 0) * -50 / 3.6e6 / cos(radians({_shifted})) AS ra FROM cl),
p0 AS (SELECT a.id, arg_min(b.id, ({HAV}, b.id)) AS r FROM cl a JOIN tr b ON {near(8)} GROUP BY a.id), p1 AS (SELECT a.id, arg_min(b.id, ({HAV}, b.id)) AS r FROM m a JOIN tr b ON {near(8)} GROUP BY a.id),
j AS (SELECT cl.*, t0.pm AS pm0, t1.pm AS pm1 FROM cl LEFT JOIN p0 ON p0.id = cl.id LEFT JOIN tr t0 ON t0.id = p0.r LEFT JOIN p1 ON p1.id = cl.id LEFT JOIN tr t1 ON t1.id = p1.r),
k AS (SELECT *, coalesce(pm1 > 0 AND pm / pm1 <= 2 AND pm / pm1 >= 0.5, false) AS genuine FROM j), o AS (SELECT *, coalesce(pm0 < 20, false) AND NOT genuine AS fabricated FROM k),
z AS (SELECT *, 'high' AS stratum FROM o WHERE pm >= 100 UNION ALL SELECT *, 'high_red' FROM o WHERE pm >= 100 AND r1mag IS NOT NULL UNION ALL SELECT *, 'control' FROM o WHERE pm < 20)"""


def _strata(spark, d):
    claims, truth = spark.sql(_claims, cat_b=view(spark, d, "cat_b")), spark.sql(_truth, cat_a=view(spark, d, "cat_a"))
    return audit.motion_strata(claims, truth, 25.0, radius=8)


@query("E21", _motions + " SELECT stratum, count(*) AS n, count(*) FILTER (genuine) AS genuine, count(*) FILTER (fabricated) AS fabricated, count(*) FILTER (NOT genuine AND NOT fabricated) AS indeterminate FROM z GROUP BY stratum")
def motion_strata(spark, d):
    return _strata(spark, d)[0]


@query("E21", _motions + " SELECT claimed, true_n AS true, round(claimed / 25e0, 6) AS claimed_per_deg2, round(true_n / 25e0, 6) AS true_per_deg2, round(claimed / true_n, 6) AS overclaim FROM (SELECT count(*) FILTER (pm >= 100) AS claimed FROM cl), (SELECT count(*) FILTER (pm >= 100) AS true_n FROM tr)")
def strata_density(spark, d):
    return _strata(spark, d)[1].select("claimed", "true", *(F.round(c, 6).alias(c) for c in ("claimed_per_deg2", "true_per_deg2", "overclaim")))


_refit = ("ra - ((id * 13) % 20) * 0.1e0 / 3600", "dec + ((id * 13) % 20) * 0.45e0 / 3600")
_four = ", ".join(["('raw', a.ra, a.dec)", "('refit', x, y)", "('raw_null', a.ra + 0.1e0 / cos(radians(a.dec)), a.dec)", "('refit_null', x + 0.1e0 / cos(radians(y)), y)"])


@query("E23 D14", cte("det", "cat_a", "cat_b", "cat_c") + f", q AS (SELECT *, {_refit[0]} AS x, {_refit[1]} AS y FROM det), w AS (SELECT a.id, a.tile_id % 30 AS tile, v.arm, {sky.wrap360('v.ra')} AS ra, v.dec FROM q a, LATERAL (VALUES {_four}) v(arm, ra, dec)), h AS (SELECT a.*, " + ", ".join(f"EXISTS (SELECT 1 FROM {c} b WHERE {near(5)}) AS {c}" for c in ("cat_a", "cat_b", "cat_c")) + " FROM w a), t AS (SELECT tile, arm, " + ", ".join(f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END) AS {c}" for c in ("cat_a", "cat_b", "cat_c")) + " FROM h GROUP BY tile, arm HAVING count(*) >= 5), m AS (UNPIVOT (SELECT arm, avg(cat_a) AS cat_a, avg(cat_b) AS cat_b, avg(cat_c) AS cat_c FROM t GROUP BY arm) ON cat_a, cat_b, cat_c INTO NAME catalogue VALUE share) SELECT catalogue, " + ", ".join(f"round(100 * max(share) FILTER (arm = '{a}'), 6) AS {a}" for a in ("raw", "raw_null", "refit", "refit_null")) + ", round(100 * (max(share) FILTER (arm = 'refit') - max(share) FILTER (arm = 'raw')), 6) AS delta FROM m GROUP BY catalogue")
def veto_bias(spark, d):
    rows = view(spark, d, "det").selectExpr("id", "tile_id % 30 AS tile", "ra", "dec", f"{_refit[0]} AS x", f"{_refit[1]} AS y")
    b = audit.veto_bias(rows, {c: view(spark, d, c).select("id", "ra", "dec") for c in ("cat_a", "cat_b", "cat_c")}, "id", "tile", ("x", "y"), 6, 5, 5)
    return b.select("catalogue", *(F.round(c, 6).alias(c) for c in ("raw", "raw_null", "refit", "refit_null", "delta")))


_sepdeg = f"{sky.haversine('a.ra', 'a.dec', 'p.ra', 'p.dec')} / 3600"


@query("D19 D11 D14", cte("ref", "det", "plates") + f""", own AS (SELECT id, id % 25 AS plate, ra, dec FROM ref), o AS (SELECT id AS det, floor(ra / 14.4e0) AS plate, ra, dec FROM det WHERE floor(ra / 14.4e0) <> 3),
n AS (SELECT a.*, p.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY {_sepdeg}, p.id) AS k FROM own a JOIN plates p ON p.id <> a.plate), a AS (SELECT * FROM n WHERE k = 1), s AS (SELECT id, {sky.wrap360('ra + 0.05e0 / cos(radians(dec))')} AS ra, dec, neighbour FROM a)
SELECT a.id, a.plate, a.neighbour, a.neighbour IN (SELECT plate FROM o) AS searched, EXISTS (SELECT 1 FROM o b WHERE b.plate = a.neighbour AND {near(5)}) AS detected, (SELECT EXISTS (SELECT 1 FROM o b WHERE b.plate = s.neighbour AND {near(5).replace('a.', 's.')}) FROM s WHERE s.id = a.id) AS null_detected FROM a""")
def neighbour_detections(spark, d):
    own = view(spark, d, "ref").selectExpr("id", "id % 25 AS plate", "ra", "dec")
    det = view(spark, d, "det").selectExpr("floor(ra / 14.4e0) AS plate_id", "ra", "dec").where("plate_id <> 3")
    plates = view(spark, d, "plates").selectExpr("CAST(id AS BIGINT) AS id", "ra", "dec")
    return audit.neighbour_detections(own, "id", "plate", plates, det)


_found = lambda t: f"EXISTS (SELECT 1 FROM {t} b WHERE {near(5)})"


@query("E15", cte("det", "ref") + f", s AS (SELECT * FROM det WHERE flags = 0), w AS (SELECT a.id, {_found('s')} AS f, {_found('det')} AS g FROM ref a) SELECT count(*) AS n_rows, count(*) FILTER (f) AS in_set, count(*) FILTER (g AND NOT f) AS detected_not_in_set, count(*) FILTER (NOT g) AS not_detected FROM w")
def decomposition(spark, d):
    det = view(spark, d, "det")
    return audit.decomposition(view(spark, d, "ref"), det.where("flags = 0"), det)


_runs = {"run_a": "id % 3 = 0", "run_b": "id % 2 = 0", "run_c": "id % 5 = 1"}
_cuts = {"raw": "true", "extract": "flags = 0", "bright": "flags = 0 AND snr > 60"}


@query("E22", cte("det") + " " + " UNION ALL ".join(f"SELECT {k} AS step, '{s}' AS stage, " + ", ".join(f"count(*) FILTER ({w}) AS {r}" if (r, s) != ("run_c", "bright") else f"CAST(NULL AS BIGINT) AS {r}" for r, w in _runs.items()) + f" FROM det WHERE {c}" for k, (s, c) in enumerate(_cuts.items())))
def cross_run_funnel(spark, d):
    det = view(spark, d, "det")
    return audit.run_funnel({s: {r: det.where(w).where(c) for r, w in _runs.items() if (r, s) != ("run_c", "bright")} for s, c in _cuts.items()})


@query("E22 F01", cte("det") + " SELECT src_id, CASE " + " ".join(f"WHEN {w} THEN '{r}'" for r, w in _runs.items()) + " END AS run_id, tile_id, id FROM det WHERE flags = 0 AND (" + " OR ".join(f"({w})" for w in _runs.values()) + ")")
def cross_run_survivors(spark, d):
    det = view(spark, d, "det").where("flags = 0").select("src_id", "tile_id", "id")
    return audit.survivors_once({r: det.where(w) for r, w in _runs.items()}, "src_id")


_bucket = "CAST(floor((dec + 90) / 0.5e0) AS BIGINT) AS dec_bucket, CAST(floor(ra / (0.5e0 / least(1e0, greatest(1e-4, cos(radians(dec)))))) AS BIGINT) AS ra_bucket, tile_id % 3 AS plate, snr, ra, dec"


@query("E10", cte("det") + f", b AS (SELECT {_bucket} FROM (SELECT id, tile_id, CASE WHEN snr > 10 THEN snr % 7 END AS snr, ra - ra % 2 AS ra, dec - dec % 3 AS dec FROM det)), e AS (SELECT *, row_number() OVER (PARTITION BY dec_bucket, ra_bucket, plate ORDER BY n DESC, snr) AS k FROM (SELECT dec_bucket, ra_bucket, plate, snr, count(*) AS n FROM b WHERE snr IS NOT NULL GROUP BY ALL)), c AS (SELECT dec_bucket, ra_bucket, plate, median(ra) AS ra_f, median(dec) AS dec_f, count(*) AS n FROM b GROUP BY ALL) SELECT c.*, snr AS epoch FROM c LEFT JOIN (SELECT dec_bucket, ra_bucket, plate, snr FROM e WHERE k = 1) USING (dec_bucket, ra_bucket, plate)".replace("c.*, snr AS epoch", "dec_bucket, ra_bucket, plate, round(ra_f, 6) AS ra_f, round(dec_f, 6) AS dec_f, n, snr AS epoch"))
def field_grid(spark, d):
    rows = view(spark, d, "det").selectExpr("tile_id % 3 AS plate", "CASE WHEN snr > 10 THEN snr % 7 END AS epoch", "ra - ra % 2 AS ra", "dec - dec % 3 AS dec")
    g = audit.field_grid(rows, "plate", "epoch", 30)
    return g.withColumns({"ra_f": F.round("ra_f", 6), "dec_f": F.round("dec_f", 6)})


@query("E07 D14", _arms + ", q AS (SELECT unnest([1.0, 2.0, 3.0, 5.0, 10.0])::DOUBLE AS radius) SELECT radius, count(*) FILTER (arm = 'real' AND dist <= radius) AS n_real, count(*) FILTER (arm = 'null' AND dist <= radius) AS n_null, count(*) FILTER (arm = 'real' AND dist <= radius) - count(*) FILTER (arm = 'null' AND dist <= radius) AS excess FROM d, q GROUP BY radius")
def cumulative_matches(spark, d):
    return audit.cumulative(_armed(spark, d), RADII)


@query("B17", cte("det") + " SELECT id, round(year(ts) + epoch_us(ts - make_timestamp(year(ts), 1, 1, 0, 0, 0e0)) / 864e8 / CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 366 ELSE 365 END, 9) AS y FROM det".replace("epoch_us(ts - make_timestamp(year(ts), 1, 1, 0, 0, 0e0))", "(epoch_us(ts) - epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0e0)))"))
def decimal_years(spark, d):
    return view(spark, d, "det").selectExpr("id", f"round({sky.decimal_year('CAST(ts AS TIMESTAMP)')}, 9) AS y")


@query("D05", cte("det", "cat_b") + f", k AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM cat_b b WHERE {near(5)})) AS kept, count(*) AS n FROM det a) SELECT 'ok' AS reason, kept FROM k UNION ALL SELECT 'empty catalogue', n FROM k UNION ALL SELECT 'disabled', n FROM k UNION ALL SELECT 'no candidates', 0 FROM k")
def veto_reasons(spark, d):
    det, cat, out = view(spark, d, "det").select("id", "ra", "dec"), view(spark, d, "cat_b"), None
    for rows, c, on in ((det, cat, True), (det, cat.where("false"), True), (det, cat, False), (det.where("false"), cat, True)):
        kept, reason = vetoes.veto(rows, c, 5, ["id"], on)
        one = kept.agg(F.lit(reason).alias("reason"), F.count("*").alias("kept"))
        out = one if out is None else out.union(one)
    return out


@query("D15", cte("det", "plates") + " SELECT a.id, a.tile_id % 30 AS plate, p.ra AS plate_ra, p.dec AS plate_dec FROM det a LEFT JOIN plates p ON p.id = a.tile_id % 30")
def tile_plates(spark, d):
    plates = view(spark, d, "plates").select(F.col("id").cast("long").alias("plate"), F.col("ra").alias("plate_ra"), F.col("dec").alias("plate_dec"))
    return audit.joined_once(view(spark, d, "det").selectExpr("id", "tile_id % 30 AS plate"), plates, "plate")


@query("H01 A11", cte("cat_a", "cat_b", "cat_c") + " SELECT id, ra, mag, n_detections, NULL::DOUBLE AS pmra, NULL::DOUBLE AS rmag FROM cat_a UNION ALL SELECT id, ra, NULL, NULL, pmra, NULL FROM cat_b UNION ALL SELECT id, ra, NULL, NULL, NULL, rmag FROM cat_c")
def merged_headers(spark, d):
    return audit.merged_headers([view(spark, d, "cat_a").select("id", "ra", "mag", "n_detections"), view(spark, d, "cat_b").select("ra", "id", "pmra"), view(spark, d, "cat_c").select("id", "ra", "rmag")])


def _arm_sql(name: str, vetoed: tuple[str, ...]) -> str:
    """The filters after some vetoes: the window of the clip comes from what they leave."""
    none = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {c} b WHERE {near(3)})" for c in vetoed)
    return f"{name}0 AS (SELECT a.*, id % 10 AS g FROM det a WHERE {none} AND flags = 0 AND snr > 30), {name}1 AS (SELECT g, median(fwhm) AS m FROM {name}0 GROUP BY g), {name}2 AS (SELECT g, 1.4826 * median(abs(fwhm - m)) AS s FROM {name}0 JOIN {name}1 USING (g) GROUP BY g), {name} AS (SELECT id FROM {name}0 JOIN {name}1 USING (g) JOIN {name}2 USING (g) WHERE fwhm IS NOT NULL AND (s <= 0 OR abs(fwhm - m) <= 1.2 * s))"


@query("H02 E24 R3", cte("det", "cat_a", "cat_b", "cat_c") + f", {_arm_sql('x', ('cat_a', 'cat_b', 'cat_c'))}, {_arm_sql('y', ('cat_a', 'cat_b'))} SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' ELSE 'lost' END AS change FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL")
def counterfactual_changes(spark, d):
    """Without the third veto rows come in, and as the clip's window moves, others go."""

    def arm(names):
        rows = view(spark, d, "det")
        for c in names:
            rows = skyjoin.anti(rows, view(spark, d, c), 3, ["id"])
        return filters.sigma_clip(filters.extract_filter(rows).withColumn("g", F.expr("id % 10")), ["fwhm"], "g", 1.2)

    return audit.set_changes(arm(["cat_a", "cat_b", "cat_c"]), arm(["cat_a", "cat_b"]), "id")


# --- cones in the layouts of their files ------------------------------------------------------------------------
_r = f"{sky.cosine_separation('ra', 'dec', '30e0', '5e0')} * 60"
_wide = "SELECT id, ra, dec, mag AS phot_g_mean_mag, CASE WHEN id % 6 = 0 THEN {nan} ELSE id % 50 - 20e0 END AS pmra, CASE WHEN id % 6 = 0 THEN {nan} ELSE id % 40 - 10e0 END AS pmdec, n_detections AS nDetections, CASE WHEN id % 8 = 0 THEN -999e0 ELSE 8e0 + id % 12 END AS rmag, CASE WHEN id % 3 = 0 THEN {nan} ELSE 10e0 + id % 9 END AS R1mag, 11e0 AS R2mag, {nan} AS B1mag, 12e0 AS B2mag, CASE WHEN id % 2 = 0 THEN 13e0 ELSE {nan} END AS Imag, CASE WHEN id % 4 = 0 THEN {nan} ELSE id % 30 - 15e0 END AS pmRA_, CASE WHEN id % 4 = 0 THEN {nan} ELSE id % 20 - 8e0 END AS pmDE FROM {cat_a}"


def _opened(spark, d, motions: dict[str, str]):
    """The catalogue by cell, with the motions under the names that its file has."""
    rows = spark.sql(_wide.replace("{nan}", "double('NaN')"), cat_a=view(spark, d, "cat_a"))
    names = [c for c in rows.columns if c not in ("pmra", "pmdec", "pmRA_", "pmDE")]
    typed = {c: f"{c} AS {rows.schema[c].dataType.simpleString()}" for c in names} | {to: f"{c} AS double" for to, c in motions.items()}
    return catalogue.prepared(rows, shared_folder(spark), typed, nside=4)


_nn = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"
_duck_wide = _wide.replace("{nan}", "CAST('NaN' AS DOUBLE)").replace("{cat_a}", "cat_a")


@query("A03 A01 A02", cte("cat_a") + f", w AS ({_duck_wide}) SELECT round(ra, 8) AS ra, round(dec, 8) AS dec, {_nn('phot_g_mean_mag')} AS Gmag, NULL::DOUBLE AS BPmag, NULL::DOUBLE AS RPmag, {_nn('pmra')} AS pmRA, {_nn('pmdec')} AS pmDE, NULL::DOUBLE AS Plx, round({_r}, 4) AS _r FROM w WHERE {_r} <= 900")
def gaia_neighbourhood(spark, d):
    c = catalogue.gaia_cone(_opened(spark, d, {"pmra": "pmra", "pmdec": "pmdec"}), 30.0, 5.0, 900.0, 4)
    return c.withColumns({"ra": F.round("ra", 8), "dec": F.round("dec", 8), "_r": F.round("_r", 4)})


@query("A05 A02 B18", cte("cat_a") + f", w AS ({_duck_wide}) SELECT round(ra, 8) AS ra, round(dec, 8) AS dec, rmag FROM w WHERE {_r} <= 900 AND nDetections >= 2 AND rmag > -900 AND rmag <= 16")
def bright_neighbourhood(spark, d):
    c = catalogue.bright_cone(_opened(spark, d, {"pmra": "pmra", "pmdec": "pmdec"}), 30.0, 5.0, 900.0, nside=4)
    return c.withColumns({"ra": F.round("ra", 8), "dec": F.round("dec", 8)})


@query("A06 A02", cte("cat_a") + f", w AS ({_duck_wide}) SELECT round(ra, 8) AS ra, round(dec, 8) AS dec, " + ", ".join(f"{_nn(m)} AS {m}" for m in ("R1mag", "R2mag", "B1mag", "B2mag", "Imag")) + f", CAST({_nn('pmRA_')} AS INTEGER) AS pmRA, CAST({_nn('pmDE')} AS INTEGER) AS pmDE, round({_r}, 4) AS _r FROM w WHERE {_r} <= 900")
def usnob_neighbourhood(spark, d):
    c = catalogue.usnob_cone(_opened(spark, d, {"pmRA": "pmRA_", "pmDE": "pmDE"}), 30.0, 5.0, 900.0, 4)
    return c.withColumns({"ra": F.round("ra", 8), "dec": F.round("dec", 8), "_r": F.round("_r", 4)})
