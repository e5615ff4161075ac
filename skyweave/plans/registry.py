"""Queries over the test tables, one or more for each operator, and their DuckDB oracles.

Names lead with what they show; the survey ids they cover are in COVERS. Oracles are written against the tables by
brute force (cross joins, EXISTS, recursion), independent of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.functions import healpix, sky
from skyweave.operators import dedup, filters, segment, skyjoin, stages, validate
from skyweave.operators import veto as vetoes
from skyweave.sources import catalogue, columns
from skyweave.sources.shared import shared_folder
from skyweave.sources.views import cte, view

QUERIES: dict = {}
ORACLES: dict = {}
COVERS: dict[str, str] = {}
HAV = sky.haversine("a.ra", "a.dec", "b.ra", "b.dec")
RADII = [1.0, 2.0, 3.0, 5.0, 10.0]


def near(r) -> str:
    return f"abs(a.dec - b.dec) <= {r} / 3600e0 + 1e-9 AND {HAV} <= {r}"


def query(covers: str, oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, covers: str, views: str, text: str, duck: str | None = None) -> None:
    """A query that is one SELECT over the views in either engine."""
    names = views.split()

    def run(spark, sf_dir):
        for n in names:
            view(spark, sf_dir, n).createOrReplaceTempView(n)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name], COVERS[name], ORACLES[name] = run, covers, cte(*names) + " " + (duck or text)


R6 = lambda x, n: f"round({x}, 6) AS {n}"
R9 = lambda x, n: f"round({x}, 9) AS {n}"

# --- radius joins -----------------------------------------------------------------------------------------------


@query("D01 D04 A11 B01 B03 B04", cte("det", "cat_a") + f" SELECT a.id, b.id AS r_id, {R6(HAV, 'sep_arcsec')} FROM det a JOIN cat_a b ON {near(5)}")
def sky_pairs_5as(spark, d):
    return skyjoin.pairs(view(spark, d, "det").select("id", "ra", "dec"), view(spark, d, "cat_a").select("id", "ra", "dec"), 5, spread="right").select("id", "r_id", F.round("sep_arcsec", 6).alias("sep_arcsec"))


@query("D03 D13 D18 G01", cte("det", "cat_a") + f", p AS (SELECT a.id, b.id AS r_id, b.mag, {HAV} AS s FROM det a JOIN cat_a b ON {near(10)}) SELECT id, arg_min(r_id, s) AS r_id, arg_min(mag, s) AS r_mag, round(min(s), 6) AS sep_arcsec FROM p GROUP BY id")
def sky_nearest_10as(spark, d):
    n = skyjoin.nearest(view(spark, d, "det").select("id", "ra", "dec"), view(spark, d, "cat_a").select("id", "ra", "dec", "mag"), 10, ["id"], "id", spread="right")
    return n.select("id", "r_id", "r_mag", F.round("sep_arcsec", 6).alias("sep_arcsec"))


@query("D09 D17", cte("det", "cat_b") + f" SELECT a.id, a.tile_id FROM det a WHERE EXISTS (SELECT 1 FROM cat_b b WHERE {near(5)})")
def sky_semi_5as(spark, d):
    return skyjoin.semi(view(spark, d, "det"), view(spark, d, "cat_b"), 5, ["id"]).select("id", "tile_id")


@query("D02 R1 R2", cte("det", "cat_b") + f" SELECT a.id, a.tile_id FROM det a WHERE NOT EXISTS (SELECT 1 FROM cat_b b WHERE {near(5)})")
def sky_anti_5as(spark, d):
    return skyjoin.anti(view(spark, d, "det"), view(spark, d, "cat_b"), 5, ["id"]).select("id", "tile_id")


@query("D03b", cte("cat_a", "cat_b") + f", p AS (SELECT a.id AS i, b.id AS j, {HAV} AS s FROM cat_a a JOIN cat_b b ON {near(10)}), m AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s, j) AS x, row_number() OVER (PARTITION BY j ORDER BY s, i) AS y FROM p) SELECT i AS id, j AS r_id, round(s, 6) AS sep_arcsec FROM m WHERE x = 1 AND y = 1")
def sky_best_symmetric(spark, d):
    return skyjoin.best_symmetric(view(spark, d, "cat_a").select("id", "ra", "dec"), view(spark, d, "cat_b"), 10, "id", "id").select("id", "r_id", F.round("sep_arcsec", 6).alias("sep_arcsec"))


# --- vetoes -----------------------------------------------------------------------------------------------------
CHAIN = ["cat_a", "cat_b", "cat_c"]
_hit = {c: f"EXISTS (SELECT 1 FROM {c} b WHERE {near(5)})" for c in CHAIN}
_flags = cte("det", *CHAIN) + ", f AS (SELECT a.id, " + ", ".join(f"{h} AS in_{c}" for c, h in _hit.items()) + " FROM det a)"


@query("D05 D06 A22", _flags + " SELECT id, in_cat_a, in_cat_b, in_cat_c, CASE WHEN in_cat_a THEN 'cat_a' WHEN in_cat_b THEN 'cat_b' WHEN in_cat_c THEN 'cat_c' ELSE 'kept' END AS outcome FROM f")
def veto_chain_flags(spark, d):
    return vetoes.chain_flags(view(spark, d, "det").select("id", "ra", "dec"), {c: view(spark, d, c) for c in CHAIN}, 5, ["id"], spread="right").drop("ra", "dec")


@query("E01 A29", _flags + " SELECT 0 AS step, 'cat_a' AS veto, count(*) AS rows_in, count(*) FILTER (in_cat_a) AS eliminated, count(*) FILTER (NOT in_cat_a) AS kept FROM f UNION ALL SELECT 1, 'cat_b', count(*), count(*) FILTER (in_cat_b), count(*) FILTER (NOT in_cat_b) FROM f WHERE NOT in_cat_a UNION ALL SELECT 2, 'cat_c', count(*), count(*) FILTER (in_cat_c), count(*) FILTER (NOT in_cat_c) FROM f WHERE NOT in_cat_a AND NOT in_cat_b")
def veto_chain_ledger(spark, d):
    return vetoes.chain_ledger(veto_chain_flags(spark, d), CHAIN)


@query("E24", _flags + " SELECT id, CASE WHEN in_cat_c THEN 'added' END AS change FROM f WHERE NOT in_cat_a AND NOT in_cat_b AND in_cat_c")
def counterfactual_no_third_veto(spark, d):
    det = view(spark, d, "det").select("id", "ra", "dec")
    two = skyjoin.anti(skyjoin.anti(det, view(spark, d, "cat_a"), 5, ["id"]), view(spark, d, "cat_b"), 5, ["id"])
    three = skyjoin.anti(two, view(spark, d, "cat_c"), 5, ["id"])
    return two.join(three.select("id"), "id", "left_anti").select("id", F.lit("added").alias("change"))


# --- filters ----------------------------------------------------------------------------------------------------
@query("C01", cte("det") + " SELECT id FROM det WHERE flags = 0 AND snr > 30")
def extract_filter(spark, d):
    return filters.extract_filter(view(spark, d, "det")).select("id")


@query("C02 C04", cte("det") + " SELECT id FROM det WHERE spread > -0.002e0 AND fwhm > 2 AND fwhm < 7 AND elong < 1.3e0 AND abs(dx - dy) < 2 AND dx > 1 AND dy > 1")
def morph_hard_gates(spark, d):
    return filters.hard_gates(view(spark, d, "det")).select("id")


sql("xy_bounds", "C05", "det", "SELECT id FROM det WHERE dx BETWEEN 1 AND 5 AND dy BETWEEN 1 AND 3")
_g = "(id % 40)"
_clip = cte("det") + f", r AS (SELECT *, {_g} AS g FROM det WHERE flags = 0 AND snr > 30), m AS (SELECT g, median(fwhm) AS mf, median(elong) AS me FROM r GROUP BY g), s AS (SELECT r.g, 1.4826 * median(abs(fwhm - mf)) AS sf, 1.4826 * median(abs(elong - me)) AS se FROM r JOIN m USING (g) GROUP BY r.g) SELECT id, r.g FROM r JOIN m USING (g) JOIN s USING (g) WHERE (sf <= 0 OR abs(fwhm - mf) <= 2 * sf) AND (se <= 0 OR abs(elong - me) <= 2 * se) AND fwhm IS NOT NULL AND elong IS NOT NULL"


@query("C03 E03 R3", _clip)
def robust_sigma_clip(spark, d):
    return filters.sigma_clip(filters.extract_filter(view(spark, d, "det")).withColumn("g", F.expr(_g)), ["fwhm", "elong"], "g").select("id", "g")


TESTS = {"flags": "flags <> 0", "snr": "snr <= 30", "fwhm": "fwhm <= 2 OR fwhm >= 7", "elong": "elong >= 1.3e0"}
_reason = cte("det") + ", r AS (SELECT id, tile_id, list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in TESTS.items()) + "], lambda x: x IS NOT NULL) AS l FROM det)"


@query("C18 B24", _reason + " SELECT id, array_to_string(l, '|') AS reasons FROM r")
def reject_reasons(spark, d):
    return filters.reasons(view(spark, d, "det"), TESTS).select("id", "reasons")


@query("E02", _reason + " SELECT unnest(l) AS reason, count(*) AS n FROM r GROUP BY 1")
def reject_reason_counts(spark, d):
    return filters.reason_counts(reject_reasons(spark, d))


@query("E02b", _reason + " SELECT array_to_string(l, '|') AS reasons, count(*) AS n FROM r GROUP BY 1")
def reject_reason_combinations(spark, d):
    return reject_reasons(spark, d).groupBy("reasons").agg(F.count("*").alias("n"))


@query("D07 B18 T2", cte("det", "cat_c") + f", p AS (SELECT a.id, b.id AS star, b.rmag, {HAV} AS s FROM det a JOIN cat_c b ON {near(90)} WHERE b.rmag <= 16), n AS (SELECT id, arg_min(star, s) AS star_id, arg_min(rmag, s) AS m, min(s) AS s FROM p GROUP BY id) SELECT d.id, coalesce(star_id, -1) AS star_id, round(s, 6) AS star_sep, coalesce(m <= 12.4e0 OR m < -0.09e0 * s + 15.3e0, false) AS spike FROM det d LEFT JOIN n ON n.id = d.id")
def spike_mask(spark, d):
    m = filters.spike_mask(view(spark, d, "det").select("id", "ra", "dec"), view(spark, d, "cat_c"), ["id"])
    return m.select("id", F.coalesce("star_id", F.lit(-1)).alias("star_id"), F.round("star_sep", 6).alias("star_sep"), "spike")


sql("circle_cut", "C06", "det plates", f"SELECT a.id, b.id AS plate_id FROM det a JOIN plates b ON a.id % 25 = b.id WHERE {HAV} <= 360000")
sql("catalogue_threshold", "C10 C11 C21 B18", "cat_a", f"SELECT id, n_detections, {sky.valid_magnitude('mag')} AS valid_mag FROM cat_a WHERE n_detections >= 3 AND (id * 50) % 1000 % 100 = 0")
sql("second_epoch", "C09 B10b", "cat_b", "SELECT id, " + R6(sky.propagate_stage("ra", "dec", "pmra", "pmdec", "-50")[0], "ra") + ", " + R6(sky.propagate_stage("ra", "dec", "pmra", "pmdec", "-50")[1], "dec") + " FROM cat_b WHERE pmra IS NOT NULL OR pmdec IS NOT NULL")
sql("southern_cut", "C08", "det", "SELECT id, coalesce(dec < 0, false) AS cut FROM det")
sql("plate_footprint", "C16", "plates", "SELECT count(*) AS plates, count(CASE WHEN dec >= -3 THEN 1 END) AS inside, count(CASE WHEN dec < -3 AND dec > -3.5e0 THEN 1 END) AS in_gap FROM plates")
sql("cone_sanity", "C19 G05", "det plates", f"SELECT b.id, median({HAV}) / 3600 <= 200 AS covered FROM (SELECT *, row_number() OVER (PARTITION BY id % 25 ORDER BY id) AS place FROM det) a JOIN plates b ON a.id % 25 = b.id WHERE a.place <= 2000 GROUP BY b.id")
sql("truncated_tiles", "C20", "det", "SELECT id % 10 AS g, count(*) AS n, count(*) = 1000 AS truncated FROM det GROUP BY id % 10")

# --- positions and motions --------------------------------------------------------------------------------------
_moved = sky.propagate("ra", "dec", "pmra", "pmdec", "-66")
sql("pm_propagate", "B10 T3", "cat_b", f"SELECT id, {R6(_moved[0], 'ra')}, {R6(_moved[1], 'dec')} FROM cat_b")
sql("total_motion", "B12", "cat_b", f"SELECT id, {R6(sky.total_motion('pmra', 'pmdec'), 'pm')} FROM cat_b WHERE pmra IS NOT NULL")
sql("hpm_flags", "D08", "cat_b", f"SELECT id, {R6(sky.haversine('ra', 'dec', *_moved), 'moved')}, {sky.haversine('ra', 'dec', *_moved)} > 5 AS hpm FROM cat_b")
sql("tangent_offsets", "B05 B06", "cat_a", f"SELECT id, {R6(sky.tangent_offsets('ra', 'dec', '350e0', '5e0')[0], 'x')}, {R6(sky.tangent_offsets('ra', 'dec', '350e0', '5e0')[1], 'y')}, {R6(sky.wrap180('ra'), 'ra180')} FROM cat_a")
sql("gnomonic", "B07", "cat_a", "SELECT id, " + ", ".join(R6(f"CASE WHEN {sky.cosine_separation('ra', 'dec', '30e0', '5e0')} < 60 THEN {sky.gnomonic('ra', 'dec', '30e0', '5e0')[k]} END", n) for k, n in enumerate(("xi", "eta"))) + " FROM cat_a")
sql("flat_separation", "B08", "cat_a", f"SELECT id, {R6(sky.flat_separation('ra', 'dec', '30e0', '5e0', '(SELECT median(dec) FROM cat_a)'), 'sep')} FROM cat_a")
sql("destination", "B09", "cat_a", f"SELECT id, {R6(sky.destination('ra', 'dec', '0.5e0', '(id % 360)')[0], 'ra')}, {R6(sky.destination('ra', 'dec', '0.5e0', '(id % 360)')[1], 'dec')} FROM cat_a")
sql("chebyshev_edge", "B26 B27 C15", "det plates", f"SELECT a.id, {R6(sky.chebyshev('a.ra', 'a.dec', 'b.ra', 'b.dec'), 'cheb')}, {sky.edge_class('(3.3e0 - ' + sky.chebyshev('a.ra', 'a.dec', 'b.ra', 'b.dec') + ')', '0.01e0', '0.5e0')} AS edge FROM det a JOIN plates b ON a.id % 25 = b.id")
sql("polynomial_terms", "B22", "det", "SELECT id, " + ", ".join(R6(t, f"t{k}") for k, t in enumerate(sky.polynomial("dx", "dy", 2))) + " FROM det")
sql("ratio_metrics", "B25", "det", f"SELECT id, {R6(sky.ratio('fwhm', 'dx'), 'fwhm_ratio')}, {R6(sky.ratio('spread', 'dy'), 'spread_snr')} FROM det")
sql("wilson_interval", "B28", "det", f"SELECT id % 40 AS g, count(*) AS n, count(CASE WHEN flags = 0 THEN 1 END) AS k, {R6(sky.wilson('count(CASE WHEN flags = 0 THEN 1 END)', 'count(*)')[0], 'low')}, {R6(sky.wilson('count(CASE WHEN flags = 0 THEN 1 END)', 'count(*)')[1], 'high')} FROM det GROUP BY id % 40")
sql("sexagesimal", "B15 T9", "det", "SELECT id, " + R6(sky.sexagesimal("(CASE WHEN id % 2 = 0 THEN '-' ELSE '' END || CAST(id % 3 + 1 AS STRING) || ':' || CAST(id % 60 AS STRING) || ':' || CAST((id * 7) % 60 AS STRING))"), "deg") + " FROM det", "SELECT id, " + R6(sky.sexagesimal("(CASE WHEN id % 2 = 0 THEN '-' ELSE '' END || CAST(id % 3 + 1 AS VARCHAR) || ':' || CAST(id % 60 AS VARCHAR) || ':' || CAST((id * 7) % 60 AS VARCHAR))"), "deg") + " FROM det")
sql("source_ids", "B14 B32", "det", "SELECT src_id, split_part(src_id, ':', 1) AS tile, CAST(CAST(split_part(src_id, ':', 2) || '.0' AS double) AS bigint) AS object_id FROM det")
_tile = "(SELECT id, dec, ra, {name} AS t FROM cat_a UNION ALL SELECT -1, 0e0, 0e0, 'plate_7')"
_centre = "SELECT id, t AS tile, " + ", ".join(R6(c, n) for c, n in zip(sky.tile_centre("t"), ("tile_ra", "tile_dec"), strict=True)) + " FROM "
sql("tile_id_parse", "B13", "cat_a", _centre + _tile.format(name=sky.tile_name("ra", "dec")), _centre + _tile.format(name=sky.tile_name("ra", "dec", "printf")))
_obs = "(SELECT id, '1952-0' || CAST(id % 9 + 1 AS {0}) || '-1' || CAST(id % 10 AS {0}) || 'T' || lpad(CAST(id % 27 AS {0}), 2, '0') || ':' || lpad(CAST(id * 7 % 99 AS {0}), 2, '0') || ':' || lpad(CAST(id * 3 % 75 AS {0}), 2, '0') || CASE WHEN id % 5 = 0 THEN '.25' WHEN id % 11 = 0 THEN 'x' ELSE '' END AS t FROM det)"
_spark_days, _duck_days = "datediff({}, DATE '1970-01-01')", "date_diff('day', DATE '1970-01-01', {})"
sql("overflow_times", "B16 B17", "det", f"SELECT id, {R9(sky.overflow_mjd('t', _spark_days), 'mjd')} FROM {_obs.format('STRING')}", f"SELECT id, {R9(sky.overflow_mjd('t', _duck_days), 'mjd')} FROM {_obs.format('VARCHAR')}")
_deep = sky.space_motion("ra", "dec", "pmra", "pmdec", "-66")
sql("rigorous_motion", "B11", "cat_b", f"SELECT id, {R6(_deep[0], 'ra')}, {R6(_deep[1], 'dec')} FROM cat_b")
sql("number_texts", "B23", "cat_b", f"SELECT id, {sky.number_text('pmra')} AS pm FROM cat_b", f"SELECT id, {sky.number_text('pmra', text='printf')} AS pm FROM cat_b")
sql("edge_distances", "B27", "det", f"SELECT id, {R6(sky.edge_distance('dx', 'dy', '6e0', '4e0'), 'd')} FROM det")
sql("julian_dates", "B16 B17", "det", "SELECT id, round(unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 / 86400 + 40587, 6) AS mjd, year(ts) AS y FROM det", "SELECT id, round(epoch_us(ts) / 1e6 / 86400 + 40587, 6) AS mjd, CAST(year(ts) AS INTEGER) AS y FROM det")
sql("fingerprint", "B31", "det", "SELECT id, substr(sha2(src_id, 256), 1, 10) AS print FROM det", "SELECT id, substr(sha256(src_id), 1, 10) AS print FROM det")

# --- de-duplication ---------------------------------------------------------------------------------------------
_both = ", u AS (SELECT src_id, tile_id, ra, dec FROM det UNION ALL SELECT 'a' || CAST(id AS VARCHAR), id % 50, ra, dec FROM cat_a)"


def _stacked(spark, d):
    a = view(spark, d, "cat_a")
    return view(spark, d, "det").select("src_id", "tile_id", "ra", "dec").union(a.select(F.concat(F.lit("a"), F.col("id").cast("string")), F.col("id") % 50, "ra", "dec"))


@query("F01", cte("det") + " SELECT tile_id, min(id) AS id FROM det GROUP BY tile_id")
def first_per_tile(spark, d):
    return dedup.first_per_key(view(spark, d, "det"), ["tile_id"], ["id"]).select("tile_id", "id")


@query("D10 E09 T7", cte("det", "cat_a") + _both + f", e AS (SELECT a.src_id AS i, b.src_id AS j FROM u a JOIN u b ON {near(3)} AND a.src_id <> b.src_id), r AS (SELECT u.src_id, least(u.src_id, min(e.j)) AS component FROM u LEFT JOIN e ON e.i = u.src_id GROUP BY u.src_id) SELECT src_id, component, component = src_id AS kept FROM r")
def dedup_3as(spark, d):
    return dedup.dedup(_stacked(spark, d), 3).select("src_id", "component", "kept")


@query("E08")
def dedup_sweep(spark, d):
    return dedup.sweep(_stacked(spark, d), [0.3, 1.0, 3.0])


_sizes = ", ".join(f"e{k} AS (SELECT a.src_id AS i, b.src_id AS j FROM u a JOIN u b ON {near(r)} AND a.src_id <> b.src_id), r{k} AS (SELECT u.src_id, least(u.src_id, min(e{k}.j)) AS component FROM u LEFT JOIN e{k} ON e{k}.i = u.src_id GROUP BY u.src_id)" for k, r in enumerate((0.3, 3.0)))


@query("E08", cte("det", "cat_a") + _both + f", {_sizes} " + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS radius, size, count(*) AS clusters FROM (SELECT count(*) AS size FROM r{k} GROUP BY component) GROUP BY size" for k, r in enumerate((0.3, 3.0))))
def cluster_sizes(spark, d):
    return dedup.cluster_sizes(_stacked(spark, d), [0.3, 3.0])


# --- stages -----------------------------------------------------------------------------------------------------
@query("D16 T20", cte("det", "cat_b") + f", k AS (SELECT a.id, EXISTS (SELECT 1 FROM cat_b b WHERE {near(5)}) AS m FROM det a) SELECT count(*) AS input_rows, count(*) FILTER (m) AS dropped_rows, count(*) FILTER (NOT m) AS kept_rows FROM k")
def match_stage_ledger(spark, d):
    return stages.match_stage(view(spark, d, "det"), view(spark, d, "cat_b"), 5, "id").ledger


@query("SCOS D09", cte("det", "cat_b") + f" SELECT a.id FROM det a WHERE EXISTS (SELECT 1 FROM cat_b b WHERE {near(5)})")
def match_stage_keep_mode(spark, d):
    return stages.match_stage(view(spark, d, "det"), view(spark, d, "cat_b"), 5, "id", keep_matches=True).kept.select("id")


REJECT = {"dec": "dec < -10", "fwhm": "fwhm / nullif(dx, 0) > 5e0", "spread": "spread > 0.015e0"}


@query("C07 C12 C13 C14 R4", cte("det") + " SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({t}, false) THEN '{n}' END" for n, t in REJECT.items()) + "], lambda x: x IS NOT NULL), ';') AS reason, NOT (" + " OR ".join(f"coalesce({t}, false)" for t in REJECT.values()) + ") AS keep FROM det")
def test_stage_flags(spark, d):
    return stages.test_stage(view(spark, d, "det"), "id", REJECT).flags


@query("D09b D09c A10", cte("det", "cat_b") + f" SELECT a.id, count(b.id) AS n_any, count(b.id) FILTER (b.pmra IS NOT NULL) AS n_pm, count(b.id) FILTER (b.band < 10) AS n_band FROM det a LEFT JOIN cat_b b ON {near(10)} GROUP BY a.id")
def banded_counts(spark, d):
    return stages.banded_counts(view(spark, d, "det"), view(spark, d, "cat_b"), "id", 10, {"n_any": "true", "n_pm": "r_pmra IS NOT NULL", "n_band": "r_band < 10"})


@query("D16 D15", cte("det") + " SELECT id FROM det WHERE flags > 0 AND id % 3 = 0")
def shrink_keep(spark, d):
    det = view(spark, d, "det")
    return stages.shrink(det, det.where("id % 3 = 0"), "id", "flags", True).select("id")


sql("tile_psf", "E05", "det", "SELECT id % 40 AS g, count(*) AS n_stars, " + R6("median(fwhm)", "psf_fwhm") + ", " + R6("median(spread)", "psf_spread") + ", CASE WHEN count(*) >= 60 THEN 'ok' ELSE 'few' END AS status FROM det WHERE flags = 0 AND elong < 1.3e0 GROUP BY id % 40")
sql("tile_manifest", "J02 T13", "det", "SELECT tile_id, count(*) AS rows_in, count(CASE WHEN flags = 0 THEN 1 END) AS rows_out, CASE WHEN count(CASE WHEN flags = 0 THEN 1 END) = 0 THEN 'no_valid_rows' ELSE 'ok' END AS status FROM det GROUP BY tile_id")


@query("A21", cte("cat_a") + " SELECT id, (row_number() OVER (ORDER BY id) - 1) % 100 AS place, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS bigint) AS chunk FROM cat_a")
def chunked_rows(spark, d):
    n = validate.numbered(view(spark, d, "cat_a").select("id"), "id")
    return n.selectExpr("id", "n % 100 AS place", "CAST(floor(n / 100) AS bigint) AS chunk")


sql("latest_per_key", "F01", "det", "SELECT tile_id, id, snr FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, id DESC) AS n FROM det) x WHERE n = 1")

# --- validation -------------------------------------------------------------------------------------------------
_dist = cte("det", "ref") + f", d AS (SELECT a.id, a.status, min({HAV}) AS dist FROM ref a LEFT JOIN det b ON {near(10)} GROUP BY a.id, a.status), q AS (SELECT unnest([1.0, 2.0, 3.0, 5.0, 10.0])::DOUBLE AS radius)"


@query("E06 D13", _dist + " SELECT radius, count(*) AS n, count(*) FILTER (dist <= radius) AS hits, round(count(*) FILTER (dist <= radius) / count(*), 6) AS recall FROM d, q GROUP BY radius")
def recall_by_radius(spark, d):
    return validate.recall(validate.nearest_distance(view(spark, d, "ref"), view(spark, d, "det"), 10), RADII)


@query("E14", _dist + " SELECT status, radius, count(*) AS n, count(*) FILTER (dist <= radius) AS hits, round(count(*) FILTER (dist <= radius) / count(*), 6) AS recall FROM d, q GROUP BY status, radius")
def recall_by_group(spark, d):
    return validate.recall(validate.nearest_distance(view(spark, d, "ref"), view(spark, d, "det"), 10), RADII, ["status"])


@query("E06b H01", cte("det", "cat_a", "ref") + f", u AS (SELECT ra, dec FROM det UNION ALL SELECT ra, dec FROM cat_a), d AS (SELECT a.id, min({HAV}) AS dist FROM ref a LEFT JOIN u b ON {near(10)} GROUP BY a.id), q AS (SELECT unnest([1.0, 2.0, 3.0, 5.0, 10.0])::DOUBLE AS radius) SELECT radius, count(*) AS n, count(*) FILTER (dist <= radius) AS hits, round(count(*) FILTER (dist <= radius) / count(*), 6) AS recall FROM d, q GROUP BY radius")
def recall_union(spark, d):
    both = view(spark, d, "det").select("ra", "dec").union(view(spark, d, "cat_a").select("ra", "dec"))
    return validate.recall(validate.nearest_distance(view(spark, d, "ref"), both, 10), RADII)


_arms = cte("det", "ref") + f", n AS (SELECT ra, dec, 'real' AS arm FROM det UNION ALL SELECT {sky.wrap360('ra + 0.1e0')}, dec, 'null' FROM det), d AS (SELECT a.id, b.arm, min({HAV}) AS dist FROM ref a JOIN n b ON {near(10)} GROUP BY a.id, b.arm)"


def _armed(spark, d):
    arms = validate.null_arms(view(spark, d, "det").select("ra", "dec"), 0.1)
    return skyjoin.pairs(view(spark, d, "ref").select("id", "ra", "dec"), arms, 10).groupBy("id", F.col("r_arm").alias("arm")).agg(F.min("sep_arcsec").alias("dist"))


@query("D14", _arms + " SELECT arm, count(*) AS n, count(*) FILTER (dist <= 5) AS within_5 FROM d GROUP BY arm")
def null_shift_control(spark, d):
    return _armed(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.sum((F.col("dist") <= 5).cast("long")).alias("within_5"))


@query("E07", _arms + " SELECT CAST(ceil(dist) - 1 AS INTEGER) AS lo, count(*) FILTER (arm = 'real') AS n_real, count(*) FILTER (arm = 'null') AS n_null, count(*) FILTER (arm = 'real') - count(*) FILTER (arm = 'null') AS excess FROM d WHERE dist > 0 AND ceil(dist) - 1 < 10 GROUP BY 1")
def separation_histogram(spark, d):
    return validate.histogram(_armed(spark, d), 10)


_plate = cte("det", "plates") + f", s AS (SELECT a.id, list_sort(list({{'s': {HAV} / 3600, 'p': b.id}})) AS l FROM det a, plates b GROUP BY a.id)"


@query("D11 F03 B29", _plate + " SELECT id, l[1].p AS primary_plate, l[2].p AS neighbour_plate, round(l[1].s, 6) AS sep1, round(1 - l[1].s / greatest(l[2].s, 1e-9), 4) AS sep_margin FROM s")
def primary_plate(spark, d):
    n = validate.nearest_plates(view(spark, d, "det").select("id", "ra", "dec"), view(spark, d, "plates"), 2)
    a, b = F.col("near")[0], F.col("near")[1]
    return n.select("id", a["plate_id"].alias("primary_plate"), b["plate_id"].alias("neighbour_plate"), F.round(a["sep"], 6).alias("sep1"), F.round(1 - a["sep"] / F.greatest(b["sep"], F.lit(1e-9)), 4).alias("sep_margin"))


_cheb = sky.chebyshev("a.ra", "a.dec", "b.ra", "b.dec")


@query("A07b T14", cte("det", "plates") + f" SELECT b.id, count(a.id) AS covered FROM plates b LEFT JOIN det a ON {_cheb} <= 3.3e0 GROUP BY b.id")
def plate_coverage(spark, d):
    return validate.coverage(view(spark, d, "plates"), view(spark, d, "det"), 3.3)


@query("D12", cte("det", "plates") + f" SELECT a.id, count(b.id) AS others FROM det a LEFT JOIN plates b ON {_cheb} <= 9e0 AND b.id <> a.id % 25 GROUP BY a.id")
def other_plates(spark, d):
    rows = view(spark, d, "det").selectExpr("id", "id % 25 AS own", "ra", "dec")
    return validate.other_plates(rows, "id", "own", view(spark, d, "plates"), 9.0)


_on = "SELECT id % 25 AS plate_id, id, ra, dec FROM det"


@query("D12b", cte("det", "ref", "plates") + f", o AS ({_on}), m AS (SELECT a.id, b.id AS plate_id, a.ra, a.dec FROM ref a JOIN plates b ON {_cheb} <= 20e0), p AS (SELECT a.id, a.plate_id, b.id AS r_id, {HAV} AS s FROM m a JOIN o b ON a.plate_id = b.plate_id AND {near(600)}) SELECT id, plate_id, arg_min(r_id, (s, r_id)) AS r_id, round(min(s), 6) AS sep_arcsec FROM p GROUP BY id, plate_id")
def per_plate_nearest(spark, d):
    det = view(spark, d, "det").selectExpr("id % 25 AS plate_id", "id", "ra", "dec")
    n = validate.per_plate_nearest(view(spark, d, "ref"), det, view(spark, d, "plates"), 20.0, 600)
    return n.select("id", "plate_id", "r_id", F.round("sep_arcsec", 6).alias("sep_arcsec"))


_at = [("ra", "dec"), sky.propagate("ra", "dec", "pmra", "pmdec", "-50.0")]
_epochs = ", ".join(f"c{k} AS (SELECT id, {x} AS ra, {y} AS dec FROM cat_b), e{k} AS (SELECT a.id, arg_min(b.id, ({HAV}, b.id)) AS m, min({HAV}) AS s FROM c{k} a JOIN det b ON {near(10)} GROUP BY a.id)" for k, (x, y) in enumerate(_at))


@query("D22 D23", cte("cat_b", "det") + f", {_epochs} SELECT c.id, e0.m AS match0, round(e0.s, 6) AS sep0, e1.m AS match1, round(e1.s, 6) AS sep1 FROM cat_b c LEFT JOIN e0 ON e0.id = c.id LEFT JOIN e1 ON e1.id = c.id")
def two_epoch_matches(spark, d):
    m = validate.two_epochs(view(spark, d, "cat_b"), view(spark, d, "det"), -50, 10)
    return m.select("id", "match0", F.round("sep0", 6).alias("sep0"), "match1", F.round("sep1", 6).alias("sep1"))


_h = lambda m: f"(((CAST(id AS BIGINT) + 1) * {m} + CAST(k AS BIGINT) * 7919 + 104729) * 48271 % 2147483647 * 48271 % 2147483647 / 2147483647e0)"
_point = sky.destination("ra", "dec", f"(2.5e0*sqrt({_h(15485863)}))", f"(360*{_h(32452843)})")


@query("L01", cte("plates") + f", g AS (SELECT *, CAST(unnest(range(1, 51)) AS BIGINT) AS k FROM plates) SELECT id, CAST(k AS INTEGER) AS k, {R6(_point[0], 'ra')}, {R6(_point[1], 'dec')} FROM g")
def field_points(spark, d):
    return validate.field_points(view(spark, d, "plates"), 50, 2.5).select("id", "k", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("F05", cte("det") + ", t AS (SELECT tile_id, count(*) AS n, row_number() OVER (ORDER BY tile_id) AS i FROM det GROUP BY tile_id)")
def tile_batches(spark, d):
    return segment.batches(view(spark, d, "det").groupBy("tile_id").agg(F.count("*").alias("n")), "tile_id", "n", 40, 150)


ORACLES["tile_batches"] = ORACLES["tile_batches"].replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT i, tile_id, 0 AS batch, 1 AS c, n AS s FROM t WHERE i = 1 UNION ALL SELECT t.i, t.tile_id, CASE WHEN r.c + 1 > 40 OR r.s + t.n > 150 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.c + 1 > 40 OR r.s + t.n > 150 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c + 1 > 40 OR r.s + t.n > 150 THEN t.n ELSE r.s + t.n END FROM r JOIN t ON t.i = r.i + 1) SELECT tile_id, CAST(batch AS INTEGER) AS batch FROM r"


@query("J01", cte("det") + ", s AS (SELECT tile_id, CASE WHEN min(id) % 3 = 0 THEN 'ok' WHEN min(id) % 3 = 1 THEN 'failed' END AS status FROM det GROUP BY tile_id) SELECT DISTINCT tile_id FROM det WHERE tile_id NOT IN (SELECT tile_id FROM s WHERE status = 'ok')")
def undone_tiles(spark, d):
    det = view(spark, d, "det")
    state = det.groupBy("tile_id").agg(F.expr("CASE WHEN min(id) % 3 = 0 THEN 'ok' WHEN min(id) % 3 = 1 THEN 'failed' END").alias("status"))
    return catalogue.undone(det.select("tile_id").distinct(), state, "tile_id")


@query("A01 A02 A04 A17 A18", cte("cat_a") + f" SELECT id, n_detections, CASE WHEN mag > -999 THEN mag END AS mag, NULL::DOUBLE AS plx, round({sky.cosine_separation('ra', 'dec', '30e0', '5e0')} * 60, 4) AS r_arcmin FROM cat_a WHERE n_detections >= 3 AND {sky.cosine_separation('ra', 'dec', '30e0', '5e0')} * 60 <= 900")
def catalogue_cone(spark, d):
    typed = {"id": "id AS long", "ra": "ra AS double", "dec": "dec AS double", "mag": "mag AS double", "n_detections": "n_detections AS int"}
    stored = catalogue.prepared(view(spark, d, "cat_a"), shared_folder(spark), typed, nside=4)
    out = catalogue.cone(stored, 30.0, 5.0, 900.0, ["id", "ra", "dec", "mag", "n_detections"], "n_detections >= 3", ("mag",), ("plx",), nside=4)
    return out.select("id", "n_detections", "mag", "plx", F.round("_r", 4).alias("r_arcmin"))


sql("edge_yield", "E12", "det plates", "SELECT count(*) AS n, " + ", ".join(f"count(CASE WHEN {sky.chebyshev('a.ra', 'a.dec', 'b.ra', 'b.dec')} > {r} THEN 1 END) AS beyond_{r}" for r in (1, 3, 10, 30)) + " FROM det a JOIN plates b ON a.id % 25 = b.id")
sql("funnel", "D20 E13 T19", "det", "SELECT stage, count(*) AS n FROM (SELECT CASE WHEN flags <> 0 THEN 'extract' WHEN snr <= 30 THEN 'snr' WHEN elong >= 1.3e0 THEN 'morph' ELSE 'kept' END AS stage FROM det) x GROUP BY stage")
sql("percentile_profile", "E16", "det", "SELECT flags, " + ", ".join(f"round(percentile(fwhm, {p}), 6) AS p{int(float(p) * 100)}" for p in ("0.25", "0.5", "0.75", "0.9", "0.99")) + ", round(avg(CASE WHEN fwhm > 5 THEN 1e0 ELSE 0e0 END), 6) AS beyond_5 FROM det GROUP BY flags", "SELECT flags, " + ", ".join(f"round(quantile_cont(fwhm, {p}), 6) AS p{int(float(p) * 100)}" for p in ("0.25", "0.5", "0.75", "0.9", "0.99")) + ", round(avg(CASE WHEN fwhm > 5 THEN 1e0 ELSE 0e0 END), 6) AS beyond_5 FROM det GROUP BY flags")
sql("stratified_stats", "E18", "det", "SELECT CAST(floor(dec / 10) AS bigint) AS bin, count(*) AS n, round(avg(fwhm), 6) AS mean_fwhm, round(median(fwhm), 6) AS median_fwhm FROM det GROUP BY 1")
sql("correlation", "E19", "det", "SELECT round(corr(fwhm, snr), 6) AS r FROM det")
sql("crosstab", "E19", "det", "SELECT flags, count(CASE WHEN snr > 30 THEN 1 END) AS bright, count(CASE WHEN snr <= 30 THEN 1 END) AS faint FROM det GROUP BY flags")
sql("displacement", "E26", "det", "SELECT id % 40 AS g, round(median(dx), 6) AS mx, round(median(dy), 6) AS my, round(sqrt(pow(stddev_pop(dx), 2) + pow(stddev_pop(dy), 2)), 6) AS scatter FROM det GROUP BY id % 40")
sql("contamination", "E11", "det", "SELECT id % 40 AS g, count(*) AS n, round(avg(CASE WHEN snr > 90 THEN 1e0 ELSE 0e0 END), 6) AS fraction, count(*) < 5 OR avg(CASE WHEN snr > 90 THEN 1e0 ELSE 0e0 END) <= 0.2e0 AS pass FROM det GROUP BY id % 40")
sql("worst_groups", "G03", "det", "SELECT id % 40 AS g, count(*) AS n, count(CASE WHEN flags = 0 THEN 1 END) AS kept FROM det GROUP BY id % 40 HAVING count(*) >= 20 ORDER BY kept, g LIMIT 15")
sql("set_overlap", "H03", "det ref", "SELECT (SELECT count(*) FROM (SELECT id FROM det INTERSECT SELECT id FROM ref) x) AS common, (SELECT count(*) FROM (SELECT id FROM det EXCEPT SELECT id FROM ref) y) AS missing")
sql("percent_change", "B30", "det", f"SELECT flags, {R6(sky.percent_change('count(CASE WHEN snr > 30 THEN 1 END)', 'count(*)'), 'change')} FROM det GROUP BY flags")
sql("top_by_distance", "G02", "cat_a", f"SELECT id, {R6(sky.haversine('ra', 'dec', '30e0', '5e0'), 'sep')} FROM cat_a ORDER BY {sky.haversine('ra', 'dec', '30e0', '5e0')}, id LIMIT 50")


@query("H04", cte("det") + " SELECT tile_id, count(DISTINCT id % 2) AS n_values FROM det GROUP BY tile_id HAVING count(DISTINCT id % 2) > 1")
def unique_mapping_conflicts(spark, d):
    return validate.unique_mapping(view(spark, d, "det").withColumn("v", F.expr("id % 2")), "tile_id", "v")


# --- scans ------------------------------------------------------------------------------------------------------
@query("A02 B02 R5", cte("cat_a") + f" SELECT id, round({sky.cosine_separation('ra', 'dec', '30e0', '5e0')} * 60, 4) AS r_arcmin FROM cat_a WHERE {sky.cosine_separation('ra', 'dec', '30e0', '5e0')} * 60 <= 600")
def cone_scan(spark, d):
    """Only the cells that the cone touches are read."""
    stored = catalogue.prepared(view(spark, d, "cat_a"), shared_folder(spark), {"id": "id AS long", "ra": "ra AS double", "dec": "dec AS double"}, nside=4)
    return skyjoin.cone(stored, 30.0, 5.0, 600.0, ["id", "ra", "dec"], "healpix_5", 4).select("id", F.round("_r", 4).alias("r_arcmin"))


@query("D12 T21", cte("cat_a", "plates") + f" SELECT b.id AS plate_id, a.id FROM cat_a a JOIN plates b ON {_cheb} <= 3e0 WHERE (a.id * 50) % 1000 % 100 = 0")
def bbox_plate_scan(spark, d):
    clean = view(spark, d, "cat_a").where("(id * 50) % 1000 % 100 = 0")
    return validate.boxed(clean, validate.manifest(view(spark, d, "plates")), 3.0).select("plate_id", "id")


@query("A19", cte("cat_a") + " SELECT CAST(least(floor((dec + 90) / 0.1e0), 1799) AS INTEGER) AS zone, count(*) AS n FROM cat_a GROUP BY 1")
def dec_zones(spark, d):
    return view(spark, d, "cat_a").groupBy(catalogue.dec_zone(F.col("dec")).alias("zone")).agg(F.count("*").alias("n"))



@query("A17", cte("det") + " SELECT id, CAST(id % 12288 AS INTEGER) AS pixel FROM det")
def source_id_pixel(spark, d):
    """Cells of source ids that hold them in their upper bits."""
    ids = view(spark, d, "det").selectExpr("id", "shiftleft(id % 12288, 49) + id AS source_id")
    return ids.select("id", catalogue.pixel_of_source(F.col("source_id")).alias("pixel"))


_z = "sin(radians(dec))"
_pix = (
    f"h AS (SELECT {_z} AS z, ra / 90e0 AS t, 32 * (0.5e0 + ra / 90e0) AS p, 32 * 0.75e0 * {_z} AS q, ra / 90e0 - floor(ra / 90e0) AS s, 32 * sqrt(3 * (1 - abs({_z}))) AS w FROM det), "
    "j AS (SELECT *, CASE WHEN abs(z) <= 2e0 / 3 THEN CAST(floor(p - q) AS BIGINT) ELSE least(31, CAST(floor(s * w) AS BIGINT)) END AS jp, CASE WHEN abs(z) <= 2e0 / 3 THEN CAST(floor(p + q) AS BIGINT) ELSE least(31, CAST(floor((1 - s) * w) AS BIGINT)) END AS jm FROM h), "
    "f AS (SELECT CASE WHEN abs(z) > 2e0 / 3 THEN least(3, CAST(floor(t) AS BIGINT)) + CASE WHEN z < 0 THEN 8 ELSE 0 END WHEN jp // 32 = jm // 32 THEN (jp // 32) % 4 + 4 WHEN jp // 32 < jm // 32 THEN (jp // 32) % 4 ELSE (jm // 32) % 4 + 8 END AS face, "
    "CASE WHEN abs(z) <= 2e0 / 3 THEN jm % 32 WHEN z > 0 THEN 31 - jm ELSE jp END AS x, CASE WHEN abs(z) <= 2e0 / 3 THEN 31 - jp % 32 WHEN z > 0 THEN 31 - jp ELSE jm END AS y FROM j)"
)
_woven = " + ".join(f"((x >> {k}) & 1) * {4**k} + ((y >> {k}) & 1) * {2 * 4**k}" for k in range(5))


@query("B19 E25 A18 T15", cte("det") + f", {_pix} SELECT CAST(face * 1024 + {_woven} AS BIGINT) AS pixel, count(*) AS n FROM f GROUP BY 1")
def pixel_counts(spark, d):
    return view(spark, d, "det").groupBy(healpix.nested_id(F.col("ra"), F.col("dec"), 32).cast("long").alias("pixel")).agg(F.count("*").alias("n"))


_cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
_weight = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in _cuts)


@query("E17 L03", cte("det") + f", t AS (SELECT tile_id, sum(fwhm) AS s, count(fwhm) AS n FROM det GROUP BY tile_id), r AS (SELECT *, {validate.seeded_text('tile_id * 1009 + rep', 1)} / 2147483647e0 AS u FROM t, (SELECT unnest(range(1, 201)) AS rep)), m AS (SELECT rep, sum(({_weight}) * s) / sum(({_weight}) * n) AS m FROM r GROUP BY rep) SELECT count(m) AS replicates, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_mean(spark, d):
    b = validate.bootstrap(view(spark, d, "det"), "tile_id", "fwhm", 200)
    return b.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("L02 F04", cte("det") + f", k AS (SELECT CAST(floor(dec / 10) AS BIGINT) AS bin, id, row_number() OVER (PARTITION BY floor(dec / 10) ORDER BY {validate.seeded_text('id', 1)}, id) AS n FROM det) SELECT bin, id FROM k WHERE n <= 20")
def stratified_sample(spark, d):
    return validate.stratified_sample(view(spark, d, "det").withColumn("bin", F.floor(F.col("dec") / 10)), ["bin"], "id", 20).select("bin", "id")


@query("F06", cte("det") + " SELECT tile_id FROM (SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS n FROM (SELECT DISTINCT tile_id FROM det)) WHERE n % 7 = 0")
def every_seventh_tile(spark, d):
    return filters.every_nth(view(spark, d, "det").select("tile_id").distinct(), "tile_id", 7)


@query("D21", cte("det", "ref") + f" SELECT a.id, b.id AS r_id, a.id % 25 AS plate_id, {R6(HAV, 'sep_arcsec')} FROM det a JOIN ref b ON a.id % 25 = b.id % 5 AND {near(10)}")
def plate_pairs_10as(spark, d):
    det = view(spark, d, "det").select("id", "ra", "dec", F.expr("id % 25").alias("plate_id"))
    ref = view(spark, d, "ref").select("id", "ra", "dec", F.expr("id % 5").alias("plate_id"))
    return skyjoin.pairs(det, ref, 10, ["plate_id"]).select("id", "r_id", "plate_id", F.round("sep_arcsec", 6).alias("sep_arcsec"))


@query("A13 A31", cte("det") + f" SELECT id AS object_id, {R6('ra + 0.001e0', 'ra')}, {R6('dec - 0.001e0', 'dec')}, tile_id FROM det WHERE flags = 0")
def resolved_positions(spark, d):
    det = view(spark, d, "det").where("flags = 0").selectExpr("id AS NUMBER", "ra AS X_WORLD", "dec AS Y_WORLD", "ra + 0.001e0 AS ALPHAWIN_J2000", "dec - 0.001e0 AS DELTAWIN_J2000", "tile_id")
    return columns.placed(det).select(F.col(columns.id_column(det)).alias("object_id"), F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), "tile_id")


@query("G04", ORACLES["dedup_3as"].removesuffix("SELECT src_id, component, component = src_id AS kept FROM r") + "SELECT src_id FROM r WHERE component = src_id ORDER BY src_id")
def dedup_representatives(spark, d):
    return dedup.representatives(_stacked(spark, d), 3, "src_id").select("src_id")


@query("B34", "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings), n AS (SELECT vec_id, v, list_aggregate(v, 'median') AS c FROM m), o AS (SELECT vec_id, v, c, list_aggregate(list_transform(v, lambda x: abs(x - c)), 'median') AS mad FROM n) SELECT vec_id, CASE WHEN mad > 0 THEN round((list_aggregate(v, 'max') - c) / (1.4826e0 * mad), 6) END AS peak_sigma FROM o")
def peak_significance(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return validate.peak_significance(e, "embedding").select("vec_id", F.round("peak_sigma", 6).alias("peak_sigma"))


_best = cte("det", "cat_a") + f", p AS (SELECT a.id, a.id % 40 AS g, a.ra, a.dec, b.ra AS r_ra, b.dec AS r_dec, b.id AS r_id, {HAV} AS s FROM det a JOIN cat_a b ON {near(10)}), q AS (SELECT id, any_value(g) AS g, any_value(ra) AS ra, any_value(dec) AS dec, arg_min(r_ra, (s, r_id)) AS r_ra, arg_min(r_dec, (s, r_id)) AS r_dec FROM p GROUP BY id), o AS (SELECT g, count(*) AS n, median({sky.tangent_offsets('r_ra', 'r_dec', 'ra', 'dec')[0]}) AS mx, median({sky.tangent_offsets('r_ra', 'r_dec', 'ra', 'dec')[1]}) AS my FROM q GROUP BY g), w AS (SELECT id, g, ra + mx / 3600 / cos(radians(dec)) AS ra, dec + my / 3600 AS dec FROM q JOIN o USING (g))"


@query("L04", _best + f" SELECT o.g, o.n, round(mx, 4) AS mx, round(my, 4) AS my, (SELECT count(*) FROM q a WHERE a.g = o.g AND EXISTS (SELECT 1 FROM cat_a b WHERE {near(4)})) AS before, (SELECT count(*) FROM w a WHERE a.g = o.g AND EXISTS (SELECT 1 FROM cat_a b WHERE {near(4)})) AS after FROM o")
def offset_recovery(spark, d):
    r = validate.recovered(view(spark, d, "det").withColumn("g", F.expr("id % 40")), view(spark, d, "cat_a"), "g", 10, 4)
    return r.select("g", "n", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), "before", "after")


_once = "SELECT src_id, component, component = src_id AS kept FROM r"
ORACLES["dedup_sweep"] = cte("det", "cat_a") + _both + ", " + ", ".join(
    f"e{k} AS (SELECT a.src_id AS i, b.src_id AS j, a.tile_id <> b.tile_id AS x FROM u a JOIN u b ON {near(r)} AND a.src_id <> b.src_id), r{k} AS (SELECT u.src_id, least(u.src_id, min(e{k}.j)) AS component FROM u LEFT JOIN e{k} ON e{k}.i = u.src_id GROUP BY u.src_id), s{k} AS (SELECT component, count(*) AS size FROM r{k} GROUP BY component)" for k, r in enumerate((0.3, 1.0, 3.0))
) + " " + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS radius, (SELECT count(*) // 2 FROM e{k}) AS pairs, (SELECT count(*) // 2 FROM e{k} WHERE x) AS cross_tile, (SELECT count(*) // 2 FROM e{k} WHERE NOT x) AS intra_tile, (SELECT count(*) FROM s{k}) AS kept, (SELECT max(size) FROM s{k}) AS max_cluster" for k, r in enumerate((0.3, 1.0, 3.0)))
