"""Queries over whole chains of stages, the epoch-aware match and the scan by plate boxes, with oracles by brute force.

Oracles take the rules from their statement (a status by CASE, matches by EXISTS, epochs by ASOF joins), not from the
operators' text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import boxes, chain, ephemeris
from skyweave.operators import post_stages as post
from skyweave.sources.shared import shared_folder
from skyweave.sources.views import cte, dec, ra, view

from .registry import HAV, near, query

_body = "CAST(floor(o_orderkey / 15) AS BIGINT)"
_since = f"(60308e0 + 2.6e0 * (o_orderkey % 15) + 0.31e0 * ({_body} % 4) - 60310e0 - {_body} * 7 % 30)"
#: Bodies on straight ways past where detections are, tabulated some 15 times with gaps.
EPHEMERIS = f"SELECT {_body} AS body_id, 60308e0 + 2.6e0 * (o_orderkey % 15) + 0.31e0 * ({_body} % 4) AS t, {ra(f'({_body} * 10)')} + ({_body} % 9 - 4) * 6e0 * {_since} / 3600e0 AS ra, {dec(f'({_body} * 10)')} + ({_body} % 5) * 1.1e0 / 3600e0 AS dec FROM {{orders}} WHERE o_orderkey % 11 <> 4"
_measured = "id, src_id, tile_id, ra, CASE WHEN id % 211 <> 7 THEN dec END AS dec, fwhm, CASE WHEN id % 31 <> 4 THEN spread END AS spread, dy / 1000e0 AS spreaderr, CASE WHEN id % 13 <> 5 THEN {micros} / 8.64e10 + 40587 END AS mjd, (id % 9) / 100e0 AS profile_diff, CASE WHEN id % 5 <> 0 THEN 1e0 + (id % 13) / 100e0 END AS elongation, 0.7e0 + (id % 30) / 100e0 AS circularity, id % 20 AS field"
_duck_rows = f"q AS (SELECT {_measured.format(micros='epoch_us(ts)')} FROM det)"


def _rows(spark, d):
    return view(spark, d, "det").selectExpr(*_split(_measured.format(micros="unix_micros(CAST(ts AS TIMESTAMP))")))


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[start:k])
            start = k + 1
    return [*out, columns[start:]]


def _ephemeris(spark, d):
    return spark.sql(EPHEMERIS.replace("{orders}", "{t}"), t=spark.read.parquet(f"{d}/orders.parquet"))


_hit = lambda c, r=5, where="true": f"EXISTS (SELECT 1 FROM {c} b WHERE {where} AND {near(r)})"
_moving = (
    f"eph AS ({EPHEMERIS.format(orders='orders')}), mid AS (SELECT body_id, avg(ra) AS ra, avg(dec) AS dec FROM eph GROUP BY body_id), "
    "c AS (SELECT q.id, q.ra, q.dec, q.mjd, mid.body_id FROM q JOIN mid ON abs(q.dec - mid.dec) < 0.5 AND abs(q.ra - mid.ra) < 0.7 WHERE q.mjd IS NOT NULL), "
    "c0 AS (SELECT c.*, e.t AS t0, e.ra AS ra0, e.dec AS dec0 FROM c ASOF JOIN eph e ON c.body_id = e.body_id AND c.mjd >= e.t), "
    "c1 AS (SELECT c0.*, e.t AS t1, e.ra AS ra1, e.dec AS dec1 FROM c0 ASOF JOIN eph e ON c0.body_id = e.body_id AND c0.mjd < e.t), "
    "c2 AS (SELECT id, body_id, ra, dec, ra0 + (mjd - t0) / (t1 - t0) * (ra1 - ra0) AS r_ra, dec0 + (mjd - t0) / (t1 - t0) * (dec1 - dec0) AS r_dec FROM c1), "
    f"c3 AS (SELECT id, body_id, {sky.haversine('ra', 'dec', 'r_ra', 'r_dec')} AS s FROM c2), "
    "c4 AS (SELECT id, arg_min(body_id, (s, body_id)) AS body_id, min(s) AS best_sep, count(*) AS n FROM c3 WHERE s <= 60 GROUP BY id), "
    "mv AS (SELECT q.id, body_id, best_sep, coalesce(n, 0) AS n, CASE WHEN mjd IS NULL THEN 'no_epoch' WHEN mjd < (SELECT min(t) FROM eph) OR mjd > (SELECT max(t) FROM eph) THEN 'not_tabulated' ELSE 'ok' END AS state FROM q LEFT JOIN c4 USING (id))"
)


@query("A12 SKYBOT B08", cte("det") + f", {_duck_rows}, {_moving} SELECT id, body_id, round(best_sep, 5) AS best_sep, n AS matched_count, coalesce(best_sep <= 5, false) AS strict_match, coalesce(best_sep > 5, false) AS wide_match, state AS epoch_status FROM mv")
def moving_bodies(spark, d):
    m = ephemeris.moving_flags(_rows(spark, d), "id", _ephemeris(spark, d))
    return m.withColumn("best_sep", F.round("best_sep", 5))


# --- from all rows to the final list ----------------------------------------------------------------------------
_scores = "SELECT id, tile_id, id % 7 <> 2 AS matched, CASE WHEN id % 29 <> 1 THEN spread END AS spread_model FROM {det} WHERE tile_id % 10 <> 9 AND id % 17 <> 3"


def _post_chain(spark, d):
    rows = _rows(spark, d)
    scores = spark.sql(_scores, det=view(spark, d, "det"))
    observed = view(spark, d, "cat_a").withColumn("ngoodobs", F.expr("CASE WHEN n_detections % 3 > 0 THEN n_detections - 25 END"))
    stages = [
        post.spread("id", scores, least=-0.002),
        post.skybot("id", _ephemeris(spark, d), after="spread"),
        post.matched("scos", view(spark, d, "cat_b"), 5, keeps=True, after="skybot"),
        post.ptf(observed, 5, after="scos"),
        post.matched("vsx", view(spark, d, "cat_c"), 5, after="ptf"),
        post.scope_dec(-15.0, after="vsx"),
        post.matched("gsc", post.wrapped(view(spark, d, "cat_c").withColumn("ra", F.col("ra") - 360)), 8, after="vsx"),
    ]
    return chain.Chain(rows, "id", stages)


_judged = cte("det", "cat_a", "cat_b", "cat_c") + f""", {_duck_rows}, {_moving}, sc AS ({_scores.format(det='det')}),
m AS (SELECT a.id, a.ra, a.dec, mv.state, mv.best_sep, {_hit('cat_b')} AS in_b, {_hit('cat_a', 5, 'b.n_detections % 3 > 0 AND b.n_detections > 25')} AS in_a, {_hit('cat_c')} AS in_c, {_hit('cat_c', 8)} AS in_g,
EXISTS (SELECT 1 FROM sc WHERE sc.tile_id = a.tile_id) AS scored, sc.id IS NOT NULL AS found, sc.matched, sc.spread_model FROM q a JOIN mv USING (id) LEFT JOIN sc ON sc.id = a.id),
s1 AS (SELECT *, CASE WHEN NOT scored THEN 'postscore_missing' WHEN NOT found THEN 'postscore_row_not_found' WHEN NOT matched OR spread_model IS NULL THEN 'postscore_unmatched' WHEN spread_model <= -0.002 THEN 'spread_model_below_gate' ELSE 'ok' END AS spread_status FROM m),
s2 AS (SELECT *, CASE WHEN spread_status = 'spread_model_below_gate' THEN NULL WHEN state <> 'ok' THEN state WHEN best_sep <= 5 THEN 'strict' WHEN best_sep <= 60 THEN 'wide' ELSE 'clear' END AS skybot_status FROM s1),
s3 AS (SELECT *, CASE WHEN skybot_status IS NULL OR skybot_status = 'strict' THEN NULL WHEN dec IS NULL THEN 'no_position' WHEN in_b THEN 'matched' ELSE 'unmatched' END AS scos_status FROM s2),
s4 AS (SELECT *, CASE WHEN scos_status IS NULL OR scos_status = 'unmatched' THEN NULL WHEN dec IS NULL THEN 'no_position' WHEN in_a THEN 'matched' ELSE 'unmatched' END AS ptf_status FROM s3),
s5 AS (SELECT *, CASE WHEN ptf_status IS NULL OR ptf_status = 'matched' THEN NULL WHEN dec IS NULL THEN 'no_position' WHEN in_c THEN 'matched' ELSE 'unmatched' END AS vsx_status FROM s4),
s6 AS (SELECT *, CASE WHEN vsx_status IS NULL OR vsx_status = 'matched' THEN NULL WHEN dec IS NULL THEN 'dec_parse_error' WHEN dec < -15 THEN 'dec_below_scope' ELSE 'ok' END AS scope_status,
CASE WHEN vsx_status IS NULL OR vsx_status = 'matched' THEN NULL WHEN dec IS NULL THEN 'no_position' WHEN in_g THEN 'matched' ELSE 'unmatched' END AS gsc_status FROM s5)"""
_POST = {"spread": ("spread_model_below_gate",), "skybot": ("strict",), "scos": ("unmatched",), "ptf": ("matched",), "vsx": ("matched",), "scope": ("dec_below_scope",), "gsc": ("matched",)}
_drop = lambda n: "(" + ", ".join(f"'{x}'" for x in _POST[n]) + ")"


@query("2.M SPREAD SKYBOT SCOS PTF VSX SCOPE_DEC GSC C07 C12 D09 D16 A22 R4", _judged + " SELECT id, " + ", ".join(f"{n}_status, {n}_status NOT IN {_drop(n)} AS {n}_keep" for n in _POST) + " FROM s6")
def post_chain_flags(spark, d):
    names = [c for n in _POST for c in (f"{n}_status", f"{n}_keep")]
    return _post_chain(spark, d).flags().select("id", *names)


_states = {
    "spread": ("postscore_missing", "postscore_row_not_found", "postscore_unmatched", "spread_model_below_gate", "ok"),
    "skybot": ("no_epoch", "not_tabulated", "strict", "wide", "clear"),
    "scope": ("dec_parse_error", "dec_below_scope", "ok"),
} | {n: ("no_position", "matched", "unmatched") for n in ("scos", "ptf", "vsx", "gsc")}
_follows = {"skybot": "spread", "scos": "skybot", "ptf": "scos", "vsx": "ptf", "scope": "vsx", "gsc": "vsx"}


@query("2.M A22 A29 E01 D16", _judged + " " + " UNION ALL ".join(
    f"SELECT {k} AS step, '{n}' AS stage, {repr(_follows[n]) if n in _follows else 'CAST(NULL AS VARCHAR)'} AS follows, '{x}' AS status, count(*) FILTER ({n}_status = '{x}') AS rows, count({n}_status) AS input_rows, count(*) FILTER ({n}_status IN {_drop(n)}) AS dropped_rows, count(*) FILTER ({n}_status NOT IN {_drop(n)}) AS kept_rows FROM s6"
    for k, n in enumerate(_POST) for x in _states[n]))
def post_chain_ledger(spark, d):
    return _post_chain(spark, d).ledger()


@query("2.M A22 R2 R4", _judged + " SELECT s6.id, det.src_id, det.flags FROM s6 JOIN det USING (id) WHERE scope_status IN ('ok', 'dec_parse_error')")
def post_chain_kept(spark, d):
    chained = _post_chain(spark, d)
    return view(spark, d, "det").select("id", "src_id", "flags").join(chained.kept("scope").select("id"), "id", "left_semi")


# --- shapes, plates, edges --------------------------------------------------------------------------------------
_boxes = "SELECT id AS plate_id, ra - 2e0 AS ra_min, ra + 2.5e0 AS ra_max, dec - 9e0 AS dec_min, dec + 9e0 AS dec_max FROM {plates} WHERE id > 0"


def _objects(spark, d):
    return view(spark, d, "cat_a").withColumn("flag", F.expr("(id * 50) % 300"))


def _morph_chain(spark, d):
    rows, stars = _rows(spark, d), view(spark, d, "cat_a")
    psf = post.tile_psf(view(spark, d, "det").withColumn("field", F.expr("id % 20")), stars, "id", "field", radius=6, least=3).where("field <> 11")
    stages = [
        post.morph("id", psf, "field", after=None),
        post.shape(after="morph"),
        post.maps("id", _objects(spark, d), spark.sql(_boxes, plates=view(spark, d, "plates")), 5, after="shape"),
        post.edge("id", view(spark, d, "plates"), 12.0, after="shape"),
    ]
    return chain.Chain(rows, "id", stages)


_reach = "least((5e0 / 3600) / greatest(cos(radians(a.dec)), 0.05), 180e0)"
_lo, _hi = f"((a.ra - {_reach} + 720) % 360)", f"((a.ra + {_reach} + 720) % 360)"
_overlap = f"p.dec_max >= a.dec - 5e0 / 3600 AND p.dec_min <= a.dec + 5e0 / 3600 AND CASE WHEN {_lo} <= {_hi} THEN p.ra_max >= {_lo} AND p.ra_min <= {_hi} ELSE p.ra_max >= {_lo} OR p.ra_min <= {_hi} END"


@query("2.M MORPH SHAPE MAPS EDGE C13 C14 C15 C17 E05 A07b B25", cte("det", "cat_a", "plates") + f""", {_duck_rows}, bx AS ({_boxes.format(plates='plates')}),
st AS (SELECT a.id, a.id % 20 AS field, fwhm, spread FROM det a WHERE flags = 0 AND elong < 1.3 AND fwhm IS NOT NULL AND {_hit('cat_a', 6, 'b.mag > 12 AND b.mag < 18')}),
pf AS (SELECT field, median(fwhm) AS pw, median(spread) AS ps, count(*) AS n FROM st GROUP BY field),
m AS (SELECT a.*, pw, ps, coalesce(n, 0) AS n, CASE WHEN a.fwhm / pw > 1.5 THEN 'fwhm_ratio' END AS r1, CASE WHEN a.spreaderr > 0 AND (a.spread - ps) / a.spreaderr > 5 THEN 'spread_snr' END AS r2,
CASE WHEN profile_diff > 0.05 THEN 'profile_diff' END AS r3, CASE WHEN elongation > 1.10 THEN 'elongation' END AS r4, CASE WHEN circularity < 0.80 THEN 'circularity' END AS r5,
{_hit('cat_a', 5, '(b.id * 50) % 300 % 100 = 0')} AS in_maps, (SELECT count(*) FROM bx p WHERE {_overlap}) AS covered, (SELECT min({sky.haversine('a.ra', 'a.dec', 'p.ra', 'p.dec')}) FROM plates p) / 3600 AS sep_best FROM q a LEFT JOIN pf ON pf.field = a.field),
s1 AS (SELECT *, CASE WHEN field = 11 THEN 'catalog_missing' WHEN n < 3 THEN 'psf_insufficient' WHEN fwhm IS NULL OR spread IS NULL OR spreaderr IS NULL THEN 'candidate_not_found' WHEN concat_ws(';', r1, r2) <> '' THEN concat_ws(';', r1, r2) ELSE 'ok' END AS morph_status FROM m),
s2 AS (SELECT *, CASE WHEN morph_status IN ('fwhm_ratio', 'spread_snr', 'fwhm_ratio;spread_snr') THEN NULL WHEN concat_ws(';', r3, r4, r5) <> '' THEN concat_ws(';', r3, r4, r5) ELSE 'ok' END AS shape_status FROM s1),
s3 AS (SELECT *, CASE WHEN shape_status <> 'ok' OR shape_status IS NULL THEN NULL WHEN dec IS NULL THEN 'no_position' WHEN in_maps THEN 'matched' WHEN covered = 0 THEN 'no_coverage' ELSE 'unmatched' END AS maps_status, CASE WHEN shape_status <> 'ok' OR shape_status IS NULL THEN NULL WHEN dec IS NULL THEN 'unresolved' WHEN sep_best > 12 THEN 'outside_core' ELSE 'core' END AS edge_status FROM s2)
SELECT id, morph_status, shape_status, maps_status, edge_status, covered, maps_status <> 'matched' AS maps_keep FROM s3""")
def morph_chain_flags(spark, d):
    f = _morph_chain(spark, d).flags()
    return f.select("id", "morph_status", "shape_status", "maps_status", "edge_status", "covered", "maps_keep")


@query("2.M PS1 USNOB USNO C08 C09 B10b", cte("det", "cat_a", "cat_b") + f""", {_duck_rows},
e AS (SELECT id, dec + coalesce(pmdec, 0) * -50 / 3.6e6 AS dec, ra, coalesce(pmra, 0) AS pm FROM cat_b WHERE band % 3 = 0 OR band % 4 = 1),
f AS (SELECT id, dec, ra + pm * -50 / 3.6e6 / cos(radians(least(89.9, greatest(-89.9, dec)))) AS ra FROM e),
m AS (SELECT a.id, a.dec, {_hit('cat_a')} AS in_ps1, {_hit('f')} AS in_usnob, (SELECT min({HAV}) FROM f b WHERE {near(5)}) AS sep FROM q a)
SELECT id, CASE WHEN dec IS NULL THEN 'dec_parse_error' WHEN dec < 0 THEN 'removed_by_cut' ELSE 'ok' END AS south_status, CASE WHEN dec IS NULL THEN 'no_position' WHEN dec < 0 THEN NULL WHEN in_ps1 THEN 'matched' ELSE 'unmatched' END AS ps1_status,
CASE WHEN dec IS NULL THEN 'no_position' WHEN in_usnob THEN 'matched' ELSE 'unmatched' END AS usnob_status, round(sep, 5) AS usnob_sep FROM m""")
def remote_chain_flags(spark, d):
    """Two chains from the same rows: southern cut then PS1, and second-epoch USNO-B at the plate's epoch."""
    b = view(spark, d, "cat_b").selectExpr("id", "ra", "dec", "pmra", "pmdec", "CASE WHEN band % 3 = 0 THEN 15e0 END AS b2mag", "CASE WHEN band % 4 = 1 THEN 14e0 ELSE double('NaN') END AS r2mag", "CASE WHEN band = 11 THEN 13e0 END AS imag")
    chained = chain.Chain(_rows(spark, d), "id", [*post.southern(view(spark, d, "cat_a")), post.usnob(b)])
    return chained.flags().select("id", "south_status", "ps1_status", "usnob_status", F.round("usnob_sep", 5).alias("usnob_sep"))


# --- scans by plate boxes ---------------------------------------------------------------------------------------
_plate_objects = "SELECT a.id, a.ra, a.dec, CAST(floor((a.ra + 2e0) / 14.4e0) AS BIGINT) AS plate_id, (a.id * 50) % 300 AS flag, CAST(a.mag * 731 AS BIGINT) AS magd FROM {cat_a} a"


def plate_folder(spark, d) -> str:
    """The object table by plate, written once for its content."""
    from skyweave.sources.parts import table_print

    objects = spark.sql(_plate_objects, cat_a=view(spark, d, "cat_a"))
    folder = f"{shared_folder(spark)}/plates-{table_print(objects)}"
    boxes.write_plates(objects, folder)
    return folder


@query("A07 A07b C10 T21", cte("det", "cat_a", "plates") + f", bx AS ({_boxes.format(plates='plates')}), o AS ({_plate_objects.format(cat_a='cat_a')}) SELECT a.id, p.plate_id, b.id AS r_id, round(b.magd / 1000e0, 3) AS magd, round({HAV}, 5) AS sep_arcsec FROM det a JOIN bx p ON {_overlap.replace('5e0 / 3600', '90e0 / 3600')} JOIN o b ON b.plate_id = p.plate_id AND b.flag % 100 = 0 AND {near(90)}")
def plate_box_scan(spark, d):
    """Cones of 1.5 arcmin around all detections, on the plates that they overlap."""
    rows = view(spark, d, "det").select("id", "ra", "dec")
    plates = spark.sql(_boxes, plates=view(spark, d, "plates"))
    found = boxes.plate_scan(spark, plate_folder(spark, d), rows, "id", plates, 90, ("magd",))
    return found.select("id", "plate_id", "r_id", F.round("r_magd", 3).alias("magd"), F.round("sep_arcsec", 5).alias("sep_arcsec"))
