"""Queries over batches, fits, nested stages, upserts, chunks and resumable parts, with oracles by brute force."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from skyweave.operators import filters, fit, funnel, segment, skyjoin
from skyweave.sources import catalogue, chunks, ecsv, export, parts, upsert
from skyweave.sources.shared import shared_folder, written
from skyweave.sources.views import cte, view

from .registry import HAV, near, query


def _new_folder(spark, name: str) -> str:
    """A folder of its own for what a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# --- batches ----------------------------------------------------------------------------------------------------
def _step(full: str) -> str:
    return f"CASE WHEN {full} THEN r.batch + 1 ELSE r.batch END, CASE WHEN {full} THEN 1 ELSE r.c + 1 END, CASE WHEN {full} THEN t.n ELSE r.s + t.n END"


@query("F05", cte("cat_a").replace("WITH ", "WITH RECURSIVE ", 1) + f", t AS (SELECT id, (id * 37) % 90 AS n, row_number() OVER (ORDER BY id) AS i FROM cat_a), r AS (SELECT i, id, 0 AS batch, 1 AS c, n AS s FROM t WHERE i = 1 UNION ALL SELECT t.i, t.id, {_step('r.c + 1 > 12 OR r.s + t.n > 400')} FROM r JOIN t ON t.i = r.i + 1) SELECT id, CAST(batch AS INTEGER) AS batch FROM r")
def row_batches(spark, d):
    """Batches over as many groups as the catalogue has rows."""
    return segment.batches(view(spark, d, "cat_a").selectExpr("id", "(id * 37) % 90 AS n"), "id", "n", 12, 400, block=256)


# --- fits -------------------------------------------------------------------------------------------------------
_ties = "SELECT id % 40 AS g, ra / 360 AS x, dec / 60 AS y, (0.5e0 + 2e0 * ra / 360 + (id % 7) / 2e0 + CASE WHEN id % 19 = 0 THEN 8e0 ELSE 0e0 END) / 3600 AS ox, (1e0 - dec / 60 + (id % 5) / 3e0) / 3600 AS oy FROM {det} WHERE id % 40 <> 6 OR id < 300"
RULES = fit.Rules(degree=1, least=20)
_det3 = "sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx)"


def _cramer(o: str) -> str:
    """Slope in x, slope in y and constant of one offset by Cramer's rule."""
    a = f"(s{o}x * (syy * n - sy * sy) - sxy * (s{o}y * n - sy * s{o}) + sx * (s{o}y * sy - syy * s{o})) / ({_det3})"
    b = f"(sxx * (s{o}y * n - sy * s{o}) - s{o}x * (sxy * n - sy * sx) + sx * (sxy * s{o} - s{o}y * sx)) / ({_det3})"
    c = f"(sxx * (syy * s{o} - s{o}y * sy) - sxy * (sxy * s{o} - s{o}y * sx) + s{o}x * (sxy * sy - syy * sx)) / ({_det3})"
    return f"{a} AS {o}a, {b} AS {o}b, {c} AS {o}c"


def _fit_oracle() -> str:
    out = [f"m0 AS ({_ties.format(det='det')})"]
    for k in range(RULES.rounds + 1):
        out.append(f"s{k} AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(ox) AS su, sum(ox * x) AS sux, sum(ox * y) AS suy, sum(oy) AS sv, sum(oy * x) AS svx, sum(oy * y) AS svy FROM m{k} GROUP BY g HAVING count(*) >= {RULES.least})")
        out.append(f"c{k} AS (SELECT g, n, {_cramer('u')}, {_cramer('v')} FROM s{k})")
        if k < RULES.rounds:  # residuals of all rows, also of those that have gone
            out.append(f"r{k} AS (SELECT m.*, sqrt(pow(ox - ua * x - ub * y - uc, 2) + pow(oy - va * x - vb * y - vc, 2)) * 3600 AS r FROM m0 m JOIN c{k} USING (g))")
            out.append(f"h{k} AS (SELECT g, median(r) AS mid FROM r{k} GROUP BY g), q{k} AS (SELECT g, 1.4826 * median(abs(r - mid)) AS sigma FROM r{k} JOIN h{k} USING (g) GROUP BY g)")
            out.append(f"l{k} AS (SELECT g, sigma, least(10, greatest(1.5, 3 * sigma)) AS lim FROM q{k}), m{k + 1} AS (SELECT g, x, y, ox, oy FROM r{k} JOIN l{k} USING (g) JOIN m{k} USING (g, x, y, ox, oy) WHERE r <= lim)")
    last = RULES.rounds
    return cte("det") + ", " + ", ".join(out) + f" SELECT z.g, z.n AS n_in, coalesce(c.n, 0) AS kept, CASE WHEN z.n < {RULES.least} THEN 'too_few' WHEN c.g IS NULL THEN 'too_few_after_clipping' ELSE 'ok' END AS status, round(uc * 1e6, 4) AS ra0, round(ua * 1e6, 4) AS ra_x, round(ub * 1e6, 4) AS ra_y, round(vc * 1e6, 4) AS dec0, round(va * 1e6, 4) AS dec_x, round(vb * 1e6, 4) AS dec_y, round(sigma, 5) AS sigma FROM (SELECT g, count(*) AS n FROM m0 GROUP BY g) z LEFT JOIN c{last} c USING (g) LEFT JOIN l{last - 1} USING (g)"


@query("E04 B22", _fit_oracle())
def wcs_poly_fit(spark, d):
    """Degree 1, clipped three times."""
    f = fit.robust_fit(spark.sql(_ties, det=view(spark, d, "det")), ["g"], RULES)
    named = [F.round(F.col(c)[k] * 1e6, 4).alias(n) for c, names in (("cx", ("ra0", "ra_x", "ra_y")), ("cy", ("dec0", "dec_x", "dec_y"))) for k, n in enumerate(names)]
    return f.select("g", "n_in", "kept", "status", *named, F.round("sigma", 5).alias("sigma"))


# --- nested stages ----------------------------------------------------------------------------------------------
LADDER = [("VETOED_A", "a", False), ("VETOED_B", "b", False), ("VETOED_C", "c", False), ("EXTRACT", "rej_extract", True), ("MORPHOLOGY", "rej_morph", True), ("SPIKE", "rej_spike", True), ("UNATTRIBUTED", "filtered", False)]
_spiky = f"SELECT id, arg_min(rmag, s) AS m, min(s) AS s FROM (SELECT a.id, b.rmag, {HAV} AS s FROM det a JOIN cat_c b ON {near(90)} WHERE b.rmag <= 16) GROUP BY id"


def _stage_tables(spark, d):
    """Detections, tables of the stages they went through, and the final list."""
    det = view(spark, d, "det")
    slim = det.select("id", "tile_id", "ra", "dec")
    tables, left = {}, slim
    for n, c, r in (("a", "cat_a", 3), ("b", "cat_b", 3), ("c", "cat_c", 3)):
        left = written(skyjoin.anti(left, view(spark, d, c), r, ["id"]))
        tables[n] = left
    rows = written(det.join(left.select("id"), "id", "left_semi"))
    extracted = filters.extract_filter(rows, 20)
    shaped = filters.hard_gates(extracted)
    masked = filters.spike_mask(shaped, view(spark, d, "cat_c"), ["id"]).select("id", "tile_id", "spike")
    kept = written(shaped.join(masked.where("NOT spike").select("id"), "id", "left_semi").select("id", "tile_id", "src_id", "ra", "dec"))
    less = lambda x, y: x.join(y.select("id"), "id", "left_anti")
    tables |= {"rej_extract": less(rows, extracted), "rej_morph": less(extracted, shaped), "rej_spike": masked.where("spike"), "filtered": kept}
    final = kept.where("id % 9 <> 4")
    return slim, tables, final


_marks = cte("det", "ref", "cat_a", "cat_b", "cat_c") + f""", sp AS ({_spiky}),
o AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM cat_a b WHERE {near(3)}) THEN 1 WHEN EXISTS (SELECT 1 FROM cat_b b WHERE {near(3)}) THEN 2 WHEN EXISTS (SELECT 1 FROM cat_c b WHERE {near(3)}) THEN 3 WHEN flags <> 0 OR snr <= 20 THEN 4
WHEN NOT (spread > -0.002 AND fwhm > 2 AND fwhm < 7 AND elong < 1.3 AND abs(dx - dy) < 2 AND dx > 1 AND dy > 1) THEN 5 WHEN sp.m <= 12.4 OR sp.m < -0.09 * sp.s + 15.3 THEN 6 ELSE 8 END AS rk FROM det a LEFT JOIN sp USING (id)),
p AS (SELECT a.id, b.id AS det, b.tile_id, b.rk, {HAV} AS s FROM ref a JOIN o b ON {near(10)}), n AS (SELECT *, row_number() OVER (PARTITION BY id, tile_id ORDER BY s, det) AS k FROM p),
f AS (SELECT n.id, n.det, n.tile_id, n.s, CASE WHEN rk = 8 AND NOT EXISTS (SELECT 1 FROM p z JOIN det y ON y.id = z.det WHERE z.id = n.id AND z.tile_id = n.tile_id AND z.rk = 8 AND y.id % 9 <> 4) THEN 7.5 ELSE rk END AS rk FROM n WHERE k = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk DESC, s, tile_id) AS k FROM f),
w AS (SELECT r.id, CASE rk WHEN 1 THEN 'VETOED_A' WHEN 2 THEN 'VETOED_B' WHEN 3 THEN 'VETOED_C' WHEN 4 THEN 'EXTRACT' WHEN 5 THEN 'MORPHOLOGY' WHEN 6 THEN 'SPIKE' WHEN 7.5 THEN 'DEDUP_DROPPED' WHEN 8 THEN 'SURVIVED' ELSE 'NEVER_DETECTED' END AS stage, best.s, tile_id, det FROM ref r LEFT JOIN best ON best.id = r.id AND k = 1)"""


@query("F02 D20", _marks + " SELECT id, stage, round(s, 6) AS sep_arcsec, tile_id, det FROM w")
def best_outcomes(spark, d):
    det, tables, final = _stage_tables(spark, d)
    bits = funnel.membership({"raw": det} | tables, ["tile_id", "id"])
    told = bits.select("tile_id", "id", *funnel.outcome({"raw": det} | tables, LADDER, "SURVIVED"))
    best = funnel.best_outcome(view(spark, d, "ref"), det, told, 10, final)
    return best.withColumn("sep_arcsec", F.round("sep_arcsec", 6))


@query("E13 D20 T19", _marks + " SELECT stage, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM w), 6) AS of_all, CASE WHEN stage <> 'NEVER_DETECTED' THEN round(100e0 * count(*) / (SELECT count(*) FROM w WHERE stage <> 'NEVER_DETECTED'), 6) END AS of_detected FROM w GROUP BY stage")
def loss_shares(spark, d):
    s = funnel.shares(best_outcomes(spark, d))
    return s.select("stage", "n", F.round("of_all", 6).alias("of_all"), F.round("of_detected", 6).alias("of_detected"))


# --- upserts, parts, chunks, text tables ------------------------------------------------------------------------
@query("A23", cte("det") + ", u AS (SELECT tile_id, id, snr, ts, snr > 50 AS late FROM det) SELECT tile_id, id, snr FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY late DESC, ts DESC, id DESC) AS n FROM u) WHERE n = 1")
def tile_upserts(spark, d):
    """Two merges one after the other: what the second brings replaces the first."""
    folder, det = _new_folder(spark, "upserts"), view(spark, d, "det").select("tile_id", "id", "snr", "ts")
    for rows in (det.where("snr <= 50"), det.where("snr > 50")):
        upsert.merge(rows, folder, ["tile_id"], ["ts", "id"], 16)
    return upsert.current(spark, folder, det).select("tile_id", "id", "snr")


_sums = "SELECT 'first' AS run, (SELECT count(DISTINCT tile_id) FROM det) AS worked, count(*) AS n, sum(snr) AS snr FROM det UNION ALL SELECT 'again', 0, count(*), sum(snr) FROM det UNION ALL SELECT 'one row changed', 1, count(*), sum(snr) + 5 FROM det UNION ALL SELECT 'other parameter', (SELECT count(DISTINCT tile_id) FROM det), count(*), sum(snr) FROM det"


@query("J03 B31 J01", cte("det") + f" SELECT run, worked, n, CAST(snr AS BIGINT) AS snr FROM ({_sums})")
def resumed_parts(spark, d):
    """Parts worked out by a first run, by a rerun, after a change of one row, and for another parameter."""
    det, folder = view(spark, d, "det").select("id", "tile_id", "snr"), _new_folder(spark, "parts")
    first = det.agg(F.min("id").alias("least"))
    changed = det.crossJoin(F.broadcast(first)).select("id", "tile_id", (F.col("snr") + F.when(F.col("id") == F.col("least"), 5).otherwise(0)).alias("snr"))
    work = lambda rows: rows.groupBy(F.col("tile_id").cast("string").alias("part")).agg(F.count("*").alias("n"), F.sum("snr").alias("snr"))
    out = None
    for run, rows, radius in (("first", det, 5), ("again", det, 5), ("one row changed", changed, 5), ("other parameter", det, 8)):
        found, n = parts.resume(rows, "tile_id", work, folder, {"radius": radius})
        one = found.agg(F.lit(run).alias("run"), F.lit(n).cast("long").alias("worked"), F.sum("n").alias("n"), F.sum("snr").cast("long").alias("snr"))
        out = one if out is None else out.union(one)
    return out


@query("A21", cte("cat_a") + " SELECT lpad(CAST((k // 150) + 1 AS VARCHAR), 7, '0') AS chunk, count(*) AS n, 1 AS files, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM cat_a) GROUP BY 1")
def chunk_files(spark, d):
    """Rows read back from files of 150 rows each."""
    folder = _new_folder(spark, "chunks")
    chunks.write_chunks(view(spark, d, "cat_a").select("id", "ra", "dec"), ["id"], 150, folder)
    back = spark.read.option("header", True).schema("id long, ra double, dec double, chunk string").csv(folder).withColumn("file", F.input_file_name())
    return back.groupBy("chunk").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("A31", cte("det") + " SELECT id % 25 AS plate_id, count(*) AS n, round(sum(ra), 4) AS ra, round(sum(dec), 4) AS dec, min(tile_id) AS tile FROM det GROUP BY 1")
def plate_files(spark, d):
    folder = _new_folder(spark, "lean")
    chunks.write_plates(view(spark, d, "det").withColumn("plate_id", F.expr("id % 25")), "plate_id", ["id"], folder, ["ra", "dec", "snr", "tile_id"])
    back = spark.read.option("header", True).schema("ra double, dec double, snr double, tile_id long, plate_id long").csv(folder)
    return back.groupBy("plate_id").agg(F.count("*").alias("n"), F.round(F.sum("ra"), 4).alias("ra"), F.round(F.sum("dec"), 4).alias("dec"), F.min("tile_id").alias("tile"))


@query("A15", cte("det") + " SELECT id, tile_id, round(ra, 9) AS ra, src_id, CASE WHEN id % 3 > 0 THEN spread END AS spread, flags > 1 AS bad FROM det")
def text_tables(spark, d):
    """Detections written as text tables with typed headers, read back by Spark's scan."""
    spark.dataSource.register(ecsv.EcsvSource)
    folder = _new_folder(spark, "ecsv")
    rows = view(spark, d, "det").selectExpr("id", "tile_id", "ra", "src_id", "CASE WHEN id % 3 > 0 THEN spread END AS spread", "flags > 1 AS bad")
    rows.write.format("ecsv").mode("overwrite").save(folder)
    return ecsv.read_ecsv(spark, f"{folder}/*.ecsv").withColumn("ra", F.round("ra", 9))


@query("A19", cte("cat_a") + " SELECT CAST(least(floor((dec + 90) / 0.5e0), 359) AS INTEGER) AS zone, count(*) AS n, 1 AS files, min(id) AS first_id FROM cat_a GROUP BY 1")
def zone_files(spark, d):
    """A catalogue written by declination zone, a file each, and read back."""
    folder = _new_folder(spark, "zones")
    catalogue.ingest(view(spark, d, "cat_a"), folder, {"id": "id AS long", "ra": "ra AS double", "dec": "dec AS double"}, catalogue.dec_zone(F.col("dec"), 0.5), name="zone")
    back = catalogue.opened(spark, folder).withColumn("file", F.input_file_name())
    return back.groupBy(F.col("zone").cast("int").alias("zone")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.min("id").alias("first_id"))


@query("A20", cte("det") + " SELECT kind, id, round(ra, 6) AS ra, flags, n_values FROM det, (VALUES ('csv', NULL), ('parquet', 2)) k(kind, n_values)")
def exported_catalogue(spark, d):
    """What an export to both forms holds: text without the column of arrays, Parquet with it."""
    folder = _new_folder(spark, "export")
    export.export(view(spark, d, "det").selectExpr("id", "ra", "flags", "array(dx, dy) AS cut"), folder, "both")
    text = spark.read.option("header", True).schema("id long, ra double, flags long").csv(f"{folder}/catalogue.csv")
    table = spark.read.parquet(f"{folder}/catalogue.parquet").select("id", "ra", "flags", F.size("cut").alias("n_values"))
    both = text.select(F.lit("csv").alias("kind"), "*").unionByName(table.select(F.lit("parquet").alias("kind"), "*"), allowMissingColumns=True)
    return both.select("kind", "id", F.round("ra", 6).alias("ra"), "flags", "n_values")


_facts = "SELECT 'rows_in' AS name, CAST(count(*) AS VARCHAR) AS value FROM det UNION ALL SELECT 'kept', CAST(count(*) FILTER (flags = 0) AS VARCHAR) FROM det UNION ALL SELECT 'note', 'a \"quoted\" text' UNION ALL SELECT 'tiles', CAST(count(DISTINCT tile_id) AS VARCHAR) FROM det"


@query("A29", cte("det") + f", f AS ({_facts}) SELECT '{{' || string_agg('\"' || name || '\":\"' || replace(value, '\"', '\\\"') || '\"', ',' ORDER BY name) || '}}' AS json, '| name | value |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || name || ' | ' || value || ' |', chr(10) ORDER BY name) AS markdown FROM f")
def run_summary(spark, d):
    """Facts of a run, with keys that are merged in later."""
    det = view(spark, d, "det")
    rows = det.agg(F.count("*").alias("rows_in"), F.count(F.when(F.col("flags") == 0, 1)).alias("kept"), F.lit("old").alias("note"))
    first = rows.select(F.explode(F.create_map(*(x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("name", "value"))
    more = det.agg(F.count_distinct("tile_id").cast("string").alias("n")).select(F.explode(F.create_map(F.lit("tiles"), F.col("n"), F.lit("note"), F.lit('a "quoted" text'))).alias("name", "value"))
    return export.summary_texts(export.merged_facts(first, more))
