import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import boxes, cells, chain, ephemeris
from skyweave.operators import post_stages as post
from skyweave.sources import parts


def test_cells_of_boxes_have_the_cells_of_their_points(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        dec, h = rng.choice([rng.uniform(-90, 90), 89.99, -90.0, 0.0]), rng.uniform(0, 4)
        ra, w = rng.uniform(0, 360), rng.uniform(0, 6)
        lo, hi = max(-90.0, dec - h), min(90.0, dec + h)
        rows.append((k, ra - w, ra + w, lo, hi, (ra + rng.uniform(-w, w)) % 360, rng.uniform(lo, hi)))
    df = spark.createDataFrame(rows, "k long, a double, b double, lo double, hi double, ra double, dec double")
    got = df.selectExpr(f"array_contains({cells.touched('a', 'b', 'lo', 'hi', 1.5)}, {cells.own('ra', 'dec', 1.5)}) AS ok", f"size({cells.touched('a', 'b', 'lo', 'hi', 1.5)}) - size(array_distinct({cells.touched('a', 'b', 'lo', 'hi', 1.5)})) AS twice")
    assert got.where("NOT ok OR twice <> 0").count() == 0


def test_cells_of_cones(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        ra, dec, r = rng.uniform(0, 360), rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90)]), rng.uniform(0.01, 3)
        away, turn = math.radians(r * rng.random()), rng.uniform(0, 2 * math.pi)
        s = math.sin(math.radians(dec)) * math.cos(away) + math.cos(math.radians(dec)) * math.sin(away) * math.cos(turn)
        x = math.atan2(math.sin(turn) * math.sin(away) * math.cos(math.radians(dec)), math.cos(away) - math.sin(math.radians(dec)) * s)
        rows.append((ra, dec, (ra + math.degrees(x)) % 360, math.degrees(math.asin(max(-1, min(1, s))))))
    df = spark.createDataFrame(rows, "ra double, dec double, x double, y double")
    assert df.where(f"NOT array_contains({cells.around('ra', 'dec', 3.0, 1.0)}, {cells.own('x', 'y', 1.0)})").count() == 0


def brute_bodies(rows, table, reach):
    """{key: [(sep, body)]} by walking the table of each body."""
    paths = {}
    for body, t, ra, dec in table:
        if None not in (t, ra, dec):
            paths.setdefault(body, {}).setdefault(t, []).append((ra, dec))
    out = {}
    for key, ra, dec, mjd in rows:
        for body, at in paths.items():
            times = sorted(at)
            if None in (ra, dec, mjd) or not times[0] <= mjd <= times[-1]:
                continue
            for t0, t1 in zip(times, times[1:]):
                if t0 <= mjd < t1 or mjd == t1 == times[-1]:
                    (ra0, dec0), (ra1, dec1) = min(at[t0]), min(at[t1])
                    f = (mjd - t0) / (t1 - t0)
                    x, y = ra0 + f * ((ra1 - ra0 + 180) % 360 - 180), dec0 + f * (dec1 - dec0)
                    a = math.sin(math.radians(y - dec) / 2) ** 2 + math.cos(math.radians(dec)) * math.cos(math.radians(y)) * math.sin(math.radians(x - ra) / 2) ** 2
                    sep = 2 * math.degrees(math.asin(math.sqrt(min(1, a)))) * 3600
                    if sep <= reach:
                        out.setdefault(key, []).append((sep, body))
    return out


def test_moving_bodies_equal_brute_force(spark):
    rng = random.Random(5)
    table, rows = [], []
    for body in range(40):
        ra, dec, v, w = rng.choice([0.01, 359.99, 120.0]), rng.choice([-30.0, 10.0, 89.5, 0.0]), rng.uniform(-0.05, 0.05), rng.uniform(-0.01, 0.01)
        for t in sorted({round(rng.uniform(0, 9), 1) for _ in range(6)}):
            table.append((body, t, (ra + v * t) % 360, min(90.0, dec + w * t)))
        table.append((body, table[-1][1], 77.0, 80.0))  # the same time again: the smaller position counts
    for key in range(150):
        body, t, ra, dec = rng.choice(table)
        rows.append((key, (ra + rng.uniform(-0.02, 0.02)) % 360, max(-90.0, min(90.0, dec + rng.uniform(-0.02, 0.02))), rng.choice([t, t + rng.uniform(-1, 1), rng.uniform(-1, 10)])))
    rows += [(900, None, 1.0, 3.0), (901, 1.0, None, 3.0), (902, 0.01, 10.0, None), (903, 0.01, 10.0, 99.0)]
    table += [(50, None, 1.0, 1.0), (51, 3.0, None, None)]
    df = spark.createDataFrame(rows, "k long, ra double, dec double, mjd double")
    bodies = spark.createDataFrame(table, "body_id long, t double, ra double, dec double")
    want = brute_bodies(rows, table, 60)
    found = {}
    for r in ephemeris.positions(df, "k", ephemeris.segments(bodies), 60, days=0.7, width=0.3).collect():
        found.setdefault(r.k, []).append((r.sep_arcsec, r.body_id))
    assert {k: sorted(b for _, b in v) for k, v in found.items()} == {k: sorted(b for _, b in v) for k, v in want.items()}
    flags = {r.k: r for r in ephemeris.moving_flags(df, "k", bodies).collect()}
    assert len(flags) == len(rows) and len(want) > 20
    for k, v in want.items():
        assert flags[k].matched_count == len(v) and abs(flags[k].best_sep - min(v)[0]) < 1e-6 and flags[k].strict_match == (min(v)[0] <= 5)
    assert {flags[k].epoch_status for k in (902, 903, 0)} == {"no_epoch", "not_tabulated", "ok"}


def test_gap_is_no_segment(spark):
    bodies = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (1, 9.0, 1.0, 1.0)], "body_id long, t double, ra double, dec double")
    rows = spark.createDataFrame([(1, 1.0, 1.0, 0.5), (2, 1.0, 1.0, 5.0), (3, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 9.0)], "k long, ra double, dec double, mjd double")
    found = ephemeris.moving_flags(rows, "k", bodies, longest=2.0).where("matched_count > 0").collect()
    assert sorted(r.k for r in found) == [1, 3]


def test_chain_statuses_pass_for_want_of_evidence(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0), (4, 7.0)], "k long, x double")
    stages = [
        chain.Stage("one", [chain.Case("high", "x > 40", True), chain.Case("unknown", "x IS NULL")], chain.Case("ok", "")),
        chain.Stage("two", [chain.Case("low", "x < 6", True)], chain.Case("ok", ""), after="one"),
        chain.Stage("aside", [chain.Case("big", "x > 6", True)], chain.Case("ok", ""), after=None),
    ]
    c = chain.Chain(rows, "k", stages)
    got = {r.k: (r.one_status, r.one_keep, r.two_status, r.two_keep, r.aside_status) for r in c.flags().collect()}
    assert got == {1: ("ok", True, "low", False, "ok"), 2: ("unknown", True, "ok", True, "ok"), 3: ("high", False, None, None, "big"), 4: ("ok", True, "ok", True, "big")}
    assert sorted(r.k for r in c.kept("two").collect()) == [2, 4]
    ledger = {(r.stage, r.status): (r.rows, r.input_rows, r.dropped_rows, r.kept_rows) for r in c.ledger().collect()}
    assert ledger["two", "low"] == (1, 3, 1, 2) and ledger["one", "unknown"] == (1, 4, 1, 3)
    for name, k in (("one", 4), ("two", 3)):
        assert sum(v[0] for (s, _), v in ledger.items() if s == name) == k
    with pytest.raises(ValueError):
        chain.Chain(rows, "k", stages[1:])
    assert chain.Chain(rows.limit(0), "k", stages).ledger().where("input_rows > 0").count() == 0


def test_chain_of_matches_joins_once_for_each_radius(spark):
    rows = spark.createDataFrame([(k, k * 0.1, 0.0) for k in range(6)], "k long, ra double, dec double")
    cat = lambda ks: spark.createDataFrame([(k, k * 0.1, 1 / 3600) for k in ks], "id long, ra double, dec double")
    stages = [post.matched("a", cat([0, 1])), post.matched("b", cat([1, 2, 3]), keeps=True, after="a"), post.matched("c", cat([2]), after="b")]
    c = chain.Chain(rows, "k", stages)
    assert [r.k for r in c.kept("c").collect()] == [3]
    plan = c.flags()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_cell") and plan.count("Join Inner") == 1


def test_row_without_tile_psf_or_error_is_kept(spark):
    rows = spark.createDataFrame([(1, "t", 9.0, 0.1, 0.0), (2, "u", 9.0, 0.1, 0.01), (3, "v", 9.0, 0.1, 0.01), (4, "t", 2.0, 0.9, 0.01), (5, "t", None, 0.9, 0.01)], "k long, tile_id string, fwhm double, spread double, spreaderr double")
    psf = spark.createDataFrame([("t", 2.0, 0.0, 30, "ok"), ("u", None, None, 3, "psf_insufficient")], "tile_id string, psf_fwhm double, psf_spread double, psf_stars long, psf_status string")
    got = {r.k: (r.morph_status, r.morph_keep) for r in chain.Chain(rows, "k", [post.morph("k", psf)]).flags().collect()}
    assert got == {1: ("fwhm_ratio", False), 2: ("psf_insufficient", True), 3: ("catalog_missing", True), 4: ("spread_snr", False), 5: ("candidate_not_found", True)}


def test_shape_statuses(spark):
    rows = spark.createDataFrame([(1, 0.2, 1.0, 0.9), (2, 0.2, 1.5, 0.1), (3, float("nan"), None, float("nan")), (4, 0.0, 1.5, 0.1)], "k long, profile_diff double, elongation double, circularity double")
    got = {r.k: r.shape_status for r in chain.Chain(rows, "k", [post.shape()]).flags().collect()}
    assert got == {1: "profile_diff", 2: "profile_diff;elongation;circularity", 3: "ok", 4: "elongation;circularity"}


BOXES = [(1, 0.0, 6.0, -3.0, 3.0), (2, 354.0, 360.0, -3.0, 3.0), (3, 0.0, 360.0, 84.0, 90.0), (4, 100.0, 106.0, 40.0, 46.0)]


def test_overlapping_boxes_equal_the_interval_test(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.uniform(0, 8), rng.uniform(352, 360), rng.uniform(98, 108), rng.uniform(0, 360)]), rng.choice([rng.uniform(-5, 5), rng.uniform(80, 90), rng.uniform(38, 48)])) for k in range(400)]
    r, want = 900 / 3600, set()
    for k, ra, dec in rows:
        reach = min(r / max(math.cos(math.radians(dec)), 0.05), 180)
        lo, hi = (ra - reach) % 360, (ra + reach) % 360
        for p, a, b, c, d in BOXES:
            if d >= dec - r and c <= dec + r and ((b >= lo and a <= hi) if lo <= hi else (b >= lo or a <= hi)):
                want.add((k, p))
    df = spark.createDataFrame([*rows, (900, None, 1.0)], "k long, ra double, dec double")
    plates = spark.createDataFrame(BOXES, "plate_id long, ra_min double, ra_max double, dec_min double, dec_max double")
    assert {tuple(x) for x in boxes.overlapping(df, "k", plates, 900).collect()} == want
    cover = {x.k: x.covered for x in boxes.coverage_count(df, "k", plates, 900).collect()}
    assert len(cover) == 401 and cover[900] == 0 and sum(cover.values()) == len(want)


def test_plate_scan_reads_the_files_of_overlapped_plates_only(spark, tmp_path):
    objects = spark.createDataFrame([(i, p, (a + b) / 2 + i * 1e-4, (c + d) / 2, 100 * (i % 2) + (i == 3), 12345 + i) for p, a, b, c, d in BOXES for i in range(5)], "id long, plate_id long, ra double, dec double, flag int, magd long")
    folder = str(tmp_path / "plates")
    boxes.write_plates(objects, folder)
    boxes.write_plates(objects.where("plate_id = 4"), folder)  # a rerun replaces its own plate
    plates = spark.createDataFrame(BOXES, "plate_id long, ra_min double, ra_max double, dec_min double, dec_max double")
    rows = spark.createDataFrame([(7, 103.0, 43.0)], "k long, ra double, dec double")
    found = boxes.plate_scan(spark, folder, rows, "k", plates, 5, ("magd",))
    got = sorted((r.k, r.plate_id, r.r_id, r.r_magd) for r in found.collect())
    assert got == [(7, 4, i, (12345 + i) / 1000) for i in (0, 1, 2, 4)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    read = []

    def walk(node):
        for n in [node] + ([node.finalPhysicalPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []) + ([node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []):
            if n.getClass().getSimpleName() == "FileSourceScanExec" and "plate_id" in n.toString():
                read.append(n.metrics().apply("numFiles").value())
            if n is not node:
                walk(n)
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(found._jdf.queryExecution().executedPlan())
    assert read and max(read) == 1


def test_parts_are_worked_out_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 4, float(i)) for i in range(40)], "id long, tile int, x double")
    folder, seen = str(tmp_path / "parts"), []

    def work(df):
        seen.append(sorted({r.tile for r in df.select("tile").distinct().collect()}))
        return df.where("tile <> 3").groupBy(F.col("tile").cast("string").alias("part")).agg(F.sum("x").alias("s"))

    run = lambda r, p=None: parts.resume(r, "tile", work, folder, p)
    first, n = run(rows)
    assert n == 4 and {(r.part, r.s) for r in first.collect()} == {("0", 180.0), ("1", 190.0), ("2", 200.0)}
    again, n = run(rows)
    assert n == 0 and again.count() == 3 and seen == [[0, 1, 2, 3]]  # tile 3 gave nothing, and is done
    changed = rows.withColumn("x", F.when(F.col("id") == 5, 0.0).otherwise(F.col("x")))
    new, n = run(changed)
    assert n == 1 and seen[-1] == [1] and {(r.part, r.s) for r in new.collect()} == {("0", 180.0), ("1", 185.0), ("2", 200.0)}
    assert run(rows, {"radius": 5})[1] == 4 and run(rows, {"radius": 5})[1] == 0
    assert parts.table_print(rows) == parts.table_print(rows.orderBy(F.desc("id"))) != parts.table_print(changed)
