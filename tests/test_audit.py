import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import audit, validate
from skyweave.sources import catalogue

SEC = 1 / 3600


def places(spark, rows, more=""):
    return spark.createDataFrame(rows, "id long, ra double, dec double" + more)


def test_contamination_is_strict_capped_and_spares_small_tiles(spark):
    rows = [(k, 10 + k * 0.1, 0.0, "big") for k in range(60)] + [(100 + k, 50 + k * 0.1, 0.0, "small") for k in range(3)] + [(200 + k, 80 + k * 0.1, 0.0, "clean") for k in range(20)]
    stars = places(spark, [(1, 80.0, 5 * SEC)] + [(k, 10 + k * 0.1, 1 * SEC) for k in range(60)] + [(300, 50.0, 0.0)])
    got = {r.tile_id: r for r in audit.contamination(places(spark, rows, ", tile_id string"), stars, "id", "tile_id", cap=10).collect()}
    assert (got["big"].n_rows, got["big"].checked, got["big"].matched, got["big"].passes) == (60, 10, 10, False)
    assert got["small"].exempt and got["small"].passes and got["small"].fraction == pytest.approx(1 / 3)
    assert got["clean"].matched == 0  # exactly 5 arcsec is not nearer than 5
    gate = audit.contamination_gate(audit.contamination(places(spark, rows, ", tile_id string"), stars, "id", "tile_id", cap=10), 0.5).first()
    assert (gate.checked, gate.matched, gate.bad_tiles, gate.exempt_tiles, gate.passes) == (23, 11, 1, 1, False)


def test_first_run_wins(spark):
    run = lambda rows: spark.createDataFrame(rows, "src_id string, x int")
    got = audit.survivors_once({"b": run([("s1", 1), ("s2", 2)]), "a": run([("s2", 9), ("s3", 3)])}, "src_id")
    assert {(r.src_id, r.run_id, r.x) for r in got.collect()} == {("s1", "b", 1), ("s2", "b", 2), ("s3", "a", 3)}
    table = audit.run_funnel({"raw": {"b": run([("s", 1)] * 3), "a": run([])}, "cut": {"b": run([("s", 1)])}}).collect()
    assert [(r.stage, r.b, r.a) for r in table] == [("raw", 3, 0), ("cut", 1, None)]


def test_field_grid_takes_the_smallest_of_frequent_epochs(spark):
    rows = spark.createDataFrame([(10.2, 1.0, "p", 3.0), (10.21, 1.0, "p", 2.0), (10.22, 1.02, "p", None), (10.2, 1.0, None, 5.0), (300.0, 89.9, "p", 1.0)], "ra double, dec double, plate string, epoch double")
    got = {(r.plate, r.n): (r.ra_f, r.dec_f, r.epoch) for r in audit.field_grid(rows, "plate", "epoch", 60).collect()}
    assert got == {("p", 3): (10.21, 1.0, 2.0), (None, 1): (10.2, 1.0, 5.0), ("p", 1): (300.0, 89.9, 1.0)}


def test_changes_and_joins(spark):
    t = lambda ks: spark.createDataFrame([(k,) for k in ks], "id long")
    assert {(r.id, r.change) for r in audit.set_changes(t([1, 2, 3]), t([2, 3, 4]), "id").collect()} == {(1, "lost"), (4, "added")}
    dim = spark.createDataFrame([(1, "a")], "id long, plate string")
    assert {(r.id, r.plate) for r in audit.joined_once(t([1, 2]), dim, "id").collect()} == {(1, "a"), (2, None)}
    with pytest.raises(ValueError):
        audit.joined_once(t([1]), dim.union(dim), "id")
    assert audit.merged_headers([t([1]), dim]).columns == ["id", "plate"]


def test_neighbour_plate_and_its_null_arm(spark):
    plates = places(spark, [(1, 10.0, 0.0), (2, 16.0, 0.0), (3, 22.0, 0.0)])
    rows = places(spark, [(1, 12.0, 0.0, 1), (2, 12.0, 1.0, 2), (3, 20.0, 0.0, 3)], ", own long")
    shift = 3 / 60 / math.cos(math.radians(1.0))
    det = spark.createDataFrame([(2, 12.0, 2 * SEC), (1, 12.0 + shift, 1.0)], "plate_id long, ra double, dec double")
    got = {r.id: (r.neighbour, r.searched, r.detected, r.null_detected) for r in audit.neighbour_detections(rows, "id", "own", plates, det).collect()}
    assert got == {1: (2, True, True, False), 2: (1, True, False, True), 3: (2, True, False, False)}


def test_nearest_plates_equal_brute_force(spark):
    rng = random.Random(6)
    point = lambda: (rng.uniform(0, 360), rng.choice([math.degrees(math.asin(rng.uniform(-1, 1))), 90.0, -90.0, rng.uniform(85, 90)]))
    for n, k in ((1, 2), (3, 2), (120, 3)):
        plates, rows = [(i, *point()) for i in range(n)], [(i, *point()) for i in range(250)]

        def unit(ra, dec):
            a, d = math.radians(ra), math.radians(dec)
            return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)

        got = {r.id: r.near for r in validate.nearest_plates(places(spark, [*rows, (999, None, 1.0)]), places(spark, plates), k).collect()}
        assert len(got) == 251
        for i, ra, dec in rows:
            want = sorted(2 * math.degrees(math.asin(min(1, math.dist(unit(ra, dec), unit(a, d)) / 2))) for _, a, d in plates)[:k]
            assert [x.sep for x in got[i]] == pytest.approx(want, abs=1e-5)


def test_boxes_of_plates_equal_brute_force(spark):
    rng = random.Random(4)
    plates = [(i, rng.uniform(0, 360), rng.uniform(-80, 80)) for i in range(30)] + [(50, 359.5, 0.0), (51, 0.5, 0.0), (52, 10.0, 89.0)]
    rows = [(i, rng.uniform(0, 360), rng.uniform(-90, 90)) for i in range(600)] + [(900 + i, rng.choice([0.1, 359.9]), rng.uniform(-4, 4)) for i in range(40)]
    half = 3.3
    want = {(i, p) for i, ra, dec in rows for p, a, d in plates if max(abs(((ra - a + 180) % 360 - 180) * math.cos(math.radians(d))), abs(dec - d)) <= half}
    got = {(r.id, r.plate_id) for r in validate.boxed(places(spark, rows), places(spark, plates), half).collect()}
    assert got == want and len(want) > 20


def test_strata_of_motions(spark):
    kind = "id long, ra double, dec double, pmra double, pmdec double"
    away = lambda dec, pm: dec - pm * 50 / 3.6e6
    claims = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 200.0, 14.0), (2, 20.0, 0.0, 0.0, 200.0, None), (3, 30.0, 0.0, 0.0, 200.0, 14.0), (4, 40.0, 0.0, 3.0, None, float("nan"))], kind + ", r1mag double")
    truth = spark.createDataFrame([(1, 10.0, away(0.0, 200.0), 10.0, 180.0), (2, 20.0, 0.0, 1.0, 2.0), (3, 40.0, 0.0, 1.0, 1.0)], kind)
    table, density = audit.motion_strata(claims, truth, 2.0)
    got = {r.stratum: (r.n, r.genuine, r.fabricated, r.indeterminate) for r in table.collect()}
    assert got == {"high": (3, 1, 1, 1), "high_red": (2, 1, 0, 1), "control": (1, 0, 1, 0)}
    assert tuple(density.first()) == (3, 1, 1.5, 0.5, 3.0)


def test_bias_excess(spark):
    bias = spark.createDataFrame([("gaia", 2.0), ("ps1", 0.5), ("usnob", 0.3)], "catalogue string, delta double")
    r = audit.bias_excess(bias, "gaia").first()
    assert (r.fitted_delta, round(r.control_delta, 9), round(r.excess, 9)) == (2.0, 0.4, 1.6)


def test_cone_layouts(spark, tmp_path):
    nan = float("nan")
    rows = [(1, 10.0, 0.0, 15.0, nan, 3.0, 2, -999.0, nan, 12.0), (2, 10.01, 0.0, nan, 5.0, nan, 3, 15.0, 11.0, nan), (3, 50.0, 0.0, 1.0, 1.0, 1.0, 9, 9.0, 9.0, 9.0), (4, 10.0, 0.01, 12.0, 1.5, 2.5, 1, 10.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double, phot_g_mean_mag double, pmra double, pmdec double, nDetections int, rmag double, R1mag double, R2mag double")
    df = df.withColumns({c: F.lit(1.0) for c in ("B1mag", "B2mag", "Imag")})
    at = str(tmp_path / "c")
    catalogue.ingest(df, at, {c: f"{c} AS {t}" for c, t in df.dtypes}, nside=4)
    c = catalogue.opened(spark, at)
    gaia = catalogue.gaia_cone(c, 10.0, 0.0, 2.0, 4)
    assert gaia.columns == ["ra", "dec", "Gmag", "BPmag", "RPmag", "pmRA", "pmDE", "Plx", "_r"]
    found = gaia.collect()
    assert found[0].Gmag == 15.0 and found[0]._r < 1e-6  # nearest first; the two others are equally far
    assert {(r.Gmag, r.pmRA, r.pmDE, r.Plx) for r in found} == {(15.0, None, 3.0, None), (None, 5.0, None, None), (12.0, 1.5, 2.5, None)}
    assert [r.rmag for r in catalogue.bright_cone(c, 10.0, 0.0, 2.0, nside=4).collect()] == [15.0]
