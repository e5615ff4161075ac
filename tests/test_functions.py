"""Scalar functions against plain Python, vectors and literal values, not against their own text."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(17)
    rows = []
    for k in range(300):
        ra, dec = rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        r = rng.choice([1e-5, 1e-3, 0.1, 5.0, 60.0])
        rows.append((k, ra, dec, (ra + rng.uniform(-r, r) / max(0.02, math.cos(math.radians(dec)))) % 360, max(-90.0, min(90.0, dec + rng.uniform(-r, r))), rng.choice([None, rng.uniform(-900, 900)]), rng.choice([None, rng.uniform(-900, 900)])))
    return rows, spark.createDataFrame(rows, "k long, a double, d double, b double, e double, u double, v double")


def vec(ra, dec):
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def cross(p, q):
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def dot(p, q):
    return sum(x * y for x, y in zip(p, q))


def angle(p, q):
    return math.degrees(math.atan2(math.hypot(*cross(p, q)), dot(p, q)))


def values(df, *columns):
    return [tuple(r)[1:] for r in df.selectExpr("k", *columns).orderBy("k").collect()]


def turn(x):
    """The smallest angle of the same direction."""
    return (x + 180) % 360 - 180


def test_separations(sample):
    rows, df = sample
    got = values(df, sky.haversine("a", "d", "b", "e"), sky.cosine_separation("a", "d", "b", "e"), sky.chord_to_arcsec(f"sqrt({'+'.join(f'pow({x}-{y},2)' for x, y in zip(sky.unit_xyz('a', 'd'), sky.unit_xyz('b', 'e')))})"))
    for r, (h, c, x) in zip(rows, got):
        want = angle(vec(r[1], r[2]), vec(r[3], r[4]))
        assert h == pytest.approx(want * 3600, rel=1e-9, abs=1e-6) and c == pytest.approx(want, abs=2e-6) and x == pytest.approx(want * 3600, rel=1e-7, abs=1e-6)
    assert sky.chord(3600.0) == pytest.approx(2 * math.sin(math.radians(0.5)))


def test_separation_of_nulls(spark):
    row = spark.range(1).selectExpr(sky.haversine("NULL", "1e0", "2e0", "3e0"), sky.cosine_separation("1e0", "CAST(NULL AS double)", "2e0", "3e0")).first()
    assert row[0] is None and row[1] is None


def test_wraps(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 359.5), (2, 180.0), (3, -0.5), (4, 721.0), (5, -540.0)], "k long, x double")
    assert values(df, sky.wrap360("x"), sky.wrap180("x")) == [(0.0, 0.0), (359.5, -0.5), (180.0, -180.0), (359.5, -0.5), (1.0, 1.0), (180.0, -180.0)]


def test_plane_coordinates(sample):
    rows, df = sample
    x, y = sky.gnomonic("b", "e", "a", "d")
    s, t = sky.tangent_offsets("b", "e", "a", "d")
    for r, (gx, gy, ox, oy, cheb) in zip(rows, values(df, x, y, s, t, sky.chebyshev("b", "e", "a", "d"))):
        c, p = vec(r[1], r[2]), vec(r[3], r[4])
        east = (-math.sin(math.radians(r[1])), math.cos(math.radians(r[1])), 0.0)
        north = cross(c, east)
        if dot(c, p) > 0.1:  # the ray through p meets the plane that touches the sphere in c
            assert gx == pytest.approx(dot(p, east) / dot(p, c), rel=1e-7, abs=1e-9) and gy == pytest.approx(dot(p, north) / dot(p, c), rel=1e-7, abs=1e-9)
        assert ox == pytest.approx(turn(r[3] - r[1]) * math.cos(math.radians(r[2])) * 3600, abs=1e-6) and oy == pytest.approx((r[4] - r[2]) * 3600, abs=1e-6)
        assert cheb == pytest.approx(max(abs(ox), abs(oy)) / 3600, abs=1e-9)


def test_destination_goes_as_far_as_told(sample):
    rows, df = sample
    for r, (ra, dec) in zip(rows, values(df, *sky.destination("a", "d", "(2.5e0 + k % 7)", "(k * 37e0)"))):
        c, p = vec(r[1], r[2]), vec(ra, dec)
        assert angle(c, p) == pytest.approx(2.5 + r[0] % 7, abs=1e-8)
        east = (-math.sin(math.radians(r[1])), math.cos(math.radians(r[1])), 0.0)
        assert turn(math.degrees(math.atan2(dot(p, east), dot(p, cross(c, east)))) - r[0] * 37.0) == pytest.approx(0, abs=1e-6)


def test_motions(sample):
    rows, df = sample
    got = values(df, *sky.propagate("a", "d", "u", "v", "-66"), *sky.propagate_stage("a", "d", "u", "v", "-50"), *sky.space_motion("a", "d", "u", "v", "-66"), sky.total_motion("u", "v"))
    for (_, a, d, _, _, u, v), (pa, pd, sa, sd, ra, rd, pm) in zip(rows, got):
        if u is None or v is None:
            assert (pa, pd) == (a, d) and pm is None
        else:
            assert pm == pytest.approx(math.hypot(u, v))
            assert pa == pytest.approx(a - u * 66 / 3.6e6 / math.cos(math.radians(d)), abs=1e-9) and pd == pytest.approx(d - v * 66 / 3.6e6, abs=1e-12)
        u, v = u or 0.0, v or 0.0
        moved = max(-90.0, min(90.0, d - v * 50 / 3.6e6))
        assert sd == pytest.approx(moved, abs=1e-12) and sa == pytest.approx(a - u * 50 / 3.6e6 / max(1e-6, math.cos(math.radians(moved))), abs=1e-8)
        c = vec(a, d)
        east = (-math.sin(math.radians(a)), math.cos(math.radians(a)), 0.0)
        north, s = cross(c, east), -66 * math.radians(1 / 3.6e6)
        p = [x + s * (u * y + v * z) for x, y, z in zip(c, east, north)]
        assert angle(vec(ra, rd), p) == pytest.approx(0, abs=1e-9)


def test_flat_separation(spark):
    got = values(spark.createDataFrame([(0, 10.0, 20.0)], "k long, a double, d double"), sky.flat_separation("a", "d", "10.5e0", "20.5e0", "22e0"))
    assert got[0][0] == pytest.approx(math.hypot(0.5 * math.cos(math.radians(21)), 0.5) * 3600)


def test_shares_and_edges(spark):
    # 95 % interval of 8 of 10: 49.02 to 94.33 percent, as printed in statistics texts
    row = spark.range(1).selectExpr(*sky.wilson("8", "10"), sky.percent_change("30", "40"), sky.percent_change("1", "0"), sky.percent_change("0", "50"), sky.ratio("6e0", "4e0"), sky.ratio("6e0", "0e0"), sky.margin("1e0", "4e0"), sky.edge_distance("2e0", "3e0", "10e0", "4e0"), sky.edge_distance("-2e0", "3e0", "10e0", "4e0")).first()
    assert row[0] == pytest.approx(49.02, abs=0.01) and row[1] == pytest.approx(94.33, abs=0.01)
    assert tuple(row)[2:] == (-25.0, None, -99.9, 1.5, None, 0.75, 1.0, -2.0)
    df = spark.createDataFrame([(0, -0.1), (1, 0.0), (2, 0.01), (3, 0.3), (4, 0.6)], "k long, x double")
    assert [v[0] for v in values(df, sky.edge_class("x", "0.01e0", "0.5e0"))] == ["off_plate", "edge_touch", "edge_touch", "near_edge", "core"]
    assert [spark.range(1).selectExpr(f"{t} AS t").first()["t"] for t in sky.polynomial("2e0", "3e0", 2)] == [1, 2, 3, 4, 6, 9]


def test_texts(spark):
    t = [(0, "-00:30:36"), (1, "12 30 00"), (2, "-1:00:01.8"), (3, " 5:6:7 ")]
    got = values(spark.createDataFrame(t, "k long, t string"), sky.sexagesimal("t"))
    assert [g[0] for g in got] == pytest.approx([-0.51, 12.5, -1.0005, 5.101944444])
    t = [(0, "tile_RA123.456_DECm12.500"), (1, "tile_RA361_DECp95"), (2, "plate_7"), (3, " tile_RA0.000_DECp0.250 "), (4, None)]
    assert values(spark.createDataFrame(t, "k long, t string"), *sky.tile_centre("t")) == [(pytest.approx(123.456), -12.5), (1.0, 90.0), (None, None), (0.0, 0.25), (None, None)]
    names = spark.createDataFrame([(0, 359.9999, -0.5), (1, -1.0, 0.0), (2, 12.3456, 7.0)], "k long, a double, d double")
    assert [v[0] for v in values(names, sky.tile_name("a", "d"))] == ["tile_RA360.000_DECm0.500", "tile_RA359.000_DECp0.000", "tile_RA12.346_DECp7.000"]
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, 1 / 3)], "k long, x double")
    assert [v[0] for v in values(df, sky.number_text("x", 4))] == ["", "", "0.3333"]


def test_times(spark):
    t = ["1952-01-02T03:04:05", "1952-01-02T11:77:00", "1952-01-02 23:59:75", "1952-01-02T25:00:00", "1952-01-02T03:04:05.5Z", "1952-13-02", None]
    df = spark.createDataFrame(list(enumerate(t)), "k long, t string")
    day = (datetime.date(1952, 1, 2) - datetime.date(1858, 11, 17)).days
    seconds = [11045, 44220, 15, 3600, 11045.5]  # 77 minutes are carried, hours wrap around within the day
    got = [v[0] for v in values(df, sky.overflow_mjd("t", "datediff({}, DATE '1970-01-01')"))]
    assert got[:5] == pytest.approx([day + s / 86400 for s in seconds], abs=1e-9) and got[5:] == [None, None]
    at = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 7, 2), datetime.datetime(2023, 7, 2, 12), datetime.datetime(1952, 12, 31, 23, 59, 59, 999999)]
    years = [v[0] for v in values(spark.createDataFrame(list(enumerate(at)), "k long, t timestamp"), sky.decimal_year("t"))]
    assert years == pytest.approx([2024.0, 2024.5, 2023.5, 1953.0], abs=1e-6)


def test_magnitudes(spark):
    df = spark.createDataFrame([(0, None), (1, -999.0), (2, -0.5), (3, 0.0), (4, 50.0), (5, 50.5), (6, 12.0)], "k long, m double")
    assert [v[0] for v in values(df, sky.valid_magnitude("m"))] == [False, False, False, True, True, False, True]
    assert df.select(F.expr(sky.valid_magnitude("m"))).where("false").count() == 0
