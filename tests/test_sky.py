import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyweave.functions import healpix, sky
from skyweave.operators import dedup, filters, skyjoin, stages, validate
from skyweave.operators.components import connected_components
from skyweave.plans import registry
from skyweave.sources import catalogue, columns, export

SF = "/root/testdata/sf0.001"


def test_pairs_wrap_and_poles(spark):
    rows = [(1, 359.9999, 0.0), (2, 0.0001, 0.0), (3, 10.0, 89.9999), (4, 190.0, 89.9999), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    got = {(r.id, r.r_id) for r in skyjoin.pairs(df, df, 1).collect()}
    assert got == {(i, i) for i in range(1, 5)} | {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_pairs_equal_brute_force(spark):
    random.seed(3)
    rows = [(i, random.uniform(10, 10.02), random.uniform(40, 40.02)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    sep = F.expr(sky.haversine("a.ra", "a.dec", "b.ra", "b.dec"))
    want = {(r[0], r[1]) for r in df.alias("a").crossJoin(df.alias("b")).where(sep <= 5).select("a.id", "b.id").collect()}
    assert {(r.id, r.r_id) for r in skyjoin.pairs(df, df, 5).select("id", "r_id").collect()} == want


def test_chain_merges_transitively(spark):
    rows = [("t:9", "t", 1.0, 0.0), ("t:10", "t", 1.0, 2 / 3600), ("u:1", "u", 1.0, 4 / 3600), ("u:2", "u", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "src_id string, tile_id string, ra double, dec double")
    got = {r.src_id: r.component for r in dedup.dedup(df, 3).collect()}
    assert got == {"t:9": "t:10", "t:10": "t:10", "u:1": "t:10", "u:2": "u:2"}


def test_components_of_long_chain_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0
    rng = random.Random(1)
    texts = spark.createDataFrame([(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(220)] + [(None, "x")], "src string, dst string")
    rounds = sorted(map(tuple, connected_components(texts).collect()))
    assert rounds == sorted(map(tuple, connected_components(texts, alone=1000).collect())) and len({c for _, c in rounds}) > 10
    assert connected_components(edges.limit(0), alone=10).count() == 0


def test_zero_mad_keeps_all(spark):
    df = spark.createDataFrame([(i, 1, 3.0 if i else 9.0) for i in range(9)] + [(9, 1, None)], "id long, g int, x double")
    assert filters.sigma_clip(df, ["x"], "g").count() == 9


def test_missing_evidence_is_kept_and_flags_are_unique(spark):
    df = spark.createDataFrame([(1, None), (2, 9.0)], "id long, x double")
    st = stages.test_stage(df, "id", {"x": "x > 5"})
    assert {(r.id, r.keep) for r in st.flags.collect()} == {(1, True), (2, False)}
    assert st.ledger.first().asDict() == {"input_rows": 2, "dropped_rows": 1, "kept_rows": 1}
    with pytest.raises(ValueError):
        stages.shrink(df, df.union(df), "id", "x", True)


def test_cone_cells_cover(spark):
    random.seed(1)
    for ra0, dec0 in [(1.662, 59.887), (345.332, 77.776), (10.0, 0.0), (200.0, -41.8), (0.1, 88.0)]:
        r = 45.4 / 60
        cells = set(healpix.cone_cells(ra0, dec0, r, 32))
        for _ in range(400):
            d, a = r * math.sqrt(random.random()), 2 * math.pi * random.random()
            s = math.sin(math.radians(dec0)) * math.cos(math.radians(d)) + math.cos(math.radians(dec0)) * math.sin(math.radians(d)) * math.cos(a)
            e = math.atan2(math.sin(a) * math.sin(math.radians(d)) * math.cos(math.radians(dec0)), math.cos(math.radians(d)) - math.sin(math.radians(dec0)) * s)
            assert healpix.nested_id_of(ra0 + math.degrees(e), math.degrees(math.asin(s)), 32) in cells
    pts = spark.createDataFrame([(random.uniform(0, 360), math.degrees(math.asin(random.uniform(-1, 1)))) for _ in range(500)], "ra double, dec double")
    for r in pts.select("ra", "dec", healpix.nested_id(F.col("ra"), F.col("dec"), 32).alias("c")).collect():
        assert r.c == healpix.nested_id_of(r.ra, r.dec, 32) and 0 <= r.c < 12288


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["sky_anti_5as", "robust_sigma_clip", "reject_reason_counts", "recall_by_radius", "primary_plate"])
def test_oracle_row_counts(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "customer", "supplier", "orders", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() == len(want.fetchall())


NEW = ["plate_pairs_10as", "resolved_positions", "dedup_representatives", "peak_significance"]


@pytest.mark.parametrize("name", NEW)
def test_oracle_rows(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "customer", "supplier", "orders", "nation", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.select(names).collect())
    assert rows == sorted(want) and rows


def test_resolver_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "2.5", 3.0, [1.0])], "NUMBER int, RA string, DEC double, flux array<double>")
    got = columns.placed(df)
    assert got.first().asDict() == {"ra": 2.5, "dec": 3.0, "NUMBER": 1, "flux": [1.0]} and columns.id_column(df) == "NUMBER"
    with pytest.raises(ValueError):
        columns.placed(df.select("NUMBER", "RA"))
    paths = export.export(df, f"file://{tmp_path}", "both")
    assert spark.read.option("header", True).csv(paths[0]).columns == ["NUMBER", "RA", "DEC"]
    assert spark.read.parquet(paths[1]).count() == 1 and export.export(df, f"file://{tmp_path}", "none") == []


def test_peak_significance_of_odd_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, None, 9.0]), (2, []), (3, None), (4, [5.0, 5.0])], "k int, v array<double>")
    got = {r.k: r.peak_sigma for r in validate.peak_significance(df, "v").collect()}
    assert got[1] == pytest.approx((9 - 2.5) / 1.4826) and got[2] is got[3] is got[4] is None


def test_wide_cells_equal_brute_force(spark):
    """Points about many cell faces, at the pole and across RA 0; each pair once."""
    random.seed(8)
    rows = [(i, random.choice([0.0, 359.999, 45.0]) + random.uniform(0, 0.004), random.choice([0.0, 35.26, 89.999, -90.0]) + random.uniform(0, 0.001)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    got = [(r.id, r.r_id) for r in skyjoin.pairs(df, df, 2).select("id", "r_id").collect()]
    sep = F.expr(sky.haversine("a.ra", "a.dec", "b.ra", "b.dec"))
    want = {(r[0], r[1]) for r in df.alias("a").crossJoin(df.alias("b")).where(sep <= 2).select("a.id", "b.id").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_catalogue_ingest_cone_and_state(spark, tmp_path):
    rows = [(i, 10 + i / 100, 2.0, -999.0 if i % 3 else 15.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double, m double")
    for _ in range(2):  # a rerun gives the same table
        catalogue.ingest(df, f"{tmp_path}/c", {"id": "id AS long", "ra": "ra AS double", "dec": "dec AS double", "mag": "m AS float"})
    c = catalogue.opened(spark, f"{tmp_path}/c")
    assert c.count() == 300
    got = catalogue.cone(c, 11.0, 2.0, 6.05, ["id", "ra", "dec", "mag"], "id >= 0", ("mag",), ("plx",)).collect()
    assert {r.id for r in got} == set(range(90, 111)) and all(r.plx is None and (r.mag is None) == (r.id % 3 > 0) for r in got)
    state = spark.createDataFrame([(1, "ok"), (2, "failed")], "t long, status string")
    assert sorted(r.t for r in catalogue.undone(spark.createDataFrame([(1,), (2,), (3,)], "t long"), state, "t").collect()) == [2, 3]


def test_scalar_cases(spark):
    one = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    days = "datediff({}, DATE '1970-01-01')"
    assert one(sky.overflow_mjd("'1952-01-02T23:77:61'", days)) == pytest.approx(34013 + (18 * 60 + 1) / 86400)
    assert one(sky.overflow_mjd("'1952-01-02 x'", days)) is None
    assert one(sky.tile_centre("'tile_RA370.000_DECm05.500'")[0]) == 10.0 and one(sky.tile_centre("'tile_RA370.000_DECm05.500'")[1]) == -5.5
    assert one(sky.tile_centre("'tile'")[1]) is None and one(sky.tile_name("-10e0", "-5.25e0")) == "tile_RA350.000_DECm5.250"
    assert one(sky.space_motion("0e0", "90e0", "0", "3.6e6", "1")[1]) == pytest.approx(89.0, abs=2e-3)
    assert one(sky.number_text("double('NaN')")) == "" and one(sky.number_text("1.5e0", 2)) == "1.50"
