import csv
import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import fit, funnel, segment, skyjoin
from skyweave.sources import chunks, ecsv, export, upsert


def greedy(sizes, most, rows):
    out, batch, n, total = [], 0, 0, 0
    for k, s in enumerate(sizes):
        if k and (n + 1 > most or total + s > rows):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.append(batch)
    return out


@pytest.mark.parametrize(("count", "most", "rows", "block"), [(1, 3, 10, 8), (700, 7, 100, 16), (12_288, 100, 5000, 1024), (257, 1, 10, 256)])
def test_batches_equal_greedy(spark, count, most, rows, block):
    rng = random.Random(count + most)
    sizes = [rng.choice([0, 0, rng.randint(1, 30), rng.randint(1, 150)]) for _ in range(count)]
    df = spark.createDataFrame([(f"{k:06d}", s if s or k % 2 else None) for k, s in enumerate(sizes)], "key string, n long").repartition(3)
    got = [r.batch for r in segment.batches(df, "key", "n", most, rows, block).orderBy("key").collect()]
    assert got == greedy(sizes, most, rows)


def test_batches_of_no_groups(spark):
    assert segment.batches(spark.createDataFrame([], "key string, n long"), "key", "n", 3, 10).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(k, (k * 7) % 5) for k in range(500)], "k long, v long").repartition(5)
    got = segment.running(df, ["k"], {"s": F.col("v"), "n": F.lit(1)}).orderBy("k").collect()
    assert [r.s for r in got] == np.cumsum([(k * 7) % 5 for k in range(500)]).tolist() and [r.n for r in got] == list(range(1, 501))


# --- fits -------------------------------------------------------------------------------------------------------
def reference_fit(x, y, ox, oy, rules):
    """The same rules on arrays of one group, by lstsq."""
    a = np.stack([np.ones_like(x), x, y] + ([x * x, x * y, y * y] if rules.degree > 1 else []), 1)
    mask = np.isfinite(ox) & np.isfinite(oy) & np.isfinite(a).all(1)
    a, ox, oy = a[mask], ox[mask], oy[mask]
    if len(ox) < rules.least:
        return "too_few", None, None, None
    inside = np.ones(len(ox), bool)
    for _ in range(rules.rounds):
        c = [np.linalg.lstsq(a[inside], o[inside], rcond=None)[0] for o in (ox, oy)]
        r = np.hypot(ox - a @ c[0], oy - a @ c[1]) * 3600
        mad = np.median(np.abs(r - np.median(r)))
        sigma = 1.4826 * mad if mad > 0 else (np.std(r) if len(r) > 10 else 0.0)
        limit = min(rules.clip_max, max(rules.clip_min, rules.clip_sigma * sigma) if sigma > 0 else rules.clip_max)
        new = inside & (r <= limit)
        stable, inside = new.sum() == inside.sum(), new
        if stable:
            break
        if inside.sum() < rules.least:
            return "too_few_after_clipping", None, None, None
    c = [np.linalg.lstsq(a[inside], o[inside], rcond=None)[0] for o in (ox, oy)]
    return "ok", c[0], c[1], int(inside.sum())


@pytest.mark.parametrize("degree", [1, 2])
def test_fit_equals_lstsq(spark, degree):
    rng = np.random.default_rng(degree)
    rules, rows, want = fit.Rules(degree=degree), [], {}
    for g in range(9):
        n = [200, 25, 19, 60, 40, 22, 300, 21, 30][g]
        x, y = rng.uniform(-0.6, 0.6, n), rng.uniform(-0.5, 0.5, n)
        ox = (2 + 3 * x - y + degree * x * y + rng.normal(0, 0.4, n)) / 3600
        oy = (-1 + x + 2 * y - y * y + rng.normal(0, 0.4, n)) / 3600
        if g in (0, 3, 6):
            ox[:: 7] += rng.uniform(3, 40, len(ox[::7])) / 3600
        if g == 5:
            ox[: 10] += 90 / 3600
        if g == 7:
            oy[3] = np.nan
        want[g] = reference_fit(x, y, ox, oy, rules)
        rows += [(g, *map(float, v)) for v in zip(x, y, ox, oy)]
    rows += [(99, 0.1, 0.1, 0.1, None), (50, 0.1, 0.1, None, 0.1)] + [(60, 0.5, 0.5, 1e-4, 1e-4)] * 30
    got = {r.g: r for r in fit.robust_fit(spark.createDataFrame(rows, "g int, x double, y double, ox double, oy double"), ["g"], rules).collect()}
    assert set(got) == {*want, 99, 50, 60}
    assert got[99].status == got[50].status == "too_few" and got[60].status == "singular" and got[60].cx is None
    for g, (status, cx, cy, kept) in want.items():
        assert got[g].status == status
        if status == "ok":
            assert got[g].kept == kept
            np.testing.assert_allclose(got[g].cx, cx, atol=1e-9)
            np.testing.assert_allclose(got[g].cy, cy, atol=1e-9)
    assert {s for s, *_ in want.values()} >= {"ok", "too_few"}


def test_ladder_of_fits(spark):
    rng = np.random.default_rng(3)

    def ties(g, n):
        return [(g, *map(float, (a, b, (1 + a) / 3600, (2 - b) / 3600))) for a, b in rng.uniform(-1, 1, (n, 2))]

    kind = "g int, x double, y double, ox double, oy double"
    primary = spark.createDataFrame(ties(1, 40) + ties(2, 12) + ties(3, 4) + ties(5, 3), kind)
    wide = spark.createDataFrame(ties(1, 60) + ties(2, 15) + ties(3, 6) + ties(4, 11), kind)
    got = {r.g: (r.status, r.used, r.cx and len(r.cx)) for r in fit.ladder(primary, wide, ["g"]).collect()}
    assert got == {1: ("ok", "primary", 6), 2: ("ok", "fallback", 3), 3: ("too_few", "none", None), 4: ("ok", "fallback", 3), 5: ("too_few", "none", None)}


# --- nested stages ----------------------------------------------------------------------------------------------
def test_membership_and_ladder(spark):
    t = lambda ks: spark.createDataFrame([(k,) for k in ks], "k int")
    tables = {"raw": t([1, 2, 3, 4, None]), "veto": t([2, 3, 4, 4]), "bad": t([3]), "kept": t([4])}
    bits = funnel.membership(tables, ["k"])
    assert {r.k: r.bits for r in bits.collect()} == {1: 1, 2: 3, 3: 7, 4: 11}
    told = bits.select("k", *funnel.outcome(tables, [("VETOED", "veto", False), ("BAD", "bad", True), ("LOST", "kept", False)], "SURVIVED"))
    assert {r.k: (r.stage, r.rank) for r in told.collect()} == {1: ("VETOED", 1), 2: ("LOST", 3), 3: ("BAD", 2), 4: ("SURVIVED", 4)}


def test_best_outcome_over_tiles(spark):
    sec = 1 / 3600
    ref = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 30.0, 0.0), (4, 40.0, 0.0), (5, 50.0, 0.0)], "id long, ra double, dec double")
    det = spark.createDataFrame([(1, "a", 10.0, sec), (2, "a", 10.0, 2 * sec), (3, "b", 10.0, 3 * sec), (1, "b", 20.0, sec), (9, "a", 30.0, sec), (7, "z", 50.0, 0.0)], "id long, tile_id string, ra double, dec double")
    told = spark.createDataFrame([("a", 1, "VETOED", 1), ("a", 2, "SURVIVED", 3), ("b", 3, "BAD", 2), ("b", 1, "SURVIVED", 3), ("a", 9, "SURVIVED", 3), ("z", 7, "SURVIVED", 3)], "tile_id string, id long, stage string, rank int")
    final = spark.createDataFrame([("b", 20.0, 2 * sec), ("z", 30.0, 0.0), ("z", 50.0, 0.0)], "tile_id string, ra double, dec double")
    centres = spark.createDataFrame([("a", 10.0, 0.0), ("a2", 40.0, 0.1), ("b", 10.2, 0.1), ("b", 20.0, 0.0), ("a", 30.0, 0.0)], "tile_id string, ra double, dec double")
    got = {r.id: (r.stage, r.tile_id, r.det) for r in funnel.best_outcome(ref, det, told, 5, final, centres=centres).collect()}
    # the nearest detection of a tile speaks for it (1), the best tile counts (b over a), what final lacks was dropped (3)
    assert got == {1: ("BAD", "b", 3), 2: ("SURVIVED", "b", 1), 3: ("DEDUP_DROPPED", "a", 9), 4: ("NEVER_DETECTED", None, None)}
    shares = {r.stage: (r.n, r.of_all, r.of_detected) for r in funnel.shares(funnel.best_outcome(ref, det, told, 5)).collect()}
    assert shares["NEVER_DETECTED"] == (1, 20.0, None) and shares["SURVIVED"][:2] == (3, 60.0) and sum(s[0] for s in shares.values()) == 5


# --- one-to-one matches -----------------------------------------------------------------------------------------
def test_long_chain_of_pairs_is_settled_in_few_rounds(spark, monkeypatch):
    n = 3000  # left and right in turn, each gap a little smaller than the one before
    at, left, right = 10.0, [], []
    for k in range(2 * n):
        (left if k % 2 == 0 else right).append((k // 2, at, 0.0))
        at += (4 - k * 3e-4) / 3600
    kind = "id long, ra double, dec double"
    tables = []
    from skyweave.sources import shared

    count = shared.written
    monkeypatch.setattr(shared, "written", lambda df: tables.append(1) or count(df))
    got = skyjoin.best_symmetric(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), 5, "id", "id")
    pairs = {(r.id, r.r_id) for r in got.collect()}
    want, used = set(), set()
    sep = sorted([(abs(a[1] - b[1]), a[0], b[0]) for a in left for b in right[max(0, a[0] - 2) : a[0] + 2] if abs(a[1] - b[1]) * 3600 <= 5])
    for _, a, b in sep:
        if not {("l", a), ("r", b)} & used:
            used |= {("l", a), ("r", b)}
            want.add((a, b))
    assert pairs == want and len(tables) < 40  # rounds of nearest pairs would be thousands


def test_large_components_go_by_rounds(spark):
    rng = random.Random(2)
    a = [(k, 10 + rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for k in range(40)]
    b = [(k, 10 + rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for k in range(40)]
    one, two = (spark.createDataFrame(x, "id long, ra double, dec double") for x in (a, b))
    rows = lambda alone: sorted(map(tuple, skyjoin.best_symmetric(one, two, 8, "id", "id", alone).collect()))
    assert rows(0) == rows(10**6) and len(rows(0)) > 20


# --- sources ----------------------------------------------------------------------------------------------------
def test_upsert_touches_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    kind = "k long, v string, ts long"
    first = spark.createDataFrame([(k, f"a{k}", 1) for k in range(60)] + [(3, "newer", 5), (None, "x", 1)], kind)
    assert len(upsert.merge(first, folder, ["k"], ["ts"], 8)) == 8
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/bucket=*/*.parquet")}
    before = files()
    touched = upsert.merge(spark.createDataFrame([(7, "b7", 0), (1000, "b", 0), (7, "older", -1)], kind), folder, ["k"], ["ts"], 8)
    rows = {r.k: r.v for r in upsert.current(spark, folder, first).collect()}
    assert rows == {k: f"a{k}" for k in range(60)} | {3: "newer", 7: "b7", 1000: "b"}
    same = {f for f in before if before[f] == files().get(f)}
    assert len(touched) <= 2 and {f for f in before if not any(f"bucket={b}/" in f for b in touched)} == same
    assert upsert.merge(first.limit(0), folder, ["k"], ["ts"], 8) == []


def test_chunks_have_exactly_so_many_rows(spark, tmp_path):
    df = spark.createDataFrame([((k * 37) % 1000, f"s{k}") for k in range(1000)], "k long, s string").repartition(7)
    chunks.write_chunks(df, ["k"], 64, str(tmp_path / "c"))
    files = sorted(glob.glob(f"{tmp_path}/c/chunk=*/*.csv"))
    rows = [list(csv.reader(open(f)))[1:] for f in files]
    assert [len(r) for r in rows] == [64] * 15 + [40]
    assert [int(x[0]) for r in rows for x in r] == list(range(1000)) and "chunk=0000001" in files[0]


def test_plate_folders_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, k / 2) for k in range(300)], "id long, plate_id int, ra double").repartition(5)
    chunks.write_plates(df, "plate_id", ["id"], str(tmp_path / "p"), ["id", "ra"])
    for p in range(3):
        ids = [int(r[0]) for f in sorted(glob.glob(f"{tmp_path}/p/plate_id={p}/*.csv")) for r in list(csv.reader(open(f)))[1:]]
        assert ids == list(range(p, 300, 3))


def test_text_tables_round_trip_in_splits(spark, tmp_path):
    spark.dataSource.register(ecsv.EcsvSource)
    kind = "id long, small short, x double, f float, name string, ok boolean"
    rows = [(k, k % 100, k / 7, 0.5, f'a "quoted" {k}', k % 2 == 0) for k in range(400)] + [(400, None, None, None, None, None), (401, 1, float("inf"), 1.5, "#plain", True), (402, 1, 1e-300, 1.5, "é", False)]
    df = spark.createDataFrame(rows, kind)
    folder = str(tmp_path / "t")
    df.write.format("ecsv").mode("overwrite").save(folder)
    df.coalesce(2).write.format("ecsv").mode("overwrite").save(folder)
    back = spark.read.format("ecsv").option("split", 700).load(folder)
    assert back.schema.simpleString() == df.schema.simpleString() and back.rdd.getNumPartitions() > 10
    key = lambda r: r[0]
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
    assert len(glob.glob(f"{folder}/*.ecsv")) == 2 and len(os.listdir(folder)) == 2
    plain = ecsv.read_ecsv(spark, f"{folder}/*.ecsv")
    assert sorted(map(tuple, plain.select("id", "x", "ok").where("id < 300").collect())) == sorted((r[0], r[2], r[5]) for r in rows[:300])
    assert sorted(map(tuple, back.select("name", "id").where("id > 400").collect())) == [("#plain", 401), ("é", 402)]


def test_header_of_text_tables(spark, tmp_path):
    lines = ["# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:", "# - {name: ra, unit: deg, datatype: float64, description: 'a, b'}", "# - {name: 'n x', datatype: uint8}", "# schema: any"]
    schema, delimiter = ecsv.parse_header(lines)
    assert delimiter == "," and [(f.name, f.dataType.simpleString()) for f in schema.fields] == [("ra", "double"), ("n x", "smallint")] and schema["ra"].metadata == {"unit": "deg"}
    (tmp_path / "one.ecsv").write_text("\n".join([*lines, "ra,n x", "1.5,2", '"",3', "-2e3,"]) + "\n")
    spark.dataSource.register(ecsv.EcsvSource)
    assert [tuple(r) for r in spark.read.format("ecsv").load(f"{tmp_path}/one.ecsv").collect()] == [(1.5, 2), (None, 3), (-2000.0, None)]
    with pytest.raises(ValueError):
        ecsv.parse_header(["# - {name: a, datatype: complex128}"])
    with pytest.raises(ValueError):
        ecsv.parse_header(["# nothing"])


def test_summary_with_keys_merged_in(spark, tmp_path):
    facts = lambda rows: spark.createDataFrame(rows, "name string, value string")
    merged = export.merged_facts(facts([("rows", "10"), ("note", "old")]), facts([("note", 'a "new" one'), ("tiles", "3")]))
    export.write_summary(merged, str(tmp_path))
    texts = {n: "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/summary.{n}").collect()) for n in ("json", "md")}
    assert json.loads(texts["json"]) == {"rows": "10", "note": 'a "new" one', "tiles": "3"}
    assert texts["md"].splitlines()[2:] == ['| note | a "new" one |', "| rows | 10 |", "| tiles | 3 |"]
