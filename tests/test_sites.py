import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import funnel, skyjoin

STAGES = [("VETOED", 1), ("BAD", 2), ("SURVIVED", 3)]


def _tables(spark, seed):
    """Reference rows and detections that share few positions, some of them at equal distances; ids that repeat."""
    rng = random.Random(seed)
    at = lambda: (30.0 + rng.randint(0, 3) * 40 / 3600, rng.randint(-3, 3) / 3600)
    ref = [(k, *at()) for k in range(60)] + [(3, *at()), (4, None, 1.0), (61, 200.0, 0.0)]
    det = [(k, f"t{rng.randint(0, 4)}", *at()) for k in range(80)] + [(81, "t1", None, 0.0), (82, None, *at())]
    told = [(t, k, *rng.choice(STAGES)) for k, t, *_ in det if t and k % 9]
    final = [(t, ra, dec) for k, t, ra, dec in det if k % 4 == 0] + [(f"t{rng.randint(0, 4)}", *at()) for _ in range(5)]
    centres = [("t0", 30.0, 0.0), ("t1", 30.0, 0.0), ("t2", 30.1, 0.0), ("t3", 30.0 + 40 / 3600, 0.3)]
    kinds = ("id long, ra double, dec double", "id long, tile_id string, ra double, dec double", "tile_id string, id long, stage string, rank int", "tile_id string, ra double, dec double", "tile_id string, ra double, dec double")
    return [spark.createDataFrame(x, k) for x, k in zip((ref, det, told, final, centres), kinds, strict=True)]


def _want(spark, ref, det, told, final, centres, radius, footprint):
    """By all pairs of rows."""
    of = lambda df: [tuple(r) for r in df.collect()]
    sep = lambda a, b, most: {(r[0], r[1]): r[2] for r in a.selectExpr("id a", "ra ra1", "dec dec1", "monotonically_increasing_id() x").crossJoin(b).select("x", "b", F.expr(sky.haversine("ra1", "dec1", "ra", "dec")).alias("s")).where(F.col("s") <= most).collect()}
    numbered = lambda df: spark.createDataFrame([(k, *r) for k, r in enumerate(of(df.select("ra", "dec")))], "b long, ra double, dec double")
    ref = ref.coalesce(1)
    dets, ends, mids = of(det), of(final), of(centres)
    near, finals, inside = (sep(ref, numbered(x), m) for x, m in ((det, radius), (final, radius), (centres, footprint * 3600)))
    ids = [r[0] for r in of(ref)]
    outcome, out = {(t, k): (s, n) for t, k, s, n in of(told)}, {}
    for i in set(ids):
        mine = [k for k, x in enumerate(ids) if x == i]
        tiles = {mids[b][0] for a, b in inside if a in mine}
        if not tiles:
            continue
        best = None
        for t in tiles:
            found = sorted((s, dets[b][0]) for (a, b), s in near.items() if a in mine and dets[b][1] == t)
            if not found or (t, found[0][1]) not in outcome:
                continue
            stage, rank = outcome[t, found[0][1]]
            lost = stage == "SURVIVED" and not any(a in mine and ends[b][0] == t for a, b in finals)
            one = (-(rank * 2 - lost), found[0][0], t, "DEDUP_DROPPED" if lost else stage, found[0][1])
            best = min(best or one, one)
        out[i] = (best[3], best[1], best[2], best[4]) if best else ("NEVER_DETECTED", None, None, None)
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_best_outcome_as_by_all_pairs(spark, seed):
    ref, det, told, final, centres = tables = _tables(spark, seed)
    got = funnel.best_outcome(ref, det, told, 2.5, final, centres=centres, footprint=0.2).collect()
    want = _want(spark, *tables, 2.5, 0.2)
    assert {r.id: (r.stage, r.sep_arcsec, r.tile_id, r.det) for r in got} == want
    assert len({w[0] for w in want.values()}) > 3


@pytest.mark.parametrize("run", [lambda *x: funnel.best_outcome(*x, 10), lambda *x: funnel.shares(funnel.best_outcome(*x, 10))])
def test_detections_at_one_position_are_not_paired(spark, monkeypatch, run):
    """500 rows near 500 detections on as many tiles: a pair for each row, not 250,000."""
    ref = spark.range(500).selectExpr("id", "10e0 AS ra", "id % 2 / 3600e0 AS dec")
    det = spark.range(500).selectExpr("id", "id AS tile_id", "10e0 AS ra", "0e0 AS dec")
    told = det.selectExpr("tile_id", "id", "IF(id = 77, 'SURVIVED', 'BAD') AS stage", "IF(id = 77, 2, 1) AS rank")
    met = []

    def counted(*x, **more):
        out = skyjoin.pairs(*x, **more)
        met.append(out.count())
        return out

    monkeypatch.setattr(funnel, "pairs", counted)
    assert run(ref, det, told).count() in (1, 500) and met == [500]
