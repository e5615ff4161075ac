import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import dedup, skyjoin

INF, NAN = float("inf"), float("nan")


def _rows(seed):
    """Rows at few positions: ids that repeat there or elsewhere, without a tile, a position or an id."""
    rng = random.Random(seed)
    spots = [(10 + rng.randint(0, 3) * 1.5 / 3600, 20 + rng.randint(0, 40) * 1.0 / 3600) for _ in range(40)]
    rows = [(f"n{k}", rng.choice([1, 2, 3, None]), *rng.choice(spots)) for k in range(150)]
    rows += [(f"n{rng.randint(0, 20)}", rng.choice([1, 2, None]), *rng.choice(spots)) for _ in range(12)] + rows[:5]
    odd = [("n3", 1, None, None), ("x1", 1, None, 20.0), ("x2", 2, NAN, 20.0), ("x3", 2, NAN, 20.0), ("x4", 1, INF, INF), ("x5", 1, INF, INF)]
    return rows + odd + [(None, 1, *spots[0]), (None, 2, *spots[1]), ("z1", 1, -0.0, 0.0), ("z2", 1, 0.0, -0.0), ("z3", 1, 360.0, 0.0)]


def _want(spark, df, radius):
    """Links of rows by all pairs, and components of ids by hand."""
    a, b = (df.select(F.col("src_id").alias(f"{p}_id"), F.col("tile_id").alias(f"{p}_tile"), F.col("ra").alias(f"{p}_ra"), F.col("dec").alias(f"{p}_dec")) for p in "ab")
    links = a.crossJoin(b).where("a_id < b_id").where(F.expr(sky.haversine("a_ra", "a_dec", "b_ra", "b_dec")) <= radius).collect()
    up = {r.src_id: r.src_id for r in df.select("src_id").distinct().collect()}
    root = lambda x: x if up[x] == x else root(up[x])
    for r in links:
        x, y = sorted((root(r.a_id), root(r.b_id)))
        up[y] = x
    cross = sum(r.a_tile is not None and r.b_tile is not None and r.a_tile != r.b_tile for r in links)
    return len(links), cross, {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1])
def test_rows_at_one_place_count_as_in_all_pairs(spark, seed):
    df = spark.createDataFrame(_rows(seed), "src_id string, tile_id long, ra double, dec double").repartition(3)
    radii = [0.3, 1.2, 2.0]
    swept = {r.radius: r for r in dedup.sweep(df, radii).collect()}
    sizes = {(r.radius, r.size): r.clusters for r in dedup.cluster_sizes(df, radii).collect()}
    for radius in radii:
        n, cross, roots = _want(spark, df, radius)
        by_root = {}
        for x, c in roots.items():
            by_root.setdefault(c, []).append(x)
        r = swept[radius]
        assert (r.pairs, r.cross_tile, r.intra_tile) == (n, cross, n - cross)
        assert (r.kept, r.max_cluster) == (len(by_root), max(map(len, by_root.values())))
        counted = {}
        for ids in by_root.values():
            counted[len(ids)] = counted.get(len(ids), 0) + 1
        assert {s: c for (x, s), c in sizes.items() if x == radius} == counted
        named = dedup.dedup(df, radius)
        assert named.count() == df.count() and all(r.component == roots[r.src_id] and r.kept == (None if r.src_id is None else r.component == r.src_id) for r in named.collect())


@pytest.mark.parametrize("run", [lambda df: dedup.sweep(df, [0.3, 3.0]), lambda df: dedup.cluster_sizes(df, [0.3, 3.0]), lambda df: dedup.dedup(df, 3), lambda df: dedup.representatives(df, 3, "src_id")])
def test_rows_at_one_place_are_not_paired(spark, monkeypatch, run):
    """1,000 rows at each of two places: the radius join gives pairs of places, not of rows."""
    df = spark.range(2000).selectExpr("concat('n', id) AS src_id", "id % 7 AS tile_id", "10e0 AS ra", "20e0 + id % 2 / 3600e0 AS dec")
    met = []

    def counted(left, right, *more):
        out = skyjoin.pairs(left, right, *more)
        met.append(out.count())
        return out

    monkeypatch.setattr(dedup, "pairs", counted)
    assert run(df).count() > 0 and max(met) == 4
