"""Radius joins on the sphere as cell equi-joins.

A position is a unit vector; cells are cubes of WIDE chords of the radius. Each right row has one cell, each left row
its own and those that the radius reaches over a face, an edge or a corner: only rows next to a face are repeated
(some 1.4 copies a row on average). An equi-join on the packed cell id (and further keys) is refined by declination
and the exact separation, inclusive. No pair occurs twice. Rows without a position match nothing. Catalyst picks the
physical join, and AQE splits crowded cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky

EDGE, BIAS, WIDE = 2e-6, 1 << 20, 16


def _celled(df: DataFrame, edge: float, reach: float | None) -> DataFrame:
    """Df with its cell, or, with a reach, once for each cell that the reach touches."""
    place = [F.expr(c) / edge for c in sky.unit_xyz("ra", "dec")]
    axes = [F.floor(x).cast("long") for x in place]
    pack = lambda x, y, z: (x + BIAS) * F.lit(1 << 42) + (y + BIAS) * F.lit(1 << 21) + (z + BIAS)
    if reach is None:
        return df.withColumn("_cell", pack(*axes))
    r = reach / edge
    steps = [F.array_compact(F.array(a, F.when(x - a <= r, a - 1), F.when(a + 1 - x <= r, a + 1))) for x, a in zip(place, axes, strict=True)]
    all_three = lambda xs, ys, zs: F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: pack(x, y, z))))))
    own = pack(*axes)
    one = (F.size(steps[0]) == 1) & (F.size(steps[1]) == 1) & (F.size(steps[2]) == 1)
    return df.withColumn("_cell", F.explode(F.when(one, F.array(own)).otherwise(all_three(*steps))))


def pairs(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None, strict: bool = False, spread: str = "left") -> DataFrame:
    """All pairs within radius arcsec. Right columns are prefixed r_; sep_arcsec is added.

    Both sides have ra and dec; `on` names columns that must be equal on both sides (they are not prefixed). `spread` is the side
    whose rows are repeated in neighbouring cells: the smaller one, where that is known.
    """
    on = on or []
    reach = sky.chord(radius) * (1 + 1e-9) + 1e-15
    edge = max(WIDE * reach, EDGE)
    placed = "ra IS NOT NULL AND dec IS NOT NULL"
    r = _celled(right.where(placed), edge, reach if spread == "right" else None)
    r = r.select(*(F.col(c).alias(c if c in on or c == "_cell" else f"r_{c}") for c in r.columns))
    joined = _celled(left.where(placed), edge, reach if spread == "left" else None).join(r, ["_cell", *on]).drop("_cell")
    joined = joined.where(F.abs(F.col("dec") - F.col("r_dec")) <= radius / 3600 + 1e-9)
    sep = F.expr(sky.haversine("ra", "dec", "r_ra", "r_dec"))
    out = joined.withColumn("sep_arcsec", sep)
    return out.where(F.col("sep_arcsec") < radius if strict else F.col("sep_arcsec") <= radius)


def nearest(left: DataFrame, right: DataFrame, radius: float, left_key: list[str], right_key: str, on: list[str] | None = None, spread: str = "left") -> DataFrame:
    """Of each left row with a match its nearest right row (ties to the smaller key)."""
    p = pairs(left, right, radius, on, spread=spread)
    rest = [c for c in p.columns if c not in left_key]
    best = p.groupBy(*left_key).agg(F.min_by(F.struct(*rest), F.struct("sep_arcsec", f"r_{right_key}")).alias("_b"))
    return best.select(*left_key, "_b.*")


def matched_keys(left: DataFrame, right: DataFrame, radius: float, left_key: list[str], on: list[str] | None = None, spread: str = "left") -> DataFrame:
    slim = left.select(*dict.fromkeys([*left_key, "ra", "dec", *(on or [])]))
    return pairs(slim, right.select("ra", "dec", *(on or [])), radius, on, spread=spread).select(*left_key).distinct()


def tagged_matches(rows: DataFrame, key: str, catalogues: dict[str, DataFrame], radius: float, spread: str = "left") -> DataFrame:
    """Of each row that matches any of the catalogues: <name>_match_id, _sep and _count of each (its nearest row, ties to
    the smaller id). One radius join over their union, one aggregate."""
    both = None
    for name, c in catalogues.items():
        one = c.select(F.lit(name).alias("tag"), F.col("id").cast("string").alias("id"), "ra", "dec")
        both = one if both is None else both.union(one)
    p = pairs(rows.select(key, "ra", "dec"), both, radius, spread=spread)
    of = lambda n, c: F.when(F.col("r_tag") == n, c)
    out = []
    for n in catalogues:
        best = F.min(of(n, F.struct("sep_arcsec", F.length("r_id"), "r_id")))  # numbers in order of size
        out += [best["r_id"].alias(f"{n}_match_id"), best["sep_arcsec"].alias(f"{n}_sep"), F.count(of(n, F.lit(1))).alias(f"{n}_count")]
    return p.groupBy(key).agg(*out)


def semi(left: DataFrame, right: DataFrame, radius: float, left_key: list[str], on: list[str] | None = None) -> DataFrame:
    """Left rows with a match."""
    return left.join(matched_keys(left, right, radius, left_key, on), left_key, "left_semi")


def anti(left: DataFrame, right: DataFrame, radius: float, left_key: list[str], on: list[str] | None = None) -> DataFrame:
    """Left rows without a match, the veto."""
    return left.join(matched_keys(left, right, radius, left_key, on), left_key, "left_anti")


ALONE = 200_000  #: pairs of a component that one task takes


def _greedy(table):
    """Pairs of a component, nearest first, of which both rows are still free."""
    table = table.sort_by([("sep_arcsec", "ascending"), ("_l", "ascending"), ("_r", "ascending")])
    taken, rows = set(), []
    for k, ends in enumerate(zip(table.column("_l").to_pylist(), table.column("_r").to_pylist(), strict=True)):
        ends = {("l", ends[0]), ("r", ends[1])}
        if not ends & taken:
            taken |= ends
            rows.append(k)
    return table.take(rows).select(["_l", "_r", "sep_arcsec"])


def best_symmetric(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str, alone: int = ALONE) -> DataFrame:
    """One-to-one pairs, greedily by separation (ties by left, then right key).

    A round takes the pairs that are nearest for both their rows, and drops these rows' others; two rounds settle most. What is
    left falls into components of the pair graph: each of up to `alone` pairs is settled in one task, whatever the length of
    its chains, and only larger ones go on by rounds.
    """
    from skyweave.sources.shared import written

    from .components import connected_components

    kinds = f"_l {left.schema[left_key].dataType.simpleString()}, _r {right.schema[right_key].dataType.simpleString()}, sep_arcsec double"
    rest = written(pairs(left, right, radius).select(F.col(left_key).alias("_l"), F.col(f"r_{right_key}").alias("_r"), "sep_arcsec"))
    order, taken = F.struct("sep_arcsec", "_l", "_r"), []

    def one_round(rest):
        by_left = rest.groupBy("_l").agg(F.min(order).alias("b")).select("b.*")
        by_right = rest.groupBy("_r").agg(F.min(order).alias("b")).select("b.*")
        mutual = written(by_left.join(by_right, ["_l", "_r", "sep_arcsec"], "left_semi"))
        taken.append(mutual)
        return written(rest.join(mutual, "_l", "left_anti").join(mutual, "_r", "left_anti"))

    rest = one_round(one_round(rest))
    if not rest.isEmpty():
        ends = rest.select("*", F.concat(F.lit("l"), F.col("_l").cast("string")).alias("_a"), F.concat(F.lit("r"), F.col("_r").cast("string")).alias("_b"))
        named = written(ends.join(connected_components(ends, "_a", "_b").select(F.col("id").alias("_a"), "component"), "_a").select("_l", "_r", "sep_arcsec", "component"))
        large = named.groupBy("component").count().where(F.col("count") > alone).select("component")
        small = named.join(large, "component", "left_anti")
        taken.append(written(small.groupBy("component").applyInArrow(_greedy, kinds)))
        rest = written(named.join(large, "component", "left_semi").drop("component"))
        while not rest.isEmpty():
            rest = one_round(rest)
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t.select(out.columns))
    return out.select(F.col("_l").alias(left_key), F.col("_r").alias(f"r_{right_key}"), "sep_arcsec")


def cone(catalogue: DataFrame, ra: float, dec: float, radius_arcmin: float, columns: list[str] | None = None, cell: str | None = None, nside: int = 32) -> DataFrame:
    """Rows within a cone, nearest first; `cell` names a HEALPix partition column to prune by."""
    from skyweave.functions.healpix import cone_cells

    df = catalogue
    if cell:
        df = df.where(F.col(cell).isin(cone_cells(ra, dec, radius_arcmin / 60, nside)))
    df = df.select(*(columns or catalogue.columns)).withColumn("_r", F.expr(sky.cosine_separation("ra", "dec", f"{ra}e0", f"{dec}e0")) * 60)
    return df.where(F.col("_r") <= radius_arcmin).orderBy("_r")
