"""Connected components by alternating large-star and small-star steps (E09 and the near-duplicate operators)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.sources.shared import written


def _joined_up(table: pa.Table) -> pa.Table:
    """Components of all edges of a table, by union of trees towards the smaller id."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    kind = table.schema.field("u").type
    return pa.table({"id": pa.array(list(up), kind), "component": pa.array([root(x) for x in list(up)], kind)})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", alone: int = 0) -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable. Up to `alone` edges, counted first, are
    joined in one task; more of them in rounds.

    Each round is two aggregations and two joins on the edge table; a node never gathers its neighbours in one row.
    Rounds grow with the logarithm of a component's diameter. Edges with a null end and loops link nothing.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))
    )
    e = written(e.distinct())
    mark = lambda t: t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    seen = mark(e)
    if seen["n"] <= alone:
        kind = e.schema["u"].dataType.simpleString()
        return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_joined_up, f"id {kind}, component {kind}")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least).distinct())
        e, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
