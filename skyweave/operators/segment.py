"""Running sums and greedy batches over rows in one order (F05, A21), without a task that sees them all."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.sources.shared import written

BLOCK = 8192  #: groups that one task follows at a time


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the inclusive running sum of each column, in an order that must be total: sums within the ranges of a range
    sort, and what the ranges before hold (one row for each shuffle partition)."""
    dealt = written(df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy("_range").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums)).collect()
    at, starts = [0] * len(sums), []
    for r in sorted(held, key=lambda r: r["_range"]):
        starts.append((r["_range"], *at))
        at = [a + (r[f"_t_{n}"] or 0) for a, n in zip(at, sums, strict=True)]
    begin = df.sparkSession.createDataFrame(starts, ", ".join(["_range int", *(f"_t_{n} long" for n in sums)]))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(begin), "_range").withColumns({n: F.sum(f"_v_{n}").over(w) + F.col(f"_t_{n}") for n in sums})
    return out.drop("_range", *(f"_v_{n}" for n in sums), *(f"_t_{n}" for n in sums))


def _exits(block: int):
    """Of each group of a block the first start outside it that batches from that group lead to."""

    def exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        first, to = table.column("i")[0].as_py(), table.column("next").to_pylist()
        for k in range(len(to) - 1, -1, -1):
            if to[k] - first < len(to):
                to[k] = to[to[k] - first]
        return pa.table({"node": table.column("i"), "to": pa.array(to, pa.int64())})

    return exits


def _starts(_, table: pa.Table, entry: pa.Table) -> pa.Table:
    """Of each group of a block the batches that have begun in the block up to it, given where the chain enters it."""
    table = table.sort_by("i")
    to = table.column("next").to_pylist()
    first = table.column("i")[0].as_py() if to else 0  # the end of all may lie in a block of its own
    begun = [0] * len(to)
    at = min(entry.column("node").to_pylist(), default=first + len(to)) - first
    while at < len(to):
        begun[at] = 1
        at = to[at] - first
    for k in range(1, len(begun)):
        begun[k] += begun[k - 1]
    return pa.table({"i": table.column("i"), "block": table.column("block"), "begun": pa.array(begun, pa.int64())})


def batches(groups: DataFrame, key: str, size: str, most: int, rows: int, block: int = BLOCK) -> DataFrame:
    """(key, batch): groups in order of a unique key, cut greedily into batches of at most `most` groups and `rows`
    rows; a group that is larger is a batch of its own. Null sizes count as 0.

    Where the batch that begins at a group would end follows from two running sums: groups, and the rank of its limit among
    the running rows. Each block of groups then tells where chains that come into it leave it; these few exits are joined
    by pointer doubling from the first group on, and each block marks the starts of the one chain that enters it.
    """
    g = running(groups.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")), [key], {"i": F.lit(1), "_end": F.col("_size")})
    g = written(g)
    none = F.lit(None).cast("long")
    ends = g.select(F.col("_end").alias("v"), F.lit(0).alias("kind"), none.alias("of"), F.col("i").alias("tie"))
    limits = g.select((F.col("_end") - F.col("_size") + rows).alias("v"), F.lit(1).alias("kind"), F.col("i").alias("of"), F.col("i").alias("tie"))
    ranked = running(ends.union(limits), ["v", "kind", "tie"], {"fit": (F.col("kind") == 0).cast("long")}).where("kind = 1")
    after = F.greatest(F.col("i") + 1, F.least(F.col("i") + most, F.col("fit") + 1))
    hops = ranked.select(F.col("of").alias("i"), "fit").select("i", after.alias("next"))
    hops = written(hops.withColumn("block", F.floor((F.col("i") - 1) / block)))
    exits = written(hops.groupBy("block").applyInArrow(_exits(block), "node long, to long"))
    nodes = exits.select(F.col("to").alias("node")).union(exits.where("node = 1").select("node")).distinct()
    jump = written(exits.join(nodes, "node"))
    reached, n = written(jump.where("node = 1").select("node")), 1
    while n:
        found = written(reached.union(jump.join(reached, "node").select(F.col("to").alias("node"))).distinct())
        n = found.count() - reached.count()
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
        reached, jump = found, written(jump.join(far, "to").select("node", F.col("far").alias("to")))
    entry = reached.withColumn("block", F.floor((F.col("node") - 1) / block))
    begun = written(hops.groupBy("block").cogroup(entry.groupBy("block")).applyInArrow(_starts, "i long, block long, begun long").where("i IS NOT NULL"))
    blocks = running(begun.groupBy("block").agg(F.max("begun").alias("n")), ["block"], {"all": F.col("n")})
    at = begun.join(blocks.select("block", (F.col("all") - F.col("n")).alias("before")), "block")
    return g.join(at, "i").select(key, (F.col("begun") + F.col("before") - 1).cast("int").alias("batch"))
