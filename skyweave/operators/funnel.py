"""Where rows of nested stages were lost (D20, E13) and how far a reference row came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.sources.shared import written

from .skyjoin import pairs


def membership(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Key and bits: which tables have the key, the k-th as bit k. One union and one aggregate for any number of
    tables; repeated keys count once, keys with a null are left out."""
    both = None
    for k, t in enumerate(tables.values()):
        one = t.select(*key).dropna().withColumn("bit", F.lit(1 << k).cast("long"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(*key).agg(F.bit_or("bit").alias("bits"))


def outcome(tables: dict[str, DataFrame], ladder: list[tuple[str, str, bool]], last: str) -> tuple[Column, Column]:
    """Label and rank of a row of `membership` by a ladder of (label, table, present): the first step whose table has the
    key, or lacks it, as told; ranks go up from 1, `last` is the highest."""
    place = {n: k for k, n in enumerate(tables)}
    label, rank = F.lit(last), F.lit(len(ladder) + 1)
    for k, (name, table, present) in reversed(list(enumerate(ladder, 1))):
        has = F.col("bits").bitwiseAND(1 << place[table]) != 0
        hit = has if present else ~has
        label, rank = F.when(hit, name).otherwise(label), F.when(hit, k).otherwise(rank)
    return label.alias("stage"), rank.alias("rank")


def best_outcome(reference: DataFrame, detections: DataFrame, outcomes: DataFrame, radius: float, final: DataFrame | None = None, survived: str = "SURVIVED", dropped: str = "DEDUP_DROPPED", centres: DataFrame | None = None, footprint: float = 0.5, tile: str = "tile_id", never: str = "NEVER_DETECTED") -> DataFrame:
    """every reference row (id, ra, dec) with the furthest stage that its detections reached on any tile.

    On each tile the nearest detection within radius stands for the row; of several tiles the highest rank counts, at ties the
    nearer, then the smaller tile. `outcomes` gives stage and rank by (tile, id) of detections. With `final` (tile, ra, dec), a
    row whose detection survived but which has no row of `final` within radius on that tile was dropped there. With
    `centres` (tile, ra, dec) only tiles within `footprint` degrees count, and rows outside all of them are left out.

    Detections at one position are one site, as many rows near many detections would make all their pairs. Rows that have the
    same sites around them, in the same order of distance, share their best detection, which is found once for all of them.
    """
    rows = reference.select("id", "ra", "dec")
    place = "abs(ra) < double('inf') AND abs(dec) < double('inf')"
    told = outcomes.select(tile, F.col("id").alias("det"), "stage", "rank", F.lit(True).alias("known"))
    heads = detections.where(place).groupBy("ra", "dec", tile).agg(F.min("id").alias("det")).withColumn("own", F.lit(True))
    heads = heads.join(told, [tile, "det"], "left").withColumn("there", F.lit(None).cast("boolean"))
    if final is not None:
        ends = final.where(place).select(tile, "ra", "dec").distinct().withColumn("there", F.lit(True))
        heads = heads.unionByName(ends, allowMissingColumns=True)
    heads = written(heads)
    sites = written(heads.select("ra", "dec").distinct().withColumn("site", F.monotonically_increasing_id()))
    near = pairs(rows, sites, radius, spread="right")
    around = near.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("sep_arcsec", F.col("r_site").alias("site")))).alias("near"))
    kind = ["sites"]
    if centres is not None:
        inside = pairs(rows, centres.select(F.col(tile).alias("t"), "ra", "dec"), footprint * 3600).groupBy("id").agg(F.array_sort(F.collect_set("r_t")).alias("tiles"))
        rows, around, kind = rows.join(inside, "id", "left_semi"), around.join(inside, "id"), ["sites", "tiles"]
    # sites from near to far, below 0 if as far as the one before
    tied = lambda x, k: (k > 0) & (F.get("near", F.greatest(k - 1, F.lit(0)))["sep_arcsec"] == x["sep_arcsec"])
    around = written(around.withColumn("sites", F.transform("near", lambda x, k: F.when(tied(x, k), -1 - x["site"]).otherwise(x["site"]))))
    kinds = written(around.select(*kind).distinct().withColumn("kind", F.monotonically_increasing_id()))
    step = F.transform("sites", lambda x, k: F.struct(F.size(F.filter(F.slice("sites", 1, k + 1), lambda y: y >= 0)).alias("step"), F.when(x < 0, -1 - x).otherwise(x).alias("site")))
    steps = kinds.select("kind", *kind[1:], F.explode(step).alias("s")).select("kind", *kind[1:], "s.*")
    met = steps.join(heads.join(sites, ["ra", "dec"]).drop("ra", "dec"), "site")
    if centres is not None:
        met = met.where(F.array_contains("tiles", F.col(tile)))
    first = F.min(F.when(F.col("own"), F.struct("step", "det", "known", "stage", "rank", "site"))).alias("b")
    by_tile = met.groupBy("kind", tile).agg(first, F.max("there").alias("there")).where("b.known").select("kind", tile, "b.*", "there")
    if final is not None:
        lost = (F.col("stage") == survived) & F.col("there").isNull()
        rank = F.col("rank") * 2 - F.coalesce(lost, F.lit(False)).cast("int")  # just below those that survived
        by_tile = by_tile.withColumns({"rank": rank, "stage": F.when(lost, dropped).otherwise(F.col("stage"))})
    best = by_tile.groupBy("kind").agg(F.min(F.struct(-F.col("rank"), "step", tile, "stage", "det", "site")).alias("b"))
    best = around.join(kinds.join(best, "kind").select(*kind, "b"), kind)
    best = best.select("id", "b", F.array_min(F.transform(F.filter("near", lambda x: x["site"] == F.col("b.site")), lambda x: x["sep_arcsec"])).alias("sep_arcsec"))
    out = rows.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("b.stage", F.lit(never)).alias("stage"), "sep_arcsec", F.col(f"b.{tile}").alias(tile), F.col("b.det").alias("det"))


def shares(outcomes: DataFrame, never: str = "NEVER_DETECTED") -> DataFrame:
    """Rows of each stage, their share of all and of those detected (null for those never detected)."""
    n = outcomes.groupBy("stage").agg(F.count("*").alias("n"))
    total = outcomes.agg(F.count("*").alias("total"), F.count(F.when(F.col("stage") != never, 1)).alias("detected"))
    out = n.crossJoin(F.broadcast(total))  # one row
    return out.select("stage", "n", (100 * F.col("n") / F.col("total")).alias("of_all"), F.when(F.col("stage") != never, 100 * F.col("n") / F.col("detected")).alias("of_detected"))
