"""First occurrence (F01), radius de-duplication (D10, E09) and its sweep.

Rows at one position are one place, as n of them would make n * (n - 1) / 2 pairs: the radius join and the components go over
places, ids take the component of theirs, and pairs of rows are counted from the rows that each place has on each tile. An
id is one node wherever its rows lie, so places that share an id are linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.sources.shared import settled, written

from .components import connected_components
from .skyjoin import pairs


ALONE = 200_000  #: pairs whose components one task joins; more go by rounds


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """F01."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def self_pairs(df: DataFrame, radius: float) -> DataFrame:
    """Pairs (src_id, r_src_id) within radius, each once."""
    slim = df.select("src_id", "ra", "dec")
    return pairs(slim, slim, radius).where("src_id < r_src_id")


def _placed() -> Column:
    """Rows that can be near others."""
    return F.col("src_id").isNotNull() & (F.abs("ra") < float("inf")) & (F.abs("dec") < float("inf"))


def _homes(df: DataFrame) -> DataFrame:
    """Of each src_id the smallest and the largest of its positions (null: it has none) and its rows there; written."""
    by = df.select("src_id", F.when(_placed(), F.struct("ra", "dec")).alias("at")).groupBy("src_id")
    return written(by.agg(F.min("at").alias("home"), F.max("at").alias("far"), F.count("at").alias("rows")))


def _places(df: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Places (place, ra, dec, smallest src_id, number of ids that are at home there), and links (src, dst) between those
    that share an id, if any do; written."""
    rows, links = homes.where("home IS NOT NULL").select("home.ra", "home.dec", "src_id", F.lit(1).alias("one")), None
    roaming = homes.where("home <> far").select("src_id", "home")
    some = not roaming.isEmpty()
    if some:
        away = df.where(_placed()).select("src_id", "ra", "dec").join(roaming, "src_id").where(F.struct("ra", "dec") != F.col("home"))
        away = written(away.distinct())
        rows = rows.union(away.select("ra", "dec", "src_id", F.lit(0)))
    by = rows.groupBy("ra", "dec").agg(F.min("src_id").alias("least"), F.sum("one").alias("ids"))
    places = written(by.withColumn("place", F.monotonically_increasing_id()))
    if some:
        named = lambda p: places.select(F.col("place").alias(p), "ra", "dec")
        ends = away.join(named("src"), ["ra", "dec"]).select("src", "home.ra", "home.dec").join(named("dst"), ["ra", "dec"])
        links = written(ends.select("src", "dst").distinct())
    return places, links


def _near(places: DataFrame, radius: float) -> DataFrame:
    """Pairs of places within the radius, each once, with their separation; written."""
    slim = places.select("place", "ra", "dec")
    return written(pairs(slim, slim, radius).where("place < r_place").select("place", "r_place", "sep_arcsec"))


def _components(places: DataFrame, links: DataFrame | None, near: DataFrame) -> DataFrame:
    """Places with their component, alone ones too."""
    edges = near.select(F.col("place").alias("src"), F.col("r_place").alias("dst"))
    roots = connected_components(edges if links is None else edges.union(links), alone=ALONE)
    return places.join(roots.withColumnRenamed("id", "place"), "place", "left").withColumn("component", F.coalesce("component", "place"))


def dedup(df: DataFrame, radius: float) -> DataFrame:
    """Each row with its representative, the smallest src_id of its component (lexicographic)."""

    def moved():
        homes = _homes(df)
        places, links = _places(df, homes)
        named = written(_components(places, links, _near(places, radius)))
        least = named.groupBy("component").agg(F.min("least").alias("first"))
        named = named.join(least, "component").select("ra", "dec", F.col("first").alias("component"))
        at_home = homes.where("home IS NOT NULL").select("home.ra", "home.dec", "src_id")
        return at_home.join(named, ["ra", "dec"]).where("component <> src_id").select("src_id", "component")

    named = df.join(settled(df.sparkSession, moved), "src_id", "left")
    return named.withColumn("component", F.coalesce("component", "src_id")).withColumn("kept", F.col("component") == F.col("src_id"))


def _sizes(homes: DataFrame, places: DataFrame, links: DataFrame | None, near: DataFrame, radii: list[float]) -> DataFrame:
    alone, out = homes.where("home IS NULL").select(F.lit(1).cast("long").alias("size")), None
    for r in radii:

        def at_radius(r=r):
            named = _components(places, links, near.where(F.col("sep_arcsec") <= r))
            size = named.groupBy("component").agg(F.sum("ids").alias("size")).select("size").union(alone)
            return size.groupBy("size").agg(F.count("*").alias("clusters")).select(F.lit(float(r)).alias("radius"), "size", "clusters")

        one = settled(homes.sparkSession, at_radius)
        out = one if out is None else out.union(one)
    return out


def cluster_sizes(df: DataFrame, radii: list[float]) -> DataFrame:
    """Radius, size and how many clusters have it (rows without a neighbour are clusters of one)."""

    def built():
        homes = _homes(df)
        places, links = _places(df, homes)
        return _sizes(homes, places, links, _near(places, max(radii)), radii)

    return settled(df.sparkSession, built)


def _links(df: DataFrame, homes: DataFrame, places: DataFrame, near: DataFrame, radii: list[float]) -> DataFrame:
    """Pairs of rows of different ids, and those of them on two tiles, by the smallest radius that they are within."""
    step = F.coalesce(*(F.when(F.col("sep_arcsec") <= r, F.lit(float(r))) for r in sorted(radii))).alias("step")
    rows = df.where(_placed())
    tiles = rows.groupBy("ra", "dec", "tile_id").agg(F.count("*").alias("m"))
    tiles = written(tiles.join(places.select("place", "ra", "dec"), ["ra", "dec"]).select("place", "tile_id", "m"))
    on_tile = F.when(F.col("tile_id").isNotNull(), F.col("m"))
    told = F.coalesce(F.sum(on_tile), F.lit(0)).alias("told")
    spots = tiles.groupBy("place").agg(F.sum("m").alias("n"), told, F.sum(F.when(F.col("tile_id").isNotNull(), F.expr("m * (m - 1) div 2"))).alias("same"), F.count("*").alias("tiles"))
    spots = written(spots)
    total = lambda n, x: (F.sum(n).alias("pairs"), F.sum(x).alias("cross"))
    within = spots.agg(*total(F.expr("n * (n - 1) div 2"), F.expr("told * (told - 1) div 2 - coalesce(same, 0)"))).select(F.lit(0e0).alias("step"), "pairs", "cross")
    side = lambda p: spots.select(F.col("place").alias("place" if p == "" else "r_place"), *(F.col(c).alias(p + c) for c in ("n", "told", "tiles")))
    both = near.select("place", "r_place", step).join(side(""), "place").join(side("r_"), "r_place")
    fewer = F.col("tiles") <= F.col("r_tiles")
    both = written(both.select("step", F.expr("n * r_n").alias("pairs"), F.expr("told * r_told").alias("cross"), F.when(fewer, F.col("place")).otherwise(F.col("r_place")).alias("few"), F.when(fewer, F.col("r_place")).otherwise(F.col("place")).alias("many")))
    between = both.groupBy("step").agg(*total("pairs", "cross"))
    met = both.select("step", "few", "many").join(tiles.select(F.col("place").alias("few"), "tile_id", F.col("m").alias("k")), "few")
    one_tile = met.join(tiles.withColumnRenamed("place", "many"), ["many", "tile_id"]).groupBy("step").agg(*total(F.lit(0), -F.col("m") * F.col("k")))
    out = within.union(between).union(one_tile)
    again = homes.where("rows > 1").select("src_id")
    if not again.isEmpty():  # pairs of rows of one id do not count
        own = rows.join(again, "src_id").groupBy("src_id", "ra", "dec", "tile_id").agg(F.count("*").alias("m"))
        own = written(own.withColumn("g", F.monotonically_increasing_id()))
        out = out.union(own.select(F.lit(0e0), -F.expr("m * (m - 1) div 2"), F.lit(0)))
        two = own.join(own.select("src_id", *(F.col(c).alias(f"r_{c}") for c in ("ra", "dec", "tile_id", "m", "g"))), "src_id").where("g < r_g")
        two = two.withColumn("sep_arcsec", F.expr(sky.haversine("ra", "dec", "r_ra", "r_dec"))).where(F.col("sep_arcsec") <= max(radii))
        out = out.union(two.select(step, -F.expr("m * r_m"), F.when(F.col("tile_id") != F.col("r_tile_id"), -F.expr("m * r_m")).otherwise(0)))
    return written(out.groupBy("step").agg(*total("pairs", "cross")))


def sweep(df: DataFrame, radii: list[float]) -> DataFrame:
    """Pairs, pairs across and inside tiles, rows kept and largest cluster at each radius, from one radius join."""

    def built():
        homes = _homes(df)
        places, links = _places(df, homes)
        near = _near(places, max(radii))
        sizes = _sizes(homes, places, links, near, radii).groupBy("radius").agg(F.sum("clusters").alias("kept"), F.max("size").alias("max_cluster"))
        within = F.explode(F.array(*(F.lit(float(r)) for r in radii))).alias("radius")
        counts = _links(df, homes, places, near, radii).select(within, "*").where("step <= radius")
        counts = counts.groupBy("radius").agg(F.sum("pairs").alias("pairs"), F.sum("cross").alias("cross_tile"))
        out = sizes.join(counts, "radius", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pairs", "cross_tile")})
        return out.select("radius", "pairs", "cross_tile", (F.col("pairs") - F.col("cross_tile")).alias("intra_tile"), "kept", "max_cluster")

    return settled(df.sparkSession, built)


def representatives(df: DataFrame, radius: float, order: str) -> DataFrame:
    """One row of each component, in the order of the input's ordinal column (a range sort, not one task)."""
    return dedup(df, radius).where("kept").drop("component", "kept").orderBy(order)
