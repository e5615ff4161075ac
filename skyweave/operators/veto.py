"""Vetoes (D05, D06) and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skyjoin import anti, pairs


def veto(df: DataFrame, catalogue: DataFrame, radius: float, key: list[str], enabled: bool = True) -> tuple[DataFrame, str]:
    """Rows without a match, and why rows passed unchecked, if they did."""
    if not enabled:
        return df, "disabled"
    if df.isEmpty():
        return df, "no candidates"
    if catalogue.isEmpty():
        return df, "empty catalogue"
    return anti(df, catalogue, radius, key), "ok"


def chain_flags(df: DataFrame, catalogues: dict[str, DataFrame], radius: float, key: list[str], spread: str = "left") -> DataFrame:
    """For each row, in_<name> of each veto and the first that hit it. Every veto is tested on every row, so that
    counterfactual chains can be read from the same flags; `chain_ledger` counts each only among those that survived.

    All vetoes share one radius join, over the union of their catalogues, whose hits are a bit set for each key."""
    names, both = list(catalogues), None
    for k, c in enumerate(catalogues.values()):
        one = c.select(F.lit(1 << k).alias("bit"), "ra", "dec")
        both = one if both is None else both.union(one)
    hits = pairs(df.select(*key, "ra", "dec"), both, radius, spread=spread).groupBy(*key).agg(F.bit_or("r_bit").alias("_bits"))
    out = df.join(hits, key, "left")
    out = out.withColumns({f"in_{n}": F.coalesce(F.col("_bits").bitwiseAND(1 << k) != 0, F.lit(False)) for k, n in enumerate(names)})
    first = F.coalesce(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n in names), F.lit("kept"))
    return out.withColumn("outcome", first).drop("_bits")


def chain_ledger(flags: DataFrame, names: list[str]) -> DataFrame:
    """Rows in, eliminated and kept of each step."""
    left = F.lit(True)
    parts = []
    for k, n in enumerate(names):
        parts.append(F.struct(F.lit(k).alias("step"), F.lit(n).alias("veto"), F.sum(left.cast("long")).alias("rows_in"), F.sum((left & F.col(f"in_{n}")).cast("long")).alias("eliminated"), F.sum((left & ~F.col(f"in_{n}")).cast("long")).alias("kept")))
        left = left & ~F.col(f"in_{n}")
    return flags.agg(F.array(*parts).alias("steps")).select(F.explode("steps").alias("s")).select("s.*")
