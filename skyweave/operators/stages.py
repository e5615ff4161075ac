"""Shrinking stages: every stage gives kept rows, a flags row for each input row, and a ledger (A22, 2.M)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skyjoin import nearest, pairs


@dataclass
class Stage:
    """flags has the key, what the stage measured, and `keep`; kept and ledger derive from it in one pass each."""

    rows: DataFrame
    flags: DataFrame
    key: str

    @property
    def kept(self) -> DataFrame:
        return self.rows.join(self.flags.where("keep").select(self.key), self.key, "left_semi")

    @property
    def ledger(self) -> DataFrame:
        return self.flags.agg(F.count("*").alias("input_rows"), F.sum((~F.col("keep")).cast("long")).alias("dropped_rows"), F.sum(F.col("keep").cast("long")).alias("kept_rows"))


def match_stage(rows: DataFrame, catalogue: DataFrame, radius: float, key: str, keep_matches: bool = False) -> Stage:
    """D09, SKYBOT, SCOS, VSX, GSC, MAPS, USNO: nearest match within radius decides; keep_matches is the SCOS mode."""
    best = nearest(rows.select(key, "ra", "dec"), catalogue, radius, [key], "id").select(key, F.col("r_id").alias("match_id"), F.col("sep_arcsec").alias("match_sep"))
    flags = rows.select(key).join(best, key, "left").withColumn("matched", F.col("match_id").isNotNull())
    return Stage(rows, flags.withColumn("keep", F.col("matched") if keep_matches else ~F.col("matched")), key)


def test_stage(rows: DataFrame, key: str, reject: dict[str, str]) -> Stage:
    """Named tests; a test that is null (missing evidence) never rejects."""
    marks = [F.when(F.coalesce(F.expr(t), F.lit(False)), F.lit(n)) for n, t in reject.items()]
    flags = rows.withColumn("reason", F.array_join(F.array_compact(F.array(*marks)), ";"))
    return Stage(rows, flags.select(key, "reason", (F.col("reason") == "").alias("keep")), key)


def shrink(rows: DataFrame, flags: DataFrame, key: str, flag: str, keep_matched: bool) -> DataFrame:
    """Keep flagged or unflagged rows; a missing flag counts as unmatched; flags must have unique keys."""
    if flags.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"flags repeat {key}")
    hit = F.coalesce(F.col("_flag") > 0, F.lit(False))
    joined = rows.join(flags.select(key, F.col(flag).cast("int").alias("_flag")), key, "left")
    return joined.where(hit if keep_matched else ~hit).drop("_flag")


def banded_counts(rows: DataFrame, catalogue: DataFrame, key: str, radius: float, bands: dict[str, str]) -> DataFrame:
    """Of each row the matches within radius that meet each condition (of r_ columns and sep_arcsec)."""
    p = pairs(rows.select(key, "ra", "dec"), catalogue, radius)
    counts = p.groupBy(key).agg(*(F.sum(F.coalesce(F.expr(c), F.lit(False)).cast("long")).alias(n) for n, c in bands.items()))
    out = rows.select(key).join(counts, key, "left")
    return out.select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in bands))
