"""Quality filters (C01 to C21), robust clipping (C03), the bright-star mask (D07) and rejection reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky

from .segment import running
from .skyjoin import nearest


def extract_filter(df: DataFrame, snr: float = 30) -> DataFrame:
    """C01; a missing column skips its test."""
    if "flags" in df.columns:
        df = df.where("flags = 0")
    return df.where(F.col("snr") > snr) if "snr" in df.columns else df


def sigma_clip(df: DataFrame, columns: list[str], by: str, k: float = 2.0) -> DataFrame:
    """Keep abs(x - median) <= k * 1.4826 * MAD of the rows given, per group; a zero MAD keeps all that are finite.

    Medians are exact; those of all columns come from one grouped aggregate, their MADs from a second, both joined back,
    so that no predicate is pushed across them.
    """
    middle = df.groupBy(by).agg(*(F.median(x).alias(f"_med_{x}") for x in columns))
    with_med = df.join(middle, by)
    off = {x: F.abs(F.col(x) - F.col(f"_med_{x}")) for x in columns}
    scale = with_med.groupBy(by).agg(*((1.4826 * F.median(off[x])).alias(f"_sigma_{x}") for x in columns))
    out = with_med.join(scale, by)
    for x in columns:
        out = out.where(F.col(x).isNotNull() & ((F.coalesce(f"_sigma_{x}", F.lit(0.0)) <= 0) | (off[x] <= k * F.col(f"_sigma_{x}"))))
    return out.drop(*(f"_{n}_{x}" for x in columns for n in ("med", "sigma")))


def hard_gates(df: DataFrame) -> DataFrame:
    """Shape and extent."""
    tests = {"spread": "spread > -0.002e0", "fwhm": "fwhm > 2 AND fwhm < 7", "elong": "elong < 1.3e0", "dx": "abs(dx-dy) < 2 AND dx > 1 AND dy > 1"}
    for column, test in tests.items():
        if column in df.columns:
            df = df.where(test)
    return df


def reasons(df: DataFrame, tests: dict[str, str], sep: str = "|") -> DataFrame:
    """All reasons of each row as one text, in the order given."""
    marks = [F.when(F.expr(t), F.lit(name)) for name, t in tests.items()]
    return df.withColumn("reasons", F.array_join(F.array_compact(F.array(*marks)), sep))


def reason_counts(df: DataFrame, sep: str = "|") -> DataFrame:
    """Rows by reason; a row counts in each of its own."""
    r = df.where("reasons <> ''").select(F.explode(F.split("reasons", f"[{sep}]")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"))


def spike_mask(df: DataFrame, bright: DataFrame, key: list[str], radius: float = 90, const: float = 12.4, slope: float = -0.09, offset: float = 15.3, faintest: float = 16) -> DataFrame:
    """Nearest bright star first, then the rules: m <= const or m < slope * d + offset rejects."""
    stars = bright.where(F.expr(sky.valid_magnitude("rmag")) & (F.col("rmag") <= faintest))
    near = nearest(df.select(*key, "ra", "dec"), stars.select("id", "ra", "dec", "rmag"), radius, key, "id", spread="right").select(*key, F.col("r_id").alias("star_id"), F.col("r_rmag").alias("star_mag"), F.col("sep_arcsec").alias("star_sep"))
    hit = (F.col("star_mag") <= const) | (F.col("star_mag") < slope * F.col("star_sep") + offset)
    return df.join(near, key, "left").withColumn("spike", F.coalesce(hit, F.lit(False)))


def every_nth(df: DataFrame, order: str, step: int) -> DataFrame:
    """the first row in order of a unique column, and every step-th after it."""
    return running(df, [order], {"_n": F.lit(1)}).where((F.col("_n") - 1) % step == 0).drop("_n")
