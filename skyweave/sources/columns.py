"""Position and id columns of tables that spell them differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: spellings in order of preference; callers that prefer another order pass their own
POSITIONS = (
    ("RA_corr", "Dec_corr"),
    ("ALPHAWIN_J2000", "DELTAWIN_J2000"),
    ("ALPHA_J2000", "DELTA_J2000"),
    ("X_WORLD", "Y_WORLD"),
    ("ra", "dec"),
    ("RA", "DEC"),
    ("RAJ2000", "DEJ2000"),
    ("RA_ICRS", "DE_ICRS"),
)
IDS = ("NUMBER", "number", "object_id", "objectnumber", "objID")


def placed(df: DataFrame, positions: Sequence[tuple[str, str]] = POSITIONS) -> DataFrame:
    """df with double ra and dec from the first pair of columns that it has, instead of columns of these names.

    Names count by case. A table without any pair raises ValueError, as a silent drop would pass for a veto.
    """
    found = [p for p in positions if set(p) <= set(df.columns)]
    if not found:
        raise ValueError(f"no position columns among {df.columns}")
    own = [F.col(c).cast("double").alias(to) for c, to in zip(found[0], ("ra", "dec"), strict=True)]
    return df.select(*own, *(c for c in df.columns if c.lower() not in ("ra", "dec")))


def id_column(df: DataFrame, ids: Sequence[str] = IDS) -> str | None:
    return next((c for c in ids if c in df.columns), None)
