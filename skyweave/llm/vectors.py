"""What the two vector operators share: valid vectors, random rotations, arrays from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def valid() -> Column:
    """Not null or empty, without null or non-finite components, not all zero; with an id."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def vectors(embeddings: DataFrame) -> DataFrame:
    """Ids and components, as they are (float) or else in double precision."""
    kind = embeddings.schema["embedding"].dataType
    to = "array<float>" if isinstance(getattr(kind, "elementType", None), FloatType) else "array<double>"
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(to).alias("embedding"))


def matrix(column, dim: int) -> np.ndarray:
    """A list column of `dim` floats or doubles each as an array (n, dim)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))
