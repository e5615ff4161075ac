"""Approximate nearest neighbours by collision counting, for the largest inner product.

Rows are dealt into shards by a hash of their id, and within a shard into bands of like length, longest first. In a band
vectors get one more coordinate that makes their lengths equal to that of the band's longest, so that the largest inner
product is the nearest vector; in bands, one long vector does not push the places of all others together. A band keeps its
rows' places on each of LINES random lines (orthonormal ones, which collide more evenly than independent ones) as a
sorted array, and each row's rank there. A query opens a window around its own place on every line and widens all
windows step by step (virtual rehashing: no table is built anew). A vector inside at least COLLISIONS of the windows is
verified by its exact inner product in double precision; widening ends when enough were verified, in a small band when
all are. A band whose longest vector could not reach what a query has already is left out, as no inner product exceeds
the product of lengths. A shard answers with the nearest of each query, and the answers are merged. Every row is
indexed; measured recall is in the README and the tests.

Components are kept as they are in the table (float, or else double). Vectors that are null, zero, or hold null or
non-finite components take no part; nor does a vector of another length than the query. Ties go to the smaller vec_id.
Rows that repeat the query's id are not candidates; other repeated ids are each a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .vectors import rotation, valid

LINES, COLLISIONS = 64, 54
SHARD, QUERIES = 50_000, 4096
#: A query stops widening once so many vectors of a shard are verified (all above the collision threshold are).
ENOUGH = 2000
WIDEN = 1.2
#: Lengths in a band differ by this factor at most.
BAND = 1.25
SEED = 23


class Band:
    """Rows of like length with their places on all lines."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, lines: np.ndarray):
        self.rows, self.x, self.n = rows, x, len(x)
        squares = np.einsum("ij,ij->i", x, x)
        self.longest = float(squares.max())
        self.ended: list[float] = []
        if self.n <= ENOUGH:
            return  # all are verified
        places = np.hstack([x, np.sqrt(np.maximum(self.longest - squares, 0))[:, None]]) @ lines
        order = np.argsort(places, axis=0, kind="stable")
        self.ranked = np.ascontiguousarray(np.take_along_axis(places, order, axis=0).T)
        self.rank = np.empty((LINES, self.n), np.uint16 if self.n < 1 << 16 else np.uint32)  # where a row stands in each sorted array
        np.put_along_axis(self.rank, order.T, np.broadcast_to(np.arange(self.n, dtype=self.rank.dtype), self.rank.shape), axis=1)
        self.step = 0.05 * max(float(places.std()), 1e-12)

    def candidates(self, centre: np.ndarray, enough: int) -> np.ndarray:
        """Rows of the band with COLLISIONS or more, `enough` of them if there are so many."""
        if self.n <= enough:
            return np.arange(self.n)
        # the first window is a little narrower than what earlier queries needed
        half = 0.9 * float(np.median(self.ended[-64:])) if self.ended else self.step
        span = max(abs(self.ranked[:, 0]).max(), abs(self.ranked[:, -1]).max()) + abs(centre).max() + self.step
        while True:
            count = np.zeros(self.n, np.uint8)
            for r, place, c in zip(self.rank, self.ranked, centre, strict=True):
                lo, hi = place.searchsorted((c - half, c + half))
                count += (r - r.dtype.type(lo)) < r.dtype.type(hi - lo)  # unsigned: below the window wraps around
            found = np.flatnonzero(count >= COLLISIONS)
            if len(found) >= enough or half >= span:
                self.ended.append(half)
                return found
            half *= WIDEN


def search_shard(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, top: int):
    """(query, id, score) of each query's `top` nearest found in one shard, as lists of arrays."""
    dim = x.shape[1]
    lines = np.hstack([rotation(dim + 1, SEED + k) for k in range(-(-LINES // (dim + 1)))])[:, :LINES]
    size, asked = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-size, kind="stable")
    onto = (q / np.maximum(asked, 1e-300)[:, None]) @ lines[:dim]
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
    at = 0
    while at < len(order):
        end = int(np.searchsorted(-size[order], -size[order[at]] / BAND, "right"))
        rows = order[at:end]
        band, at = Band(rows, x[rows], lines), end
        reach = np.sqrt(band.longest) * (1 + 1e-9)
        for p in range(len(q)):
            have, scores = best[p]
            if len(have) >= top and asked[p] * reach < scores[-1]:
                continue
            c = band.candidates(onto[p] * np.sqrt(band.longest), max(ENOUGH, top + 1))
            score = band.x[c] @ q[p]
            c = rows[c]
            keep = ids[c] != q_ids[p]
            have, scores = np.concatenate([have, c[keep]]), np.concatenate([scores, score[keep]])
            first = np.lexsort((ids[have], -scores))[:top]
            best[p] = have[first], scores[first]
    out = ([np.full(len(rows), q_ids[p]) for p, (rows, _) in enumerate(best)], [ids[rows] for rows, _ in best], [s for _, s in best])
    return [np.concatenate(v) if v else np.zeros(0) for v in out]


def _searched(dim: int, top: int):
    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ids = table.column("vec_id").to_numpy()
        query, vec, score = search_shard(x[~asks], ids[~asks], x[asks], ids[asks], top) if asks.any() and not asks.all() else (np.zeros(0),) * 3
        return pa.table({"query_id": pa.array(query.astype(np.int64)), "vec_id": pa.array(vec.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    return search


def nearest(embeddings: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest of each row whose vec_id is divisible by `every`."""
    kind = "float" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "double"
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(valid())
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).collect()
    found = None
    for dim, n, queries in sorted(tuple(r) for r in sizes):
        own = good.where(F.size("embedding") == dim)
        shards, blocks = -(-n // SHARD), max(1, -(-queries // QUERIES))
        of = lambda k, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
        rows = own.select(of(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "embedding")
        asked = own.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), of(blocks, 2).alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
        part = rows.union(asked).groupBy("shard", "block").applyInArrow(_searched(dim, top), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
