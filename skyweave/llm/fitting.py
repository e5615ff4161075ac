"""What the two convolutional classifiers share: a bounded labelled sample, pooling with its gradient, Adam, scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import modest_batches, plain, release_memory, text_buffers

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo; a null doc_id is held out with those of `modulus - 1`... it has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


def known_labels(labels: DataFrame, label: str, learnable) -> DataFrame:
    """(doc_id, label) of those that have one label and may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & learnable)
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learnable, deals: int = 2) -> DataFrame:
    """(doc_id, label, text) of all documents that `labelled_sample` draws from, and of longer ones; written by deals of
    documents, as their texts are shuffled."""
    from .common import written  # not above: this module goes to the workers whole

    known, out = known_labels(labels, label, learnable), None
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(deals))
    for k in range(deals):
        both = plain(docs).where(learnable & (deal == k)).join(known.where(deal == k), "doc_id").groupBy("doc_id", "label")
        one = written(both.agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")))
        out = one if out is None else out.union(one)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable, rows: int, longest: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most `rows` labelled documents, by a hash of their id, none longer than `longest` bytes.

    Rows without a label, with two different ones, or whose learnable condition fails take no part. The draw is among the
    documents given, so that labels of others take no places; of rows that share an id one stands for all.
    """
    known = known_labels(labels, label, learnable)
    short = plain(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    chosen = known.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(rows)
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    got = sorted((r.doc_id, r.text or "", r.label) for r in found.collect())
    return [x[1].encode() for x in got], np.array([x[2] for x in got], np.float32)


def pooled(z: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of rows the largest value of each column, and the row that has it."""
    top = np.maximum.reduceat(z, starts, axis=0)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(z))))
    row, column = np.nonzero(z == top[owner])
    at = np.zeros(top.shape, np.int64)
    at[owner[row[::-1]], column[::-1]] = row[::-1]
    return top, at


def batches(rng: np.random.Generator, n: int, size: int, steps: int):
    """Row numbers of `steps` batches, by shuffled passes over all n rows: as much work for any number of labels."""
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        while len(order) < size:
            order = np.append(order, rng.permutation(n))
        yield order[:size]
        order = order[size:]


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def joined_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def scored(docs: DataFrame, score, modulus: int, held: int, run: int = 256 << 10, carried: tuple[str, ...] = ()) -> DataFrame:
    """score(bytes, bounds) -> probabilities of a run of whole texts; contract columns of the result, and of each row
    the text and the columns `carried` if any are."""
    modest_batches(docs.sparkSession)
    more = [c for c in carried if c not in ("doc_id", "text")]
    kept = ["text", *more] if carried else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    rows = rows.select("doc_id", (remainder(modulus) == held).alias("held_out"), "text", *more)
    schema = StructType([*StructType.fromDDL(SCORED).fields, *(rows.schema[c] for c in kept)])

    def apply(batches):
        for batch in batches:
            for lo, hi, data, bounds in text_buffers(batch.column(2), run):
                p = score(data, bounds).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(batch.column(2 + k).slice(lo, hi - lo) for k in range(len(kept)))], ["doc_id", "held_out", "score", "predicted", *kept])
        release_memory()

    return rows.mapInArrow(apply, schema)
