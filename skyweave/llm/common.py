"""What the operators of this subpackage share: reading tables, tables in the shared folder, flat byte buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.sources.shared import passing, settled, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give freed memory of a task back to the system, as Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


BATCH_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session (fewer stay fewer): a batch of texts is
    held several times over, in the JVM's buffers and in the worker."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def text_buffers(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of whole values of about `limit` bytes (one value at least).

    Yields (first row, past the last row, the run's bytes, its row bounds); a null is an empty value.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for e, s, k in zip(ends, sizes, kinds, strict=True)]


def joined(column: pa.ChunkedArray, *kinds: str) -> list[np.ndarray]:
    parts = [unsqueeze(x, *kinds) for x in column.to_pylist()]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k in range(len(kinds))]


def runs_of(keys: np.ndarray):
    """Order by key (stable), and (key, from, to) of each run in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    if not len(k):
        return order, []
    edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return order, [(int(k[a]), a, b) for a, b in zip(edges, np.append(edges[1:], len(k)), strict=True)]


NO_ID = -(1 << 62)


def doc_key():
    """doc_id, or what stands for a null one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def packed(docs: DataFrame, parts: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Documents (doc_id, text) dealt by a hash of doc_id: (part, blob of ids, sizes and bytes), some MB at a time; with
    carried columns also a blob of these (more)."""

    def pack(batches):
        for batch in batches:
            for lo, hi, data, bounds in text_buffers(batch.column(2), 32 << 20):
                part, ids = (batch.column(k).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for k in (0, 1))
                order, runs = runs_of(part)
                blobs = [squeeze(ids[order[a:b]], np.diff(bounds)[order[a:b]], np.concatenate([data[bounds[i] : bounds[i + 1]] for i in order[a:b]])) for _, a, b in runs]
                columns = [pa.array([r[0] for r in runs], pa.int32()), pa.array(blobs, pa.binary())]
                if carried:
                    more = batch.slice(lo, hi - lo).select(batch.schema.names[3:])
                    columns.append(pa.array([_rows_out(more.take(pa.array(order[a:b]))) for _, a, b in runs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    names = ["part", "blob", "more"][: 3 if carried else 2]
    # positions, not names, tell the columns apart: one that is carried may be called as one of the first
    columns = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carried)]
    return docs.select(part_of(parts).alias("part"), doc_key().alias("doc_id"), "text", *columns).mapInArrow(pack, "part int, blob binary" + ", more binary" * bool(carried))


def _rows_out(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as to:
        to.write_batch(rows)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def rows_in(column: pa.ChunkedArray) -> pa.Table:
    """The carried columns of a part's documents, in the order in which its blobs hold them."""
    return pa.concat_tables(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in column.to_pylist())


def unpacked(column: pa.ChunkedArray, limit: int):
    """A part's documents in order of (id, bytes), whatever order they came in: runs of (ids, bytes, bounds, places in
    the blobs)."""
    rows = []
    for blob in column.to_pylist():
        ids, sizes, data = unsqueeze(blob, "<i8", "<i8", "u1")
        ends = np.cumsum(sizes)
        rows += [(i, data[e - s : e].tobytes(), k) for k, (i, s, e) in enumerate(zip(ids.tolist(), sizes, ends, strict=True), len(rows))]
    rows.sort()
    texts = pa.array([x[1] for x in rows], pa.large_binary())
    ids, places = (np.array([x[k] for x in rows], np.int64) for k in (0, 2))
    for lo, hi, data, bounds in text_buffers(texts, limit):
        yield ids[lo:hi], data, bounds, places[lo:hi]


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
