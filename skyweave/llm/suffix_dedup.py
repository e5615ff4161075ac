"""Suffix-array de-duplication: bytes of 50-byte strings that also start in a document with a smaller id go.

A full suffix array of the corpus is many times the corpus. This one is sparse and still exact: of the suffixes
that start inside a 50-byte window only one, the window's *anchor*, is kept. The anchor is the place of the smallest
hash among the window's 16-byte grams (leftmost on ties), so it depends on the window's bytes alone: equal windows
have equal anchors at equal offsets, and one anchor stands for about 17 neighbouring windows.

Jobs (documents are dealt by a hash of doc_id into parts; a part is sorted, so that a rerun sees the same rows):

1. 48-bit fingerprints of all anchors meet in buckets; those met once are out (`_repeated`). A part sends a
   fingerprint twice at most, so a passage in a third of all documents weighs no more than the number of parts.
2. Each part sends the suffixes of the others, with what stands before them in their windows, once for each distinct
   text (with the smallest and largest doc_id), to the bucket of their leading bytes; the bucket bounds are splitters
   from a sample (`_send`).
3. A bucket sorts suffixes by multikey quicksort, compares neighbours, and finds the smallest doc_id of each window
   (`_settle`). All suffixes with the same 16 leading bytes are in one bucket, with a row for each part and text at
   most: bounds are distinct whole keys, so two equal windows are never on two sides of one.
4. Each part gets the verdicts on the texts it sent and removes what is covered (`_apply`).

Null text counts as empty; repeated rows with one doc_id are each compared with smaller ids only; a null doc_id is
neither smaller nor larger than any: such rows lose nothing and take nothing from others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, joined, mix64, modest_batches, packed, part_of, partitions, plain, release_memory, rows_in, runs_of, squeeze, text_buffers, text_bytes, unpacked, unsqueeze, written

WINDOW, GRAM = 50, 16
SIDE = WINDOW - GRAM
WIDTH = SIDE + GRAM + SIDE
PART_BYTES, SAMPLE_SUFFIXES = 4 << 20, 200_000
BLOCK = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _anchors(data: np.ndarray, bounds: np.ndarray):
    """Anchors of all windows inside the values of one buffer: place, first and last window start, gram hash."""
    out = []
    size, span = len(data), SIDE + 1
    pad = np.zeros(size + 16, np.uint8)
    pad[:size] = data
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    for at in range(0, max(size - WINDOW + 1, 0), BLOCK):
        n = min(BLOCK, size - WINDOW + 1 - at)  # windows that start here
        m = n + SIDE  # their grams
        h = np.ndarray((m,), "<u8", pad, at, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += np.ndarray((m,), "<u8", pad, at + 8, (1,))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            best = np.minimum(best[:-w], best[w:])
            w *= 2
        if w < span:
            best = np.minimum(best[: len(best) - (span - w)], best[span - w :])
        start = np.arange(at, at + n)
        inside = start + WINDOW <= owner_end[at : at + n]
        start, place = start[inside], (best[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        out.append((place[first] + at, start[first], start[last], mix64(h[place[first]])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _contexts(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray):
    """What an anchor's windows cover, aligned at the anchor and zero elsewhere; bytes before it, bytes from it."""
    pad = np.zeros(len(data) + 2 * WIDTH, np.uint8)
    pad[WIDTH : WIDTH + len(data)] = data
    rows = np.lib.stride_tricks.as_strided(pad[WIDTH - SIDE :], (len(data) + 1, WIDTH), (1, 1))[place]
    before, after = place - first, last + WINDOW - place
    column = np.arange(WIDTH)
    rows[(column < (SIDE - before)[:, None]) | (column >= (SIDE + after)[:, None])] = 0
    return rows, before.astype(np.uint8), after.astype(np.uint8)


def _digest(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hash of a context with its extent."""
    words = np.zeros((len(rows), 88), np.uint8)
    words[:, :WIDTH] = rows
    words[:, 86], words[:, 87] = before, after
    words = words.view("<u8")
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h ^ words[:, k]) + np.uint64(k + 1)
    return h


def _kept_twice(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each twice at most."""
    keys = np.sort(keys)
    return np.concatenate([keys[:2], keys[2:][keys[2:] != keys[:-2]]])


def _fingerprints(buckets: int):
    """(bucket, blob of part and 48-bit fingerprint) of all anchors, by bytes of equal rank."""

    def send(batches):
        for batch in batches:
            found = []
            parts_of = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in text_buffers(batch.column(1), BLOCK):
                place, _, _, gram = _anchors(data, bounds)
                part = parts_of[lo:hi][np.searchsorted(bounds, place, "right") - 1]
                found.append((part.astype(np.uint64) << np.uint64(48)) | (gram >> np.uint64(16)))
            keys = _kept_twice(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            if not len(keys):
                continue
            low = keys & np.uint64(0xFFFFFFFFFFFF)
            order, runs = runs_of((low * np.uint64(buckets) // np.uint64(1 << 48) if buckets < 1 << 15 else low % np.uint64(buckets)).astype(np.int64))
            blobs = []
            for _, a, b in runs:
                k = keys[order[a:b]]
                blobs.append(squeeze((k >> np.uint64(48)).astype("<u2"), np.ascontiguousarray(k.astype("<u8").view("u1").reshape(-1, 8)[:, :6].T)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return send


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket's fingerprints those met twice, for each part that sent them."""
    got = []
    for blob in table.column("blob").to_pylist():
        part, planes = unsqueeze(blob, "<u2", "u1")
        low = np.zeros((len(part), 8), np.uint8)
        low[:, :6] = planes.reshape(6, -1).T
        got.append((part.astype(np.uint64), low.view("<u8").ravel()))
    part, low = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(low, kind="stable")
    k = low[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    keys = np.unique((part[order[twice]] << np.uint64(48)) | k[twice])
    part = (keys >> np.uint64(48)).astype(np.int64)
    _, runs = runs_of(part)
    blobs = [squeeze(np.diff(keys[a:b] & np.uint64(0xFFFFFFFFFFFF), prepend=np.uint64(0)).astype("<u8")) for _, a, b in runs]
    return pa.table({"part": pa.array([r[0] for r in runs], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _leading(rows: np.ndarray) -> np.ndarray:
    """The 16 bytes from the anchor on."""
    return np.ascontiguousarray(rows[:, SIDE : SIDE + GRAM]).view(f"S{GRAM}").ravel()


def _send(splitters: np.ndarray):
    """A part's repeated suffixes, each distinct text once with its smallest and largest id, by bucket of leading bytes."""

    def send(key, documents: pa.Table, flags: pa.Table) -> pa.Table:
        known = [np.cumsum(unsqueeze(x, "<u8")[0], dtype=np.uint64) for x in flags.column("blob").to_pylist()]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        got = []
        for ids, data, bounds, _ in unpacked(documents.column("blob"), BLOCK) if len(known) else ():
            place, first, last, gram = _anchors(data, bounds)
            low = gram >> np.uint64(16)
            hit = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
            place, first, last = place[hit], first[hit], last[hit]
            rows, before, after = _contexts(data, place, first, last)
            ids = ids[np.searchsorted(bounds, place, "right") - 1]
            digest = _digest(rows, before, after)
            uniq, at, back = np.unique(digest, return_index=True, return_inverse=True)
            small = np.full(len(uniq), np.iinfo(np.int64).max)
            large = np.full(len(uniq), np.iinfo(np.int64).min)
            np.minimum.at(small, back, ids)
            np.maximum.at(large, back, ids)
            got.append((uniq, rows[at], before[at], after[at], small, large))
        names = ["bucket", "part", "blob"]
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        if not got:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        digest, rows, before, after, small, large = (np.concatenate(x) for x in zip(*got, strict=True))
        _, at, back = np.unique(digest, return_index=True, return_inverse=True)
        low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
        np.minimum.at(low, back, small)
        np.maximum.at(high, back, large)
        rows, before, after = rows[at], before[at], after[at]
        order, runs = runs_of(np.searchsorted(splitters, _leading(rows), "right").astype(np.int64))
        blobs = []
        for _, a, b in runs:
            o = order[a:b]
            blobs.append(squeeze(rows[o], before[o], after[o], low[o], high[o]))
        return pa.Table.from_arrays([pa.array([r[0] for r in runs], kinds[0]), pa.array([key[0].as_py()] * len(runs), kinds[1]), pa.array(blobs, kinds[2])], names)

    return send


def multikey_order(word, n: int, depth: int, leaf: int = 8192) -> np.ndarray:
    """Order of n strings by multikey quicksort over 8-byte big-endian words.

    word(k, rows) gives word k of these rows as uint64. A segment is parted around a pivot word into less, equal and
    greater; the equal ones go on with the next word; small segments are finished by numpy's own sort of the rest.
    """
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k >= depth:
            continue
        seg = order[lo:hi]
        w = word(k, seg)
        if hi - lo <= leaf:
            o = np.argsort(w, kind="stable")
            seg, w = seg[o], w[o]
            order[lo:hi] = seg
            if k + 1 < depth:
                tied = np.zeros(len(w) + 1, bool)
                tied[1:-1] = w[1:] == w[:-1]
                t = np.flatnonzero(tied[1:] | tied[:-1])
                if len(t):
                    rest = [word(j, seg[t]) for j in range(depth - 1, k, -1)]
                    order[lo + t] = seg[t][np.lexsort([*rest, w[t]])]
            continue
        few = np.sort(w[:: max(1, len(w) // 255)])
        pivot = few[len(few) // 2]
        less, equal = w < pivot, w == pivot
        a, b, c = seg[less], seg[equal], seg[~(less | equal)]
        order[lo:hi] = np.concatenate([a, b, c])
        todo += [(lo, lo + len(a), k), (lo + len(a), lo + len(a) + len(b), k + 1), (lo + len(a) + len(b), hi, k)]
    return order


def _groups(words, order: np.ndarray, depth: int) -> np.ndarray:
    """Where in the order a new string starts."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in range(depth):
            w = words(k, order)
            new[1:] |= w[1:] != w[:-1]
    return new


def _settle(table: pa.Table) -> pa.Table:
    """Of a bucket's windows the smallest id; (part, blob of digest, window range, id) where a larger id sent it."""
    part, rows, before, after, low, high = [], [], [], [], [], []
    for p, blob in zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True):
        r, b, a, lo, hi = unsqueeze(blob, "u1", "u1", "u1", "<i8", "<i8")
        part.append(np.full(len(b), p))
        for to, x in ((rows, r.reshape(-1, WIDTH)), (before, b), (after, a), (low, lo), (high, hi)):
            to.append(x)
    part, rows, before, after, low, high = map(np.concatenate, (part, rows, before, after, low, high))
    digest = _digest(rows, before, after)
    _, at, text = np.unique(digest, return_index=True, return_inverse=True)  # distinct texts over all parts
    n = len(at)
    small, large = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(small, text, low)
    np.maximum.at(large, text, high)
    rows, before, after = rows[at], before[at].astype(np.int64), after[at].astype(np.int64)

    lead = np.ascontiguousarray(rows[:, SIDE : SIDE + GRAM]).view(">u8").astype(np.uint64)
    words = lambda k, o: lead[o, k]
    order = multikey_order(words, n, 2)
    start = np.flatnonzero(_groups(words, order, 2))
    size = np.diff(np.append(start, n))
    shared = np.repeat(np.minimum.reduceat(small[order], start) < np.maximum.reduceat(large[order], start), size)
    alone = np.repeat(size == 1, size)
    # windows of a text start `before` ... `WINDOW - after` bytes before its anchor
    least = WINDOW - after
    one = order[shared & alone]
    segments = [(one, least[one], before[one], small[one])]
    many = order[shared & ~alone]
    count = (before - least + 1)[many]
    owner = np.repeat(many, count)
    back = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least[many], count)
    padded = np.zeros((len(rows), WIDTH + 8), np.uint8)
    padded[:, :WIDTH] = rows
    flat, origin = padded.ravel(), owner * (WIDTH + 8) + SIDE - back
    at8 = np.ndarray((flat.size - 7,), ">u8", flat, 0, (1,))

    def window(k, o, at8=at8, origin=origin):
        w = at8[origin[o] + 8 * k].astype(np.uint64)
        return w if k < WINDOW // 8 else w >> np.uint64(64 - 8 * (WINDOW % 8))

    depth = WINDOW // 8 + 1
    order = multikey_order(window, len(owner), depth)
    if len(order):
        start = np.flatnonzero(_groups(window, order, depth))
        least_id = np.repeat(np.minimum.reduceat(small[owner[order]], start), np.diff(np.append(start, len(order))))
        best = np.empty(len(owner), np.int64)
        best[order] = least_id
        edge = np.ones(len(owner), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])
        e = np.flatnonzero(edge)
        segments.append((owner[e], back[e], back[np.append(e[1:], len(owner)) - 1], best[e]))
    owner, from_, to, best = (np.concatenate(x) for x in zip(*segments, strict=True))
    keep = best < large[owner]
    owner, from_, to, best = owner[keep], from_[keep], to[keep], best[keep]

    # to each part that sent the text with a larger id
    by_text = np.argsort(text, kind="stable")
    first = np.searchsorted(text[by_text], np.arange(n + 1))
    count = (first[1:] - first[:-1])[owner]
    seg = np.repeat(np.arange(len(owner)), count)
    row = by_text[np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + first[owner[seg]]]
    keep = best[seg] < high[row]
    seg, row = seg[keep], row[keep]
    order, runs = runs_of(part[row])
    seg, row = seg[order], row[order]
    release_memory()
    blobs = [squeeze(digest[row[a:b]], from_[seg[a:b]].astype("u1"), to[seg[a:b]].astype("u1"), best[seg[a:b]]) for _, a, b in runs]
    return pa.table({"part": pa.array([r[0] for r in runs], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _apply(texts: bool, carried: tuple[str, ...]):
    """Remove what the verdicts cover from a part's documents."""

    def apply(documents: pa.Table, verdicts: pa.Table) -> pa.Table:
        digest, from_, to, best = joined(verdicts.column("blob"), "<u8", "u1", "u1", "<i8")
        order = np.argsort(digest, kind="stable")
        digest, from_, to, best = digest[order], from_[order].astype(np.int64), to[order].astype(np.int64), best[order]
        out, places = [[], [], [], [], [], []], []
        for ids, data, bounds, at_blobs in unpacked(documents.column("blob"), BLOCK):
            places.append(at_blobs)
            place, first, last, _ = _anchors(data, bounds)
            change = np.zeros(len(data) + 1, np.int64)
            for at in range(0, len(place) if len(digest) else 0, 1 << 17):
                p, f, z = place[at : at + (1 << 17)], first[at : at + (1 << 17)], last[at : at + (1 << 17)]
                own = _digest(*_contexts(data, p, f, z))
                a, b = np.searchsorted(digest, own), np.searchsorted(digest, own, "right")
                count = b - a
                who = np.repeat(np.arange(len(own)), count)
                seg = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + a[who]
                ok = best[seg] < ids[np.searchsorted(bounds, p[who], "right") - 1]
                who, seg = who[ok], seg[ok]
                np.add.at(change, p[who] - to[seg], 1)
                np.add.at(change, p[who] - from_[seg] + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = bounds[:-1][bounds[:-1] < len(data)]
            rise[inner] = gone[inner]  # a removed run ends with its document
            rises = np.concatenate([[0], np.cumsum(rise)])
            for k in range(len(ids)):
                a, b = bounds[k], bounds[k + 1]
                removed = int(total[b] - total[a])
                left = data[a:b] if not removed else data[a:b][~gone[a:b]]
                for to_list, x in zip(out, (ids[k], b - a, removed, int(rises[b] - rises[a]), hashlib.sha256(left.tobytes()).hexdigest(), (_whole(left) if removed else left.tobytes()) if texts else None), strict=True):
                    to_list.append(x)
        columns = [pa.array(np.array(out[0], np.int64)), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        release_memory()
        if texts:
            columns.append(pa.array(out[5], pa.binary()).view(pa.string()))
            names.append("kept")
        if carried:
            columns += rows_in(documents.column("more")).take(pa.array(np.concatenate(places))).columns
            names += carried
        return pa.Table.from_arrays(columns, names)

    return apply


def _whole(left: np.ndarray) -> bytes:
    """Bytes without the rests of characters that were cut in two."""
    return left.tobytes().decode("utf-8", "ignore").encode()


def _sample(docs: DataFrame, total: int) -> np.ndarray:
    """Leading bytes of about SAMPLE_SUFFIXES anchors of documents chosen by a hash of their id, sorted."""
    share = min(1.0, SAMPLE_SUFFIXES * 17 / max(total, 1))

    def lead(batches):
        for batch in batches:
            for _, _, data, bounds in text_buffers(batch.column(1), BLOCK):
                place = _anchors(data, bounds)[0]
                if len(place):
                    rows = np.lib.stride_tricks.as_strided(data, (len(data) - GRAM + 1, GRAM), (1, 1))[place]
                    yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["lead"])

    chosen = docs.where(F.pmod(F.xxhash64(doc_key()), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    blobs = [r[0] for r in chosen.mapInArrow(lead, "lead binary").collect()]
    return np.sort(np.frombuffer(b"".join(bytes(b) for b in blobs), f"S{GRAM}"))


def suffix_dedup(docs: DataFrame, texts: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining text, without the
    rests of characters that were cut in two; and carried columns of the row as they are, which spare a join)."""
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    apart = docs.where("doc_id IS NULL").withColumn("text", F.coalesce("text", F.lit("")))
    apart = apart.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if texts else []), *carried)
    docs = docs.where("doc_id IS NOT NULL")
    total = text_bytes(docs)
    parts = min(65_535, max(2 * partitions(spark), total // PART_BYTES))
    sample = _sample(plain(docs), total)
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1]]) if len(sample) else sample
    dealt = packed(docs, parts)
    flags = docs.select(part_of(parts), "text").mapInArrow(_fingerprints(parts), "bucket long, blob binary").groupBy("bucket").applyInArrow(_repeated, "part int, blob binary")
    sent = dealt.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_send(splitters), "bucket long, part int, blob binary")
    verdicts = written(sent.groupBy("bucket").applyInArrow(_settle, "part int, blob binary"))
    result = ", ".join([RESULT, *(["kept string"] if texts else []), *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)])
    return packed(docs, parts, carried).groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(_apply(texts, carried), result).union(apart)
