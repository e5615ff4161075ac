"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding; learned filters look at overlapping windows (WIDTH bytes, every STRIDE bytes, and
one at the very end) of the whole document; each filter is max-pooled over chunks of windows, and the largest and the
mean of the chunk maxima are combined into one probability. The fit uses at most SAMPLE labelled documents of at most
LONGEST bytes (a documented bound); scoring reads every byte of every document.

Null text is scored as empty text (one window of zeros). Without labels of both kinds the score is the share of label
1 (0.5 with none). Repeated rows get equal scores; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import fitting

WIDTH, STRIDE, CHUNK = 16, 4, 64
EMBED, FILTERS = 8, 24
SAMPLE, LONGEST = 1500, 16 << 10
STEPS, BATCH, RATE = 360, 16, 0.006
MODULUS, HELD = 3, 1


def _windows(data: np.ndarray, bounds: np.ndarray):
    """Starts of the windows of all values in a buffer with padding, where chunks start, chunks of each value."""
    size = np.maximum(np.diff(bounds), WIDTH)
    ends = np.cumsum(size)
    begin = ends - size
    if len(data) == ends[-1]:
        flat = data
    else:
        flat = np.zeros(ends[-1], np.uint8)
        flat[np.arange(len(data)) + np.repeat(begin - bounds[:-1], np.diff(bounds))] = data
    count = -(-(size - WIDTH) // STRIDE) + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * STRIDE, np.repeat(size - WIDTH, count)) + np.repeat(begin, count)
    return flat, start, np.flatnonzero(step % CHUNK == 0), -(-count // CHUNK)


def _forward(model, data, bounds):
    flat, start, chunk, chunks = _windows(data, bounds)
    e = model["bytes"][flat]
    x = np.lib.stride_tricks.as_strided(e, (len(flat) - WIDTH + 1, WIDTH * EMBED), (e.strides[0], e.itemsize))
    return flat, start, chunk, chunks, x


def _combine(top, chunks, model):
    """Chunk maxima to logits: largest and mean of each document."""
    top = np.maximum(top, 0)
    at = np.cumsum(chunks) - chunks
    features = np.hstack([np.maximum.reduceat(top, at, axis=0), np.add.reduceat(top, at, axis=0) / chunks[:, None]])
    return features, features @ model["out"] + model["bias"]


def probabilities(model: dict, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of whole texts in a buffer; a long one is scored piece by piece of its chunks."""
    if "prior" in model:
        return np.full(len(bounds) - 1, model["prior"])
    _, start, chunk, chunks, x = _forward(model, data, bounds)
    tops, piece = [], 256
    for k in range(0, len(chunk), piece):
        lo = chunk[k]
        hi = chunk[k + piece] if k + piece < len(chunk) else len(start)
        z = x[start[lo:hi]] @ model["filters"] + model["shift"]
        tops.append(np.maximum.reduceat(z, chunk[k : k + piece] - lo, axis=0))
    return fitting.sigmoid(_combine(np.concatenate(tops), chunks, model)[1])


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7) -> dict:
    if len(set(y.tolist())) < 2:
        return {"prior": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    f32 = lambda x: x.astype(np.float32)
    model = {
        "bytes": f32(rng.normal(0, 0.5, (256, EMBED))),
        "filters": f32(rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS))),
        "shift": np.zeros(FILTERS, np.float32),
        "out": f32(rng.normal(0, 0.1, 2 * FILTERS)),
        "bias": np.zeros(1, np.float32),
    }
    adam = fitting.Adam(model, RATE)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for step, rows in enumerate(fitting.batches(rng, len(texts), BATCH, STEPS)):
        adam.rate = RATE * (1 - step / STEPS)
        data, bounds = fitting.joined_texts([texts[i] for i in rows])
        flat, start, chunk, chunks, x = _forward(model, data, bounds)
        z = x[start] @ model["filters"] + model["shift"]
        top, best = fitting.pooled(z, chunk)
        features, logit = _combine(top, chunks, model)
        d = f32((fitting.sigmoid(logit) - y[rows]) * weight[rows] / len(rows))
        df = d[:, None] * model["out"]
        doc = np.repeat(np.arange(len(rows)), chunks)
        is_top = np.maximum(top, 0) >= features[doc, :FILTERS]
        dt = (df[doc, :FILTERS] * is_top + df[doc, FILTERS:] / chunks[doc][:, None]) * (top > 0)
        c, f = np.nonzero(dt)
        g, place = dt[c, f], start[best[c, f]]
        order_f = np.argsort(f, kind="stable")
        c, f, g, place = c[order_f], f[order_f], g[order_f], place[order_f]
        df_w, d_bytes = np.zeros_like(model["filters"]), np.zeros_like(model["bytes"])
        for k in np.unique(f):
            m = f == k
            df_w[:, k] = g[m] @ x[place[m]]
        taps = flat[place[:, None] + np.arange(WIDTH)]
        np.add.at(d_bytes, taps, (g[:, None] * model["filters"][:, f].T).reshape(len(f), WIDTH, EMBED))
        adam.update({"bytes": d_bytes, "filters": df_w, "shift": np.bincount(f, g, FILTERS).astype(np.float32), "out": features.T @ d, "bias": d.sum(keepdims=True)})
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    texts, y = fitting.labelled_sample(docs, labels, "quality", fitting.remainder(MODULUS) != HELD, SAMPLE, LONGEST)
    return fit(texts, y)


def quality_scores(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; with its text and other columns if `carried` names them."""
    model = train(docs, labels)
    return fitting.scored(docs, lambda data, bounds: probabilities(model, data, bounds), MODULUS, HELD, carried=carried)
