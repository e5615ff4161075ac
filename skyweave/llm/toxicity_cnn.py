"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of letters, digits and non-ASCII bytes, lower-cased A-Z. A word's embedding is the sum of those that
its hash and the hashes of its first HEADS bytes point to, so that inflected and compound words share one. Filters of
widths 1, 2 and 3 slide over the whole text; their maxima give one logit. Thresholds are calibrated by language: the
language is guessed from the text's own function words, never from a column, and on training rows the logit shift that
makes the fewest mistakes for that language is found; the score is the shifted probability, so that 0.5 is the
threshold of every language. All labelled documents are learned from, in whole: a fit of SAMPLE of them, of at most LONGEST
bytes each, is where the rest begins. If there are more, PASSES passes over all of them follow: documents are dealt to shards
of some SHARD bytes by a hash of their id, a task goes on with the model over its shard, and the models' changes are averaged
by the number of their documents (those of an embedding over the shards that met it). Thresholds are then taken from all of
them, in steps of 1 / FINE of a logit. Scoring reads every word of every document.

Null text and texts without words get the score of no filter firing. Without labels of both kinds the score is the
share of label 1 (0.5 with none). Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting
from .common import passing, squeeze, text_buffers, unsqueeze, written
from .jaccard_join import word_hashes

CELLS, EMBED, FILTERS, WIDTHS, HEADS = 1 << 16, 8, 8, (1, 2, 3), (4, 6)
SAMPLE, LONGEST = 4000, 16 << 10
STEPS, BATCH, RATE = 700, 32, 0.015
#: Passes over all labelled documents, with the rate of the first; bytes of a shard and of a batch in it; blocks of embeddings.
PASSES, LATER, SHARD, MOST, BLOCKS, FINE = 2, 0.003, 8 << 20, 256 << 10, 64, 1000
MODULUS, HELD = 5, 0
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "that", "is", "for", "was", "with", "it"],
    "fr": ["le", "les", "des", "et", "un", "une", "dans", "du", "est", "pas"],
    "de": ["der", "die", "das", "und", "den", "von", "ist", "mit", "nicht", "ein"],
    "es": ["el", "los", "las", "del", "y", "para", "con", "por", "una", "se"],
}


def _languages() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and the language of each (0 to 3)."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    data, bounds = fitting.joined_texts([w.encode() for w in words])
    h, _ = word_hashes(data, bounds, SEPARATOR)
    lang = np.array([[w in ws for ws in FUNCTION_WORDS.values()].index(True) if sum(w in ws for ws in FUNCTION_WORDS.values()) == 1 else 4 for w in words])
    order = np.argsort(h)
    return h[order], lang[order]


def _words(data: np.ndarray, bounds: np.ndarray):
    """Cells (words x 1 + heads) with four empty words after each value, first of each value, guessed language."""
    h, count, *heads = word_hashes(data, bounds, SEPARATOR, HEADS)
    size = count + 4
    first = np.cumsum(size) - size
    cell = np.full((size.sum() + 2, 1 + len(heads)), CELLS, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(h)) + 4 * owner
    for k, x in enumerate([h, *heads]):
        cell[at, k] = (x >> np.uint64(48)).astype(np.int64)
    known, lang = _languages()
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    votes = np.bincount(owner[hit] * 5 + lang[at[hit]], minlength=5 * len(count)).reshape(-1, 5)[:, :4]
    return cell, first, np.where(votes.sum(1) > 0, votes.argmax(1), 4)


def _filters(model: dict) -> np.ndarray:
    """All filters' taps beside each other."""
    return np.hstack([model[f"filters{w}"][k] for w in WIDTHS for k in range(w)])


def _convolved(words: np.ndarray, filters: np.ndarray, shift: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter values at every word but the last two, which are empty; those that reach into the next value never fire."""
    n, y, out, at = len(words) - 2, words @ filters, [], 0
    for w in WIDTHS:
        out.append(sum(y[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(w)))
        at += w * FILTERS
    z, ends = np.hstack(out) + shift, np.append(first[1:], n)
    z[ends - 1] = z[ends - 2] = -np.inf
    return z


def _table(model: dict) -> np.ndarray:
    return np.vstack([model["words"], np.zeros((1, EMBED), np.float32)])


def _logits(model: dict, table: np.ndarray, data, bounds):
    cell, first, lang = _words(data, bounds)
    words = table[cell[:, 0]]
    for k in range(1, cell.shape[1]):
        words += table[cell[:, k]]
    top = np.maximum(np.maximum.reduceat(_convolved(words, _filters(model), model["shift"], first), first, axis=0), 0)
    return top @ model["out"] + model["bias"], lang


def probabilities(model: dict, table, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if "prior" in model:
        return np.full(len(bounds) - 1, model["prior"])
    logit, lang = _logits(model, table, data, bounds)
    return fitting.sigmoid(logit - model["threshold"][lang])


def _threshold(logit: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit between two neighbours that makes the fewest mistakes, nearest to 0 of several; 0 for few rows. n: rows
    that each stands for."""
    n = np.ones(len(y)) if n is None else n.astype(np.float64)
    if n.sum() < 30 or len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(logit)
    s, t, n = logit[order], y[order], n[order]
    cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    wrong = np.concatenate([[0], np.cumsum(n * t)]) + (n * (1 - t)).sum() - np.concatenate([[0], np.cumsum(n * (1 - t))])
    wrong[1:-1][s[1:] == s[:-1]] = np.inf  # equal logits lie on one side
    best = np.flatnonzero(wrong == wrong.min())
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def _begun(rng: np.random.Generator) -> dict:
    f32 = lambda x: x.astype(np.float32)
    total = FILTERS * len(WIDTHS)
    model = {"words": f32(rng.normal(0, 0.02, (CELLS, EMBED))), "shift": np.zeros(total, np.float32), "out": f32(rng.normal(0, 0.3, total)), "bias": np.zeros(1, np.float32)}
    return model | {f"filters{w}": f32(rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))) for w in WIDTHS}


def _weights(y: np.ndarray, share: float) -> np.ndarray:
    return np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5


def _learn(model: dict, adam: fitting.Adam, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> None:
    """One step on a batch."""
    cell, first, _ = _words(*fitting.joined_texts(texts))
    used, place = np.unique(cell, return_inverse=True)
    place = place.reshape(cell.shape)
    words = _table(model)[used][place].sum(1)
    z = _convolved(words, _filters(model), model["shift"], first)
    top, best = fitting.pooled(z, first)
    top = np.maximum(top, 0)
    d = ((fitting.sigmoid(top @ model["out"] + model["bias"]) - y) * weight / len(texts)).astype(np.float32)
    dt = d[:, None] * model["out"] * (top > 0)
    grads = {"shift": dt.sum(0), "out": top.T @ d, "bias": d.sum(keepdims=True)}
    d_words = np.zeros((len(used), EMBED), np.float32)
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        g, b = dt[:, own], best[:, own]
        grads[f"filters{w}"] = np.stack([np.einsum("df,dfe->ef", g, words[b + k]) for k in range(w)])
        for k in range(w):
            part = (g[:, :, None] * model[f"filters{w}"][k].T[None]).reshape(-1, EMBED)
            for c in range(place.shape[1]):
                np.add.at(d_words, place[b + k, c].ravel(), part)
    full = np.zeros_like(model["words"])
    full[used[used < CELLS]] = d_words[used < CELLS]
    adam.update(grads | {"words": full})


def fit(texts: list[bytes], y: np.ndarray, seed: int = 11) -> dict:
    if len(set(y.tolist())) < 2:
        return {"prior": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    model = _begun(rng)
    adam = fitting.Adam(model, RATE)
    weight = _weights(y, y.mean())
    for step, rows in enumerate(fitting.batches(rng, len(texts), BATCH, STEPS)):
        adam.rate = RATE * (1 - step / STEPS)
        _learn(model, adam, [texts[i] for i in rows], y[rows], weight[rows])
    parts = [_logits(model, _table(model), *fitting.joined_texts(texts[k : k + 64])) for k in range(0, len(texts), 64)]
    logit, lang = (np.concatenate(x) for x in zip(*parts, strict=True))
    model["threshold"] = np.array([_threshold(logit[lang == k], y[lang == k]) for k in range(4)] + [0.0])
    return model


def _flat(model: dict) -> np.ndarray:
    """All but the embeddings, in order of name."""
    return np.concatenate([model[k].ravel() for k in sorted(model) if k not in ("words", "threshold")])


def _gone_on(model: dict, share: float, turn: int, turns: int):
    """A shard's documents to the changes that they make to the model: (block, shard, n, blob), block -1 for all but the
    embeddings."""

    def learned(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        shard = table.column("shard")[0].as_py()
        mine = {k: v.copy() for k, v in model.items() if k != "threshold"}
        rng = np.random.default_rng([turn, shard])
        texts, y = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b""), table.column("label").to_numpy().astype(np.float32)
        order = rng.permutation(len(y))
        size = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(y) + 1])[order])
        lo, adam = 0, fitting.Adam(mine, LATER)
        while lo < len(y):
            hi = min(lo + BATCH, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + MOST, "right"))))
            adam.rate = LATER * (1 - (turn + lo / len(y)) / turns)
            rows = order[lo:hi]
            _learn(mine, adam, [texts[int(i)].as_py() for i in rows], y[rows], _weights(y[rows], share))
            lo = hi
        change = np.split(mine["words"] - model["words"], BLOCKS)
        blobs = [squeeze(_flat(mine) - _flat(model)), *(squeeze(x) for x in change)]
        return pa.table({"block": pa.array(range(-1, BLOCKS), pa.int32()), "shard": pa.array([shard] * len(blobs), pa.int64()), "n": pa.array([len(y)] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return learned


def _averaged(table: pa.Table) -> pa.Table:
    """The changes of a block in all shards to one."""
    table = table.combine_chunks().sort_by("shard")
    block, total, met = table.column("block")[0].as_py(), 0.0, 0.0
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True):
        x = unsqueeze(blob, "<f4")[0].astype(np.float64)
        own = np.ones(len(x)) if block < 0 else np.repeat((x.reshape(-1, EMBED) != 0).any(1), EMBED)
        total, met = total + n * x, met + n * own
    change = total / np.maximum(met, 1)
    return pa.table({"block": pa.array([block], pa.int32()), "blob": pa.array([squeeze(change.astype("<f4"))], pa.binary())})


def _passed(rows: DataFrame, model: dict, share: float, turn: int, turns: int) -> dict:
    """The model after one more pass over all rows (shard, doc_id, label, text)."""
    changes = rows.groupBy("shard").applyInArrow(_gone_on(model, share, turn, turns), "block int, shard long, n long, blob binary")
    got = {r.block: unsqueeze(r.blob, "<f4")[0] for r in written(written(changes).groupBy("block").applyInArrow(_averaged, "block int, blob binary")).collect()}
    out, at = {}, 0
    for k in sorted(k for k in model if k not in ("words", "threshold")):
        out[k] = model[k] + got[-1][at : at + model[k].size].reshape(model[k].shape)
        at += model[k].size
    return out | {"words": model["words"] + np.concatenate([got[k] for k in range(BLOCKS)]).reshape(CELLS, EMBED)}


def _thresholds(rows: DataFrame, model: dict) -> np.ndarray:
    """Of each language the threshold that makes the fewest mistakes on all rows."""
    table = _table(model)

    def judged(batches):
        for batch in batches:
            for lo, hi, data, bounds in text_buffers(batch.column(1), MOST):
                logit, lang = _logits(model, table, data, bounds)
                step = np.round(np.clip(logit, -60, 60) * FINE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang.astype(np.int32)), pa.array(step)], ["label", "lang", "step"])

    steps = rows.select("label", "text").mapInArrow(judged, "label int, lang int, step long").groupBy("lang", "step", "label").count().collect()
    lang, step, y, n = (np.array([r[k] for r in steps], np.int64) for k in ("lang", "step", "label", "count"))
    return np.array([_threshold(step[lang == k] / FINE, y[lang == k], n[lang == k]) for k in range(4)] + [0.0])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    learnable = fitting.remainder(MODULUS) != HELD
    texts, y = fitting.labelled_sample(docs, labels, "toxic", learnable, SAMPLE, LONGEST)
    model = fit(texts, y)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if fitting.known_labels(labels, "toxic", learnable).join(ids, "doc_id", "left_semi").count() == len(y):
        return model
    with passing(docs.sparkSession):
        rows = fitting.labelled_rows(docs, labels, "toxic", learnable)
        n, ones, size = rows.agg(F.count("*"), F.sum("label"), F.sum(F.octet_length("text").cast("long"))).first()
        if ones in (0, n):
            return {"prior": ones / n}
        if "prior" in model:
            model = _begun(np.random.default_rng(11))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(1 + (size or 0) // SHARD)))
        for turn in range(PASSES):
            model = _passed(rows, model, ones / n, turn, PASSES)
        return model | {"threshold": _thresholds(rows, model)}


def toxicity_scores(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; with its text and other columns if `carried` names them."""
    model = train(docs, labels)
    table = None if "prior" in model else _table(model)
    return fitting.scored(docs, lambda data, bounds: probabilities(model, table, data, bounds), MODULUS, HELD, carried=carried)
