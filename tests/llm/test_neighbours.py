"""Recall of collision counting well above the number of vectors that are verified anyway, and its defined cases."""

import numpy as np
import pytest

from skyweave.llm import neighbours

KIND = "vec_id long, embedding array<double>, label string"


def brute(x, ids, q, top=20):
    """Places of the nearest by (score, id) of every row but the query's own."""
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    return ids[np.lexsort((ids, -s))[:top]]


@pytest.mark.parametrize("lengths", ["equal", "one long", "lognormal", "normal"])
def test_recall(lengths):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6 * neighbours.ENOUGH, 64))
    if lengths != "normal":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "one long":
        x[7] *= 5
    if lengths == "lognormal":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    ids, q = rng.permutation(len(x)), np.arange(0, len(x), 600)
    query, vec, score = neighbours.search_shard(x, ids, x[q], ids[q], 20)
    recall = [len(set(brute(x, ids, k).tolist()) & set(vec[query == ids[k]].tolist())) / 20 for k in q]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.8
    at = {i: k for k, i in enumerate(ids.tolist())}
    assert all(abs(x[at[a]] @ x[at[b]] - s) < 1e-9 for a, b, s in zip(query.tolist(), vec.tolist(), score.tolist()))


def test_a_band_is_left_out_only_if_it_cannot_reach():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::2] *= 0.01
    ids = np.arange(300)
    query, vec, _ = neighbours.search_shard(x, ids, x[:10], ids[:10], 5)
    for k in range(10):
        assert vec[query == k].tolist() == brute(x, ids, k, 5).tolist()


def test_doubles_ties_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], "q"), (20, [0.9, 0.1], "q"), (40, [0.0, 0.0], "zero"), (60, [1.0], "short"), (80, None, "null"), (100, [1.0, float("nan")], "nan")]
    rows += [(k, [0.5, k / 100], "r") for k in range(1, 10)] + [(11, [0.900000000001, 0.0], "d"), (12, [0.9, 0.0], "d"), (13, [0.7, 0.7], "t"), (14, [0.7, 0.7], "t"), (15, [0.7, 0.7], "t"), (15, [0.7, 0.7], "t")]
    got = neighbours.nearest(spark.createDataFrame(rows, KIND), top=8).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert [m[1] for m in mine] == [11, 12, 20, 13, 14, 15, 15, 1] and mine[0][2] == 0.900000000001 and mine[1][2] == 0.9
    assert {r.query_id for r in got} == {0, 20}  # the short one has nothing of its length


def test_floats_give_their_exact_products(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for r in neighbours.nearest(df).collect():
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), rel=1e-14)
