import numpy as np
import pytest

from skyweave.llm import fitting, toxicity_cnn


def _rows(n, word="vile"):
    """Documents of common words; toxic ones (every third) hold a word that only they have."""
    rng = np.random.default_rng(n)
    common = [f"w{k}" for k in range(40)]
    return [(k, " ".join([*rng.choice(common, 12), *([word] if k % 3 == 0 else [])])) for k in range(n)], [(k, int(k % 3 == 0)) for k in range(n)]


@pytest.fixture()
def judged(spark, monkeypatch):
    def run(docs, labels, sample, **limits):
        monkeypatch.setattr(toxicity_cnn, "SAMPLE", sample)
        monkeypatch.setattr(toxicity_cnn, "STEPS", 60)
        for k, v in limits.items():
            monkeypatch.setattr(toxicity_cnn, k, v)
        d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        return {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity_cnn.toxicity_scores(d, l).collect()}

    return run


def test_labels_beyond_the_sample_are_learned(judged):
    """The word of the toxic documents is in none of the sample's: these are too long for it."""
    docs, labels = _rows(400)
    docs = [(k, t + " pad" * 300 if "vile" in t else t) for k, t in docs]
    got = judged(docs, labels, 4000, LONGEST=600, PASSES=8, LATER=0.05, SHARD=1 << 16)
    right = [got[k][1] == toxic for k, toxic in labels if got[k][2]]
    assert len(right) > 30 and np.mean(right) > 0.95


def test_every_labelled_document_is_in_a_shard_once_and_runs_agree(spark, judged, monkeypatch):
    docs, labels = _rows(300)
    met = []
    monkeypatch.setattr(toxicity_cnn, "_thresholds", lambda rows, model: met.append(sorted(r.doc_id for r in rows.select("doc_id").collect())) or np.zeros(5))
    a = judged(docs, labels, 50, SHARD=4096)
    b = judged(docs[::-1], labels[::-1], 50, SHARD=4096)
    learnable = spark.createDataFrame(labels, "doc_id long, toxic int").where(fitting.remainder(5) != 0)
    assert met == [sorted(r.doc_id for r in learnable.collect())] * 2
    assert {k: v[0] for k, v in a.items()} == pytest.approx({k: v[0] for k, v in b.items()}, abs=1e-5)


def test_score_of_a_text_is_its_own():
    """Whatever stands beside it in the buffer."""
    texts = [t.encode() for _, t in _rows(60)[0]] + [b"", b"vile", b""]
    model = toxicity_cnn.fit(texts[:40], np.array([k % 3 == 0 for k in range(40)], np.float32))
    score = lambda some: toxicity_cnn.probabilities(model, toxicity_cnn._table(model), *fitting.joined_texts(some))
    assert score(texts) == pytest.approx(score(texts[::-1])[::-1], abs=1e-5)
    assert score(texts) == pytest.approx(np.concatenate([score([t]) for t in texts]), abs=1e-5)


def test_threshold_of_counted_rows_is_that_of_the_rows():
    rng = np.random.default_rng(3)
    logit, y = np.round(rng.normal(0, 2, 500), 1), rng.integers(0, 2, 500)
    y = np.where(logit > 1, 1, np.where(logit < -1, 0, y))
    keys, n = np.unique(np.c_[logit, y], axis=0, return_counts=True)
    wrong = lambda t: ((logit >= t) != y).sum()
    assert wrong(toxicity_cnn._threshold(keys[:, 0], keys[:, 1].astype(np.int64), n)) <= min(wrong(t) for t in np.arange(-3, 3, 0.05)) + 2
