"""The pipeline on null and repeated ids against a brute-force one."""

import collections
import random
import zlib

import numpy as np

from skyweave.llm import fitting, packing, quality_cnn, toxicity_cnn


def _cut(earlier, text):
    """text without its 50-byte strings that earlier texts have."""
    known = {t[p : p + 50] for t in earlier for p in range(len(t) - 49)}
    gone = [False] * len(text)
    for p in range(len(text) - 49):
        if text[p : p + 50] in known:
            gone[p : p + 50] = [True] * 50
    return "".join(c for c, g in zip(text, gone) if not g)


def _judge(word, sure):
    def scores(docs, labels, **more):
        def score(data, bounds):
            return np.array([sure if word in data[a:b].tobytes() else 0.0 for a, b in zip(bounds[:-1], bounds[1:])])

        return fitting.scored(docs, score, 3, 1, **more)

    return scores


def test_run_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(quality_cnn, "quality_scores", _judge(b"good", 1.0))
    monkeypatch.setattr(toxicity_cnn, "toxicity_scores", _judge(b"venom", 1.0))
    random.seed(3)
    new = lambda *more: " ".join([*("".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(100)), *more])
    a, b, c, d, f, h, k, g = (new("good") for _ in range(8))
    near = lambda t, w: t.replace(t.split()[50], w)
    passage = c[100:250]
    rows = [(None, a), (None, b), (5, c), (5, new("good", "venom")), (5, new()), (6, f), (7, near(f, "other")), (None, near(f, "another")), (6, h)]
    rows += [(9, k), (9, k), (8, g[:300] + passage + g[300:]), (None, new("venom", "good")), (None, new())]
    want = [(None, a), (None, b), (5, c), (6, f), (6, h), (9, k), (8, _cut([c], g[:300] + passage + g[300:]))]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.defaultdict(int)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = packing.encode([t for _, t in want], packing.default_tokenizer())
    assert sum(p.length for p in pieces) == sum(map(len, ids)) < packing.SEQUENCE
    for p in pieces:
        got[p.doc_id, p.doc_tokens, p.ids_crc32] += 1
    assert got == collections.Counter((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for (i, _), x in zip(want, ids))


def test_repeats_are_cut_without_a_second_shuffle_of_the_texts(spark):
    import corpus_pipeline

    random.seed(5)
    a, b = (" ".join("".join(random.choices("abcdefghé", k=6)) for _ in range(60)) for _ in range(2))
    rows = [(3, a, "en", None, 1), (4, "x" + a[100:260] + b, None, "s", 2), (4, b[:20], "de", "t", 3), (5, None, "fr", "u", 4), (5, "", "it", "v", 5), (None, a, "en", "w", 6), (None, b + "é", "nl", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    # without an id in order of the texts' hashes, after all others
    left = {r.source: r for r in out.collect()}
    cut = _cut([a], rows[1][1])
    assert left.keys() == {None, "s", "t", "u", "v", "y"}
    assert tuple(left[None]) == (3, a, "en", None, len(a)) and tuple(left["s"]) == (4, cut, None, "s", len(cut))
    assert tuple(left["t"]) == (4, b[:20], "de", "t", 20) and tuple(left["u"]) == (5, None, "fr", "u", 0) and tuple(left["v"]) == (5, "", "it", "v", 0)
    assert (left["y"].doc_id, left["y"].lang, left["y"].text) == (None, "nl", "é") and left["y"].n_chars == 1
