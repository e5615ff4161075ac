"""Own markers, long units, ids at the edge and double components."""

import random

import numpy as np

from skyweave.llm import embedding_dedup, packing, sentencepiece_codec


def test_markers_of_the_text_itself():
    m = sentencepiece_codec.model_at(sentencepiece_codec.default_model())
    private = "".join(map(chr, range(0xE000, 0xF900)))
    texts = ["▁", "a▁b c▁▁d", "▁ ▁ x", " ▁", "▁" + private, "a b"]
    got = m.encode(texts)
    assert [m.decode(ids) for ids, _ in got] == texts
    own = m.byte_ids[list("▁".encode())].tolist()
    for text, (ids, score) in zip(texts, got):
        parts = [m.encode([p])[0] if k == 0 else None for k, p in enumerate(text.split("▁"))]
        assert sum(ids[k : k + 3].tolist() == own for k in range(len(ids))) == text.count("▁")
        assert parts[0] is not None and ids[: len(parts[0][0])].tolist() == parts[0][0].tolist() and np.isfinite(score)


def test_long_units_are_solved_alike(monkeypatch):
    m = sentencepiece_codec.model_at(sentencepiece_codec.default_model())
    random.seed(4)
    for block in (7, 1 << 16):
        monkeypatch.setattr(sentencepiece_codec, "BLOCK", block)
        for letters in ("ab", "etaoin shrdlu".replace(" ", ""), "aäößé漢字\U0001f600", "▁x"):
            unit = "".join(random.choices(letters, k=400)).encode()
            ids, score = m.solve_long(unit)
            (want, best), = m.solve([unit])
            assert ids == want and score == best
    text = "".join(random.choices("abcdefghij", k=200_000))
    ids, _ = m.encode([text])[0]
    assert m.decode(ids) == text


def test_packing_keeps_every_id(spark):
    rows = [(-(1 << 62), "one two"), (None, "three"), (None, "three"), (None, None), (5, "four"), (5, "four")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, -(1 << 62)), (False, 5), (False, 5), (True, 0), (True, 0), (True, 0)]
    assert sorted(r.offset for r in got) == np.concatenate([[0], np.cumsum([r.length for r in sorted(got, key=lambda r: r.offset)])[:-1]]).tolist()


def test_double_components_are_not_rounded(spark):
    # cosines a little above and below 0.9, which are the same as float
    rows = []
    for k, c in enumerate((0.9 + 1e-12, 0.9 - 1e-12)):
        at = [0.0] * 8
        at[4 * k] = 1.0
        to = [0.0] * 8
        to[4 * k], to[4 * k + 1] = c, float(np.sqrt(1 - c * c))
        rows += [(10 * k, at), (10 * k + 1, to)]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.component_id for r in got} == {0: 0, 1: 0, 10: 10, 11: 11}
