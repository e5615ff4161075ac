"""Each operator against a brute-force version on small rows with nulls, empty texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import embedding_dedup, fitting, html_text, licenses, neighbours, packing, quality_cnn, sentencepiece_codec, toxicity_cnn
from skyweave.llm import jaccard_join as jaccard
from skyweave.llm import suffix_dedup as suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, part string, node int"  # names that operators use themselves


def rows_with_cases():
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    base = [random.choice(words) for _ in range(60)]
    rows = []
    for i in range(40):
        b = list(base)
        for _ in range(random.choice([0, 1, 2, 3])):
            b[random.randrange(60)] = random.choice(words)
        rows.append((i, " ".join(b)))
    rows += [(i, " ".join(random.choice(words) for _ in range(30))) for i in range(40, 60)]
    rows += [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "one TWO"), (105, "x" * 3000), (106, "x" * 200), (107, "mit license")]
    rows += [(105, "x" * 3000)]
    return [(*r, "p", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_with_cases(), SCHEMA).repartition(3)


def test_suffix_dedup(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, suffix.suffix_dedup(docs).collect())) == sorted(want)
    assert suffix.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_null_ids(spark):
    """A null doc_id takes nothing from others and loses nothing; cut characters leave no rests, others stay."""
    long = "".join(random.Random(2).choices("abcdefgh ", k=90))
    rows = [(None, long), (5, long), (None, None), (6, "\ufffdé" + long[1:] + "é\ufffd"), (7, "é" * 30), (8, "\ufffdx" + "é" * 29)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert got == {(None, 90): (0, long), (5, 90): (0, long), (None, 0): (0, ""), (6, 99): (89, "\ufffdéé\ufffd"), (7, 60): (0, "é" * 30), (8, 62): (58, "\ufffdx")}


def test_multikey_order():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, (30000, 4)).astype(np.uint64)
    o = suffix.multikey_order(lambda k, r: w[r, k], len(w), 4, leaf=64)
    assert (w[o] == w[np.lexsort(w.T[::-1])]).all()


@pytest.mark.parametrize("small,hot,pivots", [(8, 20_000, 8), (2, 4, 1), (2, 20_000, 0)])
def test_jaccard(docs, small, hot, pivots, monkeypatch):
    """Also with hot tokens dealt over blocks, and without stars, so that crossing pairs alone must find all links."""
    for name, value in (("SMALL", small), ("HOT", hot), ("PIVOTS", pivots)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, x in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (x or "").encode().translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    """Near copies under null ids, and under one id with several texts."""
    random.seed(9)
    texts = [[f"g{g}w{k}" for k in range(120)] for g in range(5)]
    near = lambda g, k: " ".join(texts[g][:k] + ["other"] + texts[g][k + 1 :])
    rows = [(None, near(0, 10), 0), (None, near(0, 30), 0), (7, near(0, 50), 0), (None, near(1, 10), 1), (None, near(1, 50), 1)]
    rows += [(3, near(2, 10), 2), (3, near(3, 10), 3), (3, near(4, 10), 4), (20, near(2, 40), 2), (21, near(3, 40), 3), (2, near(4, 40), 4), (None, near(2, 10), 2), (None, None, 5)]
    least = {0: 7, 1: None, 2: 3, 3: 3, 4: 2, 5: None}
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == collections.Counter((i, least[g]) for i, _, g in rows)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["I\u0307X e\u0301. é. »., a.'s 'tis don't. it's'd x'1 12a,b3-4é5 ###A&&&b !!é É! İI. A\u030a", "<|endoftext|> <|ENDOFTEXT|>. A<|b", "''\u0301a =\u0338a", "Ab́ c d", "x<|endoftext|>y a\x0bb\x1cc", "don't 123abc  ΣΑΣ ", "", " wide"]
    assert [x.tolist() for x in packing.encode(odd, packing.default_tokenizer())] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in odd]
    pieces = packing.pack(docs.dropDuplicates(["doc_id"])).collect()
    by, at = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        at[p.sequence_id].append((p.offset, p.length))
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        place = 0
        for p in sorted(by[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (place, len(ids))
            assert zlib.crc32(np.array(ids[place : place + p.length], "<u4").tobytes()) == p.ids_crc32
            place += p.length
        assert place == len(ids)
    for s, spans in at.items():
        spans.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        assert s == max(at) or sum(n for _, n in spans) == packing.SEQUENCE
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_is_a_curve():
    grid = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    key = packing.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16))
    x[100:150] = x[:50] + 0.2 * rng.normal(size=(50, 16))
    x[150:160] = x[0]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [float("inf")] * 16, 0), (905, [], 0), (906, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int"), x.astype(np.float32).astype(float)


@pytest.mark.parametrize("cell,block", [(1000, 2048), (20, 16)])
def test_embedding_dedup(vectors, cell, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "chosen", lambda sample, count: embedding_dedup.fit_centroids(sample, count // cell + 1))
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp, len(x)).min(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(df).collect() if r.vec_id is not None}
    want = {i: (int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 907)}
    assert got == want
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_embedding_dedup_on_centroids(spark, monkeypatch):
    """Every vector is the only member of its cell, or shares it with scaled copies: offsets of 0."""
    monkeypatch.setattr(embedding_dedup, "chosen", lambda sample, count: embedding_dedup.fit_centroids(sample, count))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 16)).astype(np.float32)
    x[30:60] = x[:30] + np.float32(0.05) * rng.normal(size=(30, 16)).astype(np.float32)
    x[60:75] = 2 * x[:15]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(df).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_embedding_dedup_repeated_ids(spark):
    """An id with several vectors stands for as many; only what is linked comes together."""
    e = np.eye(8)
    near = lambda k: (e[k] + 0.1 * e[(k + 1) % 8]).tolist()
    rows = [(7, e[0].tolist()), (7, e[2].tolist()), (3, near(0)), (5, near(2)), (7, e[0].tolist()), (9, e[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(df).collect())
    assert got == [(3, 1, 3, True), (5, 1, 5, True), (7, 1, 3, False), (7, 1, 3, False), (7, 1, 5, False), (9, 0, 9, True)]


def test_bound_rows():
    """One product of the rows is estimate, error bound and the centroid's part."""
    rng = np.random.default_rng(6)
    dim, c = 32, rng.normal(size=32) / 9
    u = rng.normal(size=(60, dim)) / np.sqrt(dim)
    code, length, factor, direction = embedding_dedup.binary_codes(u - c, embedding_dedup.rotation(dim, 1))
    held, asked = embedding_dedup.bound_rows(code, length, factor, direction, u @ c, c @ c, dim)
    value, error = embedding_dedup.estimate(code, factor, direction, dim)
    want = length[:, None] * length * (value + embedding_dedup.SURE * error[:, None]) + (u @ c)[:, None] + u @ c - c @ c
    assert np.abs(held @ asked.T - want).max() < 1e-4 and (held @ asked.T > u @ u.T).all()


def test_estimate_on_the_centroid():
    turn = embedding_dedup.rotation(8, 1)
    code, length, factor, direction = embedding_dedup.binary_codes(np.vstack([np.zeros(8), np.eye(8)[0]]), turn)
    value, error = embedding_dedup.estimate(code, factor, direction, 8)
    assert length[0] == 0 and (value[0] == 0).all() and error[0] == 0 and np.isfinite(value).all() and np.isfinite(error).all()


def test_rabitq_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    dim = 64
    turn = embedding_dedup.rotation(dim, 1)
    a, b = rng.normal(size=(300, dim)), rng.normal(size=(300, dim))
    code, _, factor, da = embedding_dedup.binary_codes(a, turn)
    value, error = embedding_dedup.estimate(code, factor, embedding_dedup.binary_codes(b, turn)[3], dim)
    true = da @ embedding_dedup.binary_codes(b, turn)[3].T
    assert abs((value - true).mean()) < 0.01 and (np.abs(value - true) <= embedding_dedup.SURE * error[:, None]).all()


def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    got = neighbours.nearest(e).toPandas()
    recall = []
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        recall.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id)) / 20)
        assert g.sort_values("rank").score.is_monotonic_decreasing and sorted(g["rank"]) == list(range(1, 21))
    assert np.mean(recall) >= 0.9
    assert neighbours.nearest(e.limit(0)).count() == 0


def test_neighbours_odd_rows(vectors):
    got = neighbours.nearest(vectors[0]).toPandas()
    assert not set(got.query_id) & {900} and got.groupby("query_id").size().eq(20).all()


def test_licenses(spark, docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[107].n_base, got[107].first_word, got[107].last_word, got[107].base_labels, got[107].score) == (1, 0, 0, "mit", 1.0)
    assert (got[100].n_words, got[100].first_word, got[100].labels, got[100].score) == (0, None, "", 0.0)
    text = "x MIT License, mit-license\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"
    r = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.labels) == (2, 1, 3, "mit")
    assert licenses.license_scan(docs.limit(0)).count() == 0
    mit = ["# Permission is hereby granted, free of charge, to any person obtaining a copy", "# of this software and associated documentation files (the Software), to deal"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    long = "x" * (licenses.WIDE + 1)
    texts = ["\n".join(mit), "\n".join(["a b", *mit]), "\n".join(bsd), "\n".join([mit[0], long, mit[1]]), mit[0], "all\nrights\n\nreserved", "all\nrights\nreserved"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "mit", "bsd", "", "", "", "all-rights-reserved"]


def test_html(spark):
    page = "<html><head><title>no</title></head><body><header>Site</header><nav><a href=x>m</a></nav><div id=content><h2>T</h2><p>First paragraph, with &amp; text that is long enough, really.</p><p>Second<b>bold</b>x paragraph, which is long enough, too.</p><p>Short.</p></div><div class='sidebar'><p>Sidebar words, many of them, not to keep, at all.</p></div><div class=comments><p>I think, as a reader, that this is nonsense, honestly.</p></div><form>f</form><footer>f</footer>"
    assert html_text.main_text(page) == "T First paragraph, with & text that is long enough, really. Secondboldx paragraph, which is long enough, too. Short."
    df = spark.createDataFrame([(1, "u", None, "a"), (1, "u", "", "a"), (None, None, "<p>x", "a")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("", 0), ("", 0), ("x", 1)]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))
        assert r.text == " ".join(html_text.unescape(body).split())


def test_sentencepiece(docs):
    m = sentencepiece_codec.model_at(sentencepiece_codec.default_model())
    plain = {p: s for p, s, b in zip(m.pieces, m.score, m.is_byte) if not b and p not in ("<s>", "</s>", "<unk>")}
    for t in ["a  b▁c 中文", "", " lead", "\n tab\tx ", "▁", "a\x00b▁▁", "w1 w22 the quick brown"]:
        ids, score = m.encode([t])[0]
        assert m.decode(ids) == t
        if t and "▁" not in t:
            u = "▁" + t.replace(" ", "▁")
            best = [0.0] + [-np.inf] * len(u)
            for i in range(len(u)):
                best[i + 1] = max(best[i + 1], best[i] + m.fallback * len(u[i].encode()))
                for j in range(i + 1, len(u) + 1):
                    if u[i:j] in plain:
                        best[j] = max(best[j], best[i] + plain[u[i:j]])
            assert abs(best[-1] - score) < 1e-6
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).groupBy("doc_id").agg(F.min("text").alias("back"))
    for r in docs.join(back, "doc_id").collect():
        assert (r.text or "") == r.back
    assert all(r.round_trip for r in sentencepiece_codec.digest(docs).collect())


@pytest.mark.parametrize("model,modulus,held", [(quality_cnn, 3, 1), (toxicity_cnn, 5, 0)])
def test_classifiers(spark, docs, model, modulus, held):
    score = quality_cnn.quality_scores if model is quality_cnn else toxicity_cnn.toxicity_scores
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in got)
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta"]
    clean = [" ".join(rng.choice(words) for _ in range(20)).encode() for _ in range(80)]
    bad = [t + b" zzz!!zzz ### zzz" for t in clean[:40]]
    m = model.fit(clean + bad, np.array([0] * 80 + [1] * 40, np.float32))
    data, bounds = fitting.joined_texts([clean[0], bad[1], b""])
    p = model.probabilities(m, data, bounds) if model is quality_cnn else model.probabilities(m, toxicity_cnn._table(m), data, bounds)
    assert p[0] < 0.5 <= p[1] and 0 <= p[2] <= 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.written(docs)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= sizes[2]


def test_bound_refuses_most_pairs_of_spread_vectors():
    """Offsets from the mean of a single cell are short enough for the bound; no linked pair is refused."""
    rng = np.random.default_rng(3)
    u = rng.normal(size=(1500, 64))
    u[750:] = u[:750] + 0.05 * rng.normal(size=(750, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = embedding_dedup.centres(u, embedding_dedup.fit_centroids(u, 1))[0]
    turn = embedding_dedup.rotation(64, 17)
    code, length, factor, direction = embedding_dedup.binary_codes(u - c, turn)
    held, wanted = embedding_dedup.bound_rows(code, length, factor, direction, u @ c, float(c @ c), 64)
    maybe = held @ wanted.T >= embedding_dedup.COSINE - 1e-5
    assert maybe[u @ u.T >= embedding_dedup.COSINE].all()
    assert maybe.mean() < 0.1
