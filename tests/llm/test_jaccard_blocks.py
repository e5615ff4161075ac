"""Near copies around one hub that come in several blocks, against brute force."""

import random

from skyweave.llm import jaccard_join as jaccard


def _classes(texts: dict[int, str]) -> dict[int, int]:
    words = {i: x.split() for i, x in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def _variants() -> list[list[str]]:
    """Of one text: copies near it, copies near one of those alone, and copies near nothing but each other."""
    random.seed(31)
    base = [f"w{k}" for k in range(160)]

    def changed(words, times):
        words = list(words)
        for k in random.sample(range(len(words)), times):
            words[k] = f"x{random.getrandbits(48)}"
        return words

    close = [changed(base, 2) for _ in range(100)]
    beside = [changed(random.choice(close), 3) for _ in range(40)]
    alone = [changed(base, 7) for _ in range(60)]
    return [base, *close, *beside, *alone, *(changed(w, 1) for w in alone[:25] for _ in range(2))]


def test_hub_of_several_blocks(spark, monkeypatch):
    called, compared = [], jaccard._compared

    def spy(*args):
        called.append(args[6].__name__)
        return compared(*args)

    monkeypatch.setattr(jaccard, "_compared", spy)
    texts = _variants()
    random.shuffle(texts)
    texts = {i: " ".join(w) for i, w in enumerate(texts)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = _classes(texts)
    for together, across in ((40, True), (2000, False)):
        called.clear()
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
        assert got == want
        assert ("_across" in called) is across
    assert len(set(want.values())) > 20


def test_across_joins_up_lone_nodes():
    """A guest gets one link for each component it meets, and none with other guests."""
    import numpy as np
    import pyarrow as pa

    token = lambda xs: np.array(xs, "<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()
    sets = {1: range(20), 2: range(1, 21), 3: range(100, 120), 4: range(2, 22), 5: range(101, 121)}
    held = pa.table({"node": pa.array(sets), "tokens": pa.array([token(x) for x in sets.values()], pa.binary())})
    rows = [(1, 0, False), (2, 0, False), (3, 1, False), (4, 1, True), (5, 1, True)]
    pairs = pa.table({"a": [9] * 5, "b": [r[0] for r in rows], "block": [0] * 5, "lone": [r[1] for r in rows], "guest": [r[2] for r in rows]})
    got = sorted(zip(*jaccard._across(held, pairs).to_pydict().values(), strict=True))
    assert [x[0] for x in got] == [4, 5] and got[0][1] in (1, 2) and got[1] == (5, 3)


def test_rows_do_not_multiply_with_the_buckets(spark, monkeypatch):
    """Pairs and counts of a node come from each bucket that has tokens of it, packed: no row for each node and bucket."""
    rows, written = [], jaccard.written

    def spy(df):
        out = written(df)
        if "kind" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    texts = {i: " ".join(w) for i, w in enumerate(_variants())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, size, before = _classes(texts), sum(map(len, texts.values())), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for buckets, deals in ((4, 1), (16, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
            monkeypatch.setattr(jaccard, "DEAL_BYTES", size // deals + deals, raising=False)
            got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
            assert got == want
            assert rows.pop() <= buckets * (2 * deals + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
