"""Best-fit packing, the Merkle manifest and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skyweave.llm import fit_packing, merkle, spelling

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, part int, bin long, tree string, word string"


def case_rows():
    rng = random.Random(11)
    words = ["Candle", "candles", "candel", "cänder", "STONE", "stones", "stine", "wood", "éclair", "éclairs", "ab"]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, f"s{i % 3}", rng.choice(["en", "en", "en", "fr", None, *"abcdefghijk"]), len(text)))
    rows += [(900, None, None, None, None), (901, "", "s", "", 0), (None, "Stone stone candle", "s", "en", 3), (None, None, None, "only", None)]
    rows += [(902, "Candle " * 3000, "s", "en", 1), (903, "x" * 5000, "s", "en", 1)] + [(5, rows[5][1], *rows[5][2:])] * 3
    return [(*r, 7, 8, "t", "w") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(case_rows(), SCHEMA).repartition(3)


# --- packing ----------------------------------------------------------------------------------------------------
def checked(rows, docs):
    """Pieces as the contract has them; sequences of gapless pieces. Returns the number of sequences."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(fit_packing.default_tokenizer())
    want = collections.Counter()
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            start = 0 if k == 0 else end - 1024
            want[(doc, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def test_fit_packing(spark, docs):
    rows = fit_packing.fit_pack(docs).collect()
    sizes = [r.length for r in rows]
    number = checked(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert number == fit_packing.least_bins(sizes, 1024)
    assert fit_packing.fit_pack(docs.limit(0)).count() == 0


def test_fit_packing_in_several_turns(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("tree" for _ in range(rng.randint(0, 1022)))) for i in range(600)]
    rows = fit_packing.fit_pack(spark.createDataFrame(texts, "doc_id long, text string"), group=64).collect()
    number, sizes = checked(rows, texts), [r.length for r in rows]
    assert number <= 1.03 * max(fit_packing.least_bins(sizes, 1024), len(fit_packing.best_fit(sizes, 1024)))


def test_marks_and_odd_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = fit_packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), fit_packing.encoder(path)
    rng = random.Random(2)
    texts = ["a<|endoftext|> b<|endoftext|>", "<|endoftext", "  　 x \t\n y", "don't 'S ſt 12½ \U0001f600", "\x1c\x1d a  b ", "é" * 5000, "x" * (1 << 20) + "yz", " " * 70_000]
    texts += ["".join(rng.choice("ab '’s\n\t 1é!ſ ") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def least_by_trying(sizes, capacity):
    """Bins of a best packing: pieces in turn into any bin with room, or a new one."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest.remove(room)
                put(k + 1, [*rest, room - sizes[k]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_search_against_best_packings():
    rng = random.Random(9)
    over = 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 10))), reverse=True)
        bins = fit_packing.packed_bins(sizes, 20)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
        best = least_by_trying(sizes, 20)
        assert fit_packing.least_bins(sizes, 20) <= best <= len(bins) <= len(fit_packing.best_fit(sizes, 20))
        over += len(bins) > best
    assert over <= 3


def test_steps_empty_bins_that_best_fit_leaves():
    # by moves and by exchanges of one for one or two for one
    for start, bins in (([[6, 3], [5, 4], [1, 1]], 2), ([[5], [4, 3, 2], [6]], 2)):
        search = fit_packing.Search([list(b) for b in start], 10)
        squares = sum(f * f for f in search.fill)
        found = search.run(1)
        assert len(found) == bins and sum(sum(b) ** 2 for b in found) > squares
        assert sorted(s for b in found for s in b) == sorted(s for b in start for s in b)


# --- manifest ---------------------------------------------------------------------------------------------------
def brute_manifest(rows):
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(doc, text, source, lang, n):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    def tree(level):
        """Its root, and of each node the (left, right) siblings from below."""
        proofs, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(at):
                lo = p // 8 * 8
                proofs[i].append(("".join(level[lo:p]), "".join(level[p + 1 : lo + 8])))
                at[i] = p // 8
            level = [H("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], proofs

    by = collections.defaultdict(list)
    for r in rows:
        doc, text = r[0], r[1]
        own, told = leaf(*r[:5]), None
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            told = leaf(doc, re.sub("[A-Z]", lambda m: m.group().lower(), text), *r[2:5])
        by[r[3]].append((doc is not None, doc or 0, own, told or own, doc))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(by[g]), *tree([x[2] for x in sorted(by[g])])) for g in langs}
    root, above = tree([trees[g][1] for g in langs])
    out = []
    for g, up in zip(langs, above):
        leaves, subroot, proofs = trees[g]
        for (_, _, own, told, doc), proof in zip(leaves, proofs):
            d = told
            for left, right in proof + up:
                d = H(left + d + right)
            out.append((doc, own, subroot, root, H("".join(a + b for a, b in proof + up)), d, d == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(docs, levels):
    rows = case_rows()
    got = merkle.manifest(docs, levels).collect()
    assert ordered(got) == ordered(brute_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, docs):
    one = docs.where("doc_id = 3")
    assert ordered(merkle.manifest(one).collect()) == ordered(brute_manifest([r for r in case_rows() if r[0] == 3]))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_sweeps_come_in_label_order():
    for n in (1, 2, 8, 9, 64, 65, 100):
        top = merkle.height(n, 4)
        seen = list(merkle.labels(n, top))
        place = {node: k for k, node in enumerate(seen)}
        assert len(place) == len(seen) and seen[-1] == (top, 0)
        assert all(place[level, k] < place[level + 1, k // 8] for level, k in seen if level < top)


# --- spelling ---------------------------------------------------------------------------------------------------
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, close = {}, {}
    for w in n:
        close[w] = [v for v in n if near(w, v)]
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def test_variants(spark, docs):
    got = spelling.variants(docs, size=3).collect()
    assert ordered(got) == ordered(brute_variants([r[:2] for r in case_rows()]))
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [7, 60, 50_000])
def test_variants_of_crowded_words(spark, size):
    rng = random.Random(size)
    front = "prefix" * 3  # all words begin alike, so that slices part them by what follows
    words = [front * (i % 2) + "".join(rng.choice("abéñ") for _ in range(rng.randint(5, 7))) for i in range(160)]
    rows = [(i, "; ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights=[1.05**k for k in range(160)], k=60))) for i in range(120)]
    rows += [(400 + i, "lantern " * 40 + "lanterm " * 18 + "lantrm " * 7) for i in range(2)]
    rows += [(500 + i, ("k" * 3000 + "a" * i + " ") * 3) for i in range(3)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
    assert ordered(got) == ordered(brute_variants(rows))
    assert any(r.form and r.root != r.form for r in got)
