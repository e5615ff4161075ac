"""Spelling variants by dynamic programming over a sorted word list.

Runs of letters are counted in the tasks that read texts (words that a document spells with a letter less are altered
there), and added up by word. The vocabulary is then compared with itself:

* two words one edit apart share the first half of either one or its other half, counted from the end. So one pass goes
  over the words in order and looks at those that begin as the query does, one over the reversed words; a pair counts
  in the second pass only if the first cannot have it;
* within a sorted list a query's words are a range. The scan goes through it with a banded edit matrix (three cells a
  row, as only one edit counts). Words take over the rows of what they share with the word before them, as the LCPs of
  neighbours tell, and where a row has no cell below two, the whole range that shares it is skipped. Rows of some
  thousand queries are computed at once;
* the list is range-partitioned by splitters that Spark samples, some SLICE words in a slice. A query goes to the slices
  that its range touches, unless what all words of a slice begin with is already two edits away. Words are distinct,
  so slices part however alike words begin.

A slice gives one row for each query: how many near words, and the best of them. Forms are followed to their roots by
pointer doubling, as the number of occurrences at least doubles with each form.

Null texts have no runs; a null doc_id is written as an empty text where a run is hashed; repeated rows count each; an
empty table gives no words. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, release_memory, written

LEAST, OFTEN, ALTERED, RATIO = 5, 3, 97, 2
SLICE, TOGETHER, HELD = 50_000, 5_000, 400_000
LAST = chr(0x10FFFF)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- words ------------------------------------------------------------------------------------------------------
def runs(text: str) -> list[str]:
    """Lower-cased runs of LEAST letters or more; shorter ones cannot give a word."""
    return RUN.findall(text.encode().translate(LOWER).decode())


RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")


def altered(run: str, before: int) -> str:
    """The run as its document has it; before is the checksum of what is hashed in front of it."""
    h = zlib.crc32(run.encode(), before)
    if h % ALTERED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches):
    """(word, n), added up as far as HELD words allow."""
    held: dict[str, int] = {}

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
            for run, n in Counter(runs(text.as_py() or "")).items():
                word = altered(run, before)
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield out()
    yield out()
    release_memory()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words that count."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return n.where((F.col("n") >= OFTEN) & (F.char_length("word") >= LEAST))


# --- one sorted list --------------------------------------------------------------------------------------------
def shared(a: str, b: str) -> int:
    """Code points at the front of both."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            return k
        k += 1
    return k


def edit_rows(x, y, z, d: int, c, q0, q1, q2, n):
    """Banded rows (columns d, d + 1, d + 2 of row d + 1) from those before (columns d - 1, d, d + 1 of row d), for a
    list word's code point c and the query's at d - 1, d and d + 1; n is the query's length. Columns beyond it are 9.
    Works on arrays of many queries and words as on single numbers."""
    a = np.minimum(y + 1, x + (c != q0))
    b = np.minimum(np.minimum(z + 1, a + 1), y + (c != q1))
    e = np.minimum(b + 1, z + (c != q2))
    return np.where(d > n, 9, a), np.where(d + 1 > n, 9, b), np.where(d + 2 > n, 9, e)


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, each with two zeros after it, where each begins, and how long it is."""
    codes = np.frombuffer("".join(f"{w}\0\0" for w in words).encode("utf-32-le"), "<u4")
    size = np.array([len(w) for w in words], np.int64)
    return codes, np.cumsum(size + 2) - size - 2, size


class SortedList:
    """A sorted list of words with their LCPs."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.at, self.size = flat(words)
        self.lcp = np.array([-1, *(shared(a, b) for a, b in zip(words, words[1:]))], np.int64)
        self._heads: dict[int, np.ndarray] = {}

    def heads(self, d: int) -> np.ndarray:
        """Where words begin that share at most d code points with the word before them."""
        if d > 64:
            return np.flatnonzero(self.lcp <= d)
        if d not in self._heads:
            self._heads[d] = np.flatnonzero(self.lcp <= d)
        return self._heads[d]

    def scan(self, queries: list[str], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs one edit apart, among words that begin with first[q] of the query's.

        A range of the list whose words share d code points has one matrix row for each query. It parts into ranges that
        share d + 1, each taking over the row; those whose new row has no cell below two are skipped. A range that holds
        nothing but the query itself is dropped, too.
        """
        words, codes, at = self.words, self.codes, self.at
        qcodes, qat, qsize = flat(queries)
        begin: dict[int, list] = {}
        own = np.full(len(queries), -1, np.int64)
        for k, (q, f) in enumerate(zip(queries, first, strict=True)):
            lo = bisect_left(words, q[:f])
            hi = bisect_left(words, q[:f] + LAST, lo)
            i = bisect_left(words, q, lo, hi)
            own[k] = i if i < hi and words[i] == q else -1
            if lo < hi:
                begin.setdefault(f, []).append((k, lo, hi))
        none = np.zeros(0, np.int64)
        q, lo, hi, x, y, z = none, none, none, none, none, none
        found, depths, d = [], sorted(begin), 0
        while len(q) or depths:
            if not len(q):
                d = depths[0]
            if depths and depths[0] == d:
                new = np.array(begin[depths.pop(0)], np.int64).T
                one = np.ones(new.shape[1], np.int64)
                q, lo, hi = (np.concatenate([old, more]) for old, more in zip((q, lo, hi), new, strict=True))
                x, y, z = (np.concatenate([old, more]) for old, more in zip((x, y, z), (one, 0 * one, one), strict=True))
            keep = (hi - lo > 1) | (lo != own[q])
            q, lo, hi, x, y, z = (v[keep] for v in (q, lo, hi, x, y, z))
            heads = self.heads(d)  # the first of a range is one, as it shares less than d with the word before, or d
            i, j = np.searchsorted(heads, lo + 1), np.searchsorted(heads, hi)
            many = j - i + 1
            parent = np.repeat(np.arange(len(q)), many)
            step = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            start = np.where(step == 0, lo[parent], heads[np.minimum(i[parent] + step - 1, len(heads) - 1)])
            end = np.where(step == many[parent] - 1, hi[parent], np.append(start[1:], 0))
            q, x, y, z = q[parent], x[parent], y[parent], z[parent]
            c, n = codes[at[start] + d], qsize[q]
            over = c == 0  # the first word of the range ends here
            band = np.where(n == d - 1, x, np.where(n == d, y, np.where(n == d + 1, z, 9)))
            hit = over & (band == 1)
            if hit.any():
                found.append((q[hit], start[hit]))
            base = qat[q] + np.minimum(d, n)
            a, b, e = edit_rows(x, y, z, d, c, qcodes[base - (d > 0)], qcodes[base], qcodes[base + 1], n)
            keep = ~over & ((a < 2) | (b < 2) | (e < 2))
            q, lo, hi, x, y, z = (v[keep] for v in (q, start, end, a, b, e))
            d += 1
        if not found:
            return none, none
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def half(n: int, backward: bool) -> int:
    """Of a query of n code points those that its near words must begin with."""
    return n - n // 2 if backward else n // 2


def _reach(prefix: str, q: str) -> bool:
    """Can a word that begins with prefix be within one edit of q?"""
    row, n, codes = (9, 0, 1), len(q), f"{q}\0\0"
    for d, c in enumerate(prefix):
        k = min(d, n)
        row = edit_rows(*row, d, c, codes[k - (d > 0)], codes[k], codes[k + 1], n)
        if min(row) > 1:
            return False
    return True


def _routed(bounds: list[tuple[int, str, str]], backward: bool):
    """Queries with each slice that may have near words."""
    slices, highs, lows = ([b[k] for b in bounds] for k in (0, 2, 1))
    common = [low[: shared(low, high)] for low, high in zip(lows, highs, strict=True)]

    def routed(batches):
        for batch in batches:
            at, rows = [], []
            for r, word in enumerate(batch.column(0).to_pylist()):
                start = word[: half(len(word), backward)]
                k = bisect_left(highs, start)
                while k < len(slices) and lows[k] < start + LAST:
                    if _reach(common[k], word):
                        at.append(slices[k])
                        rows.append(r)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64()))], ["slice", "word"])

    return routed


FOUND = "word string, n_near long, form_n long, form string"
NONE = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})


def _near(backward: bool):
    """Of each query its near words in a slice: how many, and the most frequent (smallest at ties)."""

    def near(_, table: pa.Table, asked: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        plain = [w[::-1] for w in words] if backward else words
        rank = np.argsort(np.argsort(np.array(plain, object), kind="stable")) if backward else np.arange(len(words))
        listed, out = SortedList(words), []
        queries = sorted(asked.column("word").to_pylist())
        for k in range(0, len(queries), TOGETHER):
            some = queries[k : k + TOGETHER]
            q, w = listed.scan(some, [half(len(x), backward) for x in some])
            if backward:  # what the forward pass has goes
                mine = [x[::-1] for x in some]
                new = np.array([not plain[j].startswith(mine[i][: half(len(mine[i]), False)]) for i, j in zip(q.tolist(), w.tolist())], bool)
                q, w, some = q[new], w[new], mine
            order = np.lexsort((rank[w], -counts[w], q))
            q, w = q[order], w[order]
            heads = np.flatnonzero(np.diff(q, prepend=-1))
            out.append(pa.table({"word": pa.array([some[i] for i in q[heads]], pa.string()), "n_near": np.diff(np.append(heads, len(q))).astype(np.int64), "form_n": counts[w[heads]].astype(np.int64), "form": pa.array([plain[i] for i in w[heads]], pa.string())}))
        return pa.concat_tables(out) if out else NONE

    return near


def _pass(words: DataFrame, size: int, backward: bool) -> DataFrame:
    listed = words.select(F.reverse("word").alias("word"), "n") if backward else words
    slices = max(1, -(-words.count() // size))
    dealt = written(listed.repartitionByRange(slices, "word").withColumn("slice", F.spark_partition_id()))
    bounds = dealt.groupBy("slice").agg(F.min("word").alias("a"), F.max("word").alias("z")).collect()  # one row for each slice
    bounds = sorted(((r["slice"], r["a"], r["z"]) for r in bounds), key=lambda b: b[1])
    asked = dealt.select("word").mapInArrow(_routed(bounds, backward), "slice int, word string")
    return dealt.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(_near(backward), FOUND)


# --- forms and roots --------------------------------------------------------------------------------------------
def roots(forms: DataFrame) -> DataFrame:
    """word, root of all rows (word, form) that have a form: pointers are doubled until none moves."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    modest_batches(docs.sparkSession)
    words = written(vocabulary(docs))
    found = _pass(words, size, False).union(_pass(words, size, True))
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    strong = F.col("b.form_n") >= RATIO * F.col("n")
    out = written(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("b.form")).alias("form"), F.when(strong, F.col("b.form_n")).alias("form_n")))
    end = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same in SQL: near words share what is left without the code point at one place, or one is what is left of the
    other."""
    step = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    letters = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda s: CAST(unicode(s) AS BIGINT))"
    octets = f"flatten(list_transform({letters}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        f"WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda x: {step}) AS t), "
        f"r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{upper}', '{lower}') AS run FROM documents), "
        f"o AS (SELECT doc_id, run, count(*) AS m FROM r WHERE length(run) >= {LEAST} GROUP BY doc_id, run), "
        f"h AS (SELECT run, m, {crc} AS h FROM o, c), "
        f"w AS (SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, m FROM h), "
        f"v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(m) >= {OFTEN}), "
        "k AS (SELECT word, n, length(word) AS size, unnest(range(length(word))) AS p FROM v), "
        "l AS (SELECT word, n, size, p, substr(word, 1, CAST(p AS INTEGER)) || substr(word, CAST(p AS INTEGER) + 2) AS rest FROM k), "
        "e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM l a JOIN l b ON a.p = b.p AND a.rest = b.rest AND a.size = b.size AND a.word <> b.word "
        "UNION SELECT a.word, b.word, b.n FROM l a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM l a JOIN v b ON a.rest = b.word), "
        "g AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM e GROUP BY word), "
        f"f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM v LEFT JOIN g ON g.word = v.word), "
        "s AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, s.root FROM f JOIN s ON f.form = s.word) "
        "SELECT f.word, form, root, n, n_near, form_n FROM f JOIN s ON s.word = f.word"
    )
