"""Merkle manifest of documents by time-forward processing, proofs by the reversed sweep.

Nodes are labelled in an order in which children come before their parent (post-order). A sweep goes through the labels
once; a node's digest is a message to its parent, kept in a priority queue ordered by the label of its receiver, so
that a parent finds what its children sent at the head of the queue when its label comes up. The reversed sweep sends
what a node knows of its proof (the siblings of all levels above it) from parents to children in the same way.

The queue is external: leaves in order are cut into blocks of FAN ** LEVELS; a task sweeps one block with a heap (post-
order keeps at most FAN messages a level in it), and messages to nodes above the block travel by Spark's shuffle on the
label of the block that receives them. So each sweep is a few grouped steps, one for each LEVELS levels of the tree,
and each block gets its proof suffix once, not once for each leaf. The trees of all languages go through the same
steps; their roots, in order of lang, are the leaves of one more tree.

Leaves come by range sort over (lang, doc_id, leaf); their numbers are the counts of ranges before them, so that one lang
may hold any share of the rows.

Null values are written as `-`. Rows of one lang come by doc_id, null ones first, equal ones by leaf: repeated rows are leaves each.
A null lang is a lang of its own before all others. Rows without doc_id are never tampered with. An empty table gives
no rows. Other columns are not read; `source`, `lang`, `n_chars` or `text` that are missing are an error.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREE = ["known", "tree"]  # a tree's key: has it a name, and which ('' without)
Messages = list[tuple[str, str]]  # of a proof: what stands left and right of the path, level by level from below


def leaf(text: Column) -> Column:
    """Digest of a row with `text` in the place of its text."""
    values = [text if n == "text" else F.col(n).cast("string") for n in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


# --- one block --------------------------------------------------------------------------------------------------
def height(n: int, levels: int) -> int:
    """Levels of runs above n nodes until one is left, `levels` at most."""
    h = 0
    while n > 1 and h < levels:
        n, h = -(-n // FAN), h + 1
    return h


def labels(n: int, top: int):
    """Post-order of a block of n nodes: (level, number), each node after its children; level 0 are the block's own."""
    ends = [n]
    for _ in range(top):
        ends.append(-(-ends[-1] // FAN))
    for i in range(n):
        yield 0, i
        level, k = 0, i
        while level < top and (k % FAN == FAN - 1 or k == ends[level] - 1):
            level, k = level + 1, k // FAN
            yield level, k


def sweep(leaves: list[str], top: int) -> tuple[dict[tuple[int, int], int], list[list[str]]]:
    """Forward: digests of all levels of a block. A message in the queue is (label of the receiver, place, digest)."""
    order = {node: t for t, node in enumerate(labels(len(leaves), top))}
    made: list[list[str]] = [[] for _ in range(top + 1)]
    queue: list[tuple[int, int, str]] = []
    for (level, k), now in order.items():
        if level == 0:
            d = leaves[k]
        else:
            parts = []
            while queue and queue[0][0] == now:
                parts.append(heapq.heappop(queue)[2])
            d = digest("".join(parts))
        made[level].append(d)
        if level < top:
            heapq.heappush(queue, (order[level + 1, k // FAN], k, d))
    return order, made


def proofs(leaves: list[str], top: int, suffix: Messages):
    """Backward: of each node of the block, last first, its whole proof. A message is (label of the receiver, proof)."""
    order, made = sweep(leaves, top)
    last = len(order)
    queue: list[tuple[int, int, Messages]] = []
    tops = [node for node in order if node[0] == top]
    for k, node in enumerate(tops):
        heapq.heappush(queue, (last - order[node], k, suffix))
    for level, k in reversed(order):
        proof = heapq.heappop(queue)[2]
        if level == 0:
            yield k, proof
            continue
        low = made[level - 1]
        first, end = k * FAN, min((k + 1) * FAN, len(low))
        run = low[first:end]
        for j in range(first, end):
            mine = ("".join(run[: j - first]), "".join(run[j - first + 1 :]))
            heapq.heappush(queue, (last - order[level - 1, j], j, [mine, *proof]))


UP = "known boolean, tree string, pos long, n long, digest string"
PROOF = "array<struct<l:string,r:string>>"


def _block_root(levels: int):
    """A block's nodes to its top, one node of the level of the blocks."""

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        made = sweep(table.column("digest").to_pylist(), height(n, levels))[1]
        one = {c: pa.array([table.column(c)[0].as_py()]) for c in (*TREE, "block")}
        return pa.table({"known": one["known"], "tree": one["tree"], "pos": one["block"], "n": [-(-n // FAN**levels)], "digest": made[-1]})

    return root


def _suffix(above: pa.Table) -> Messages:
    return [(x["l"], x["r"]) for x in above.column("proof")[0].as_py()]


def _inner(levels: int):
    """Proofs of a block's nodes, as suffixes of the blocks below them."""

    def inner(_, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        found = proofs(table.column("digest").to_pylist(), height(table.column("n")[0].as_py(), levels), _suffix(above))
        rows = [[{"l": a, "r": b} for a, b in p] for _, p in sorted(found, key=lambda x: x[0])]
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return pa.table({"known": table.column("known"), "tree": table.column("tree"), "block": table.column("pos"), "proof": pa.array(rows, kind)})

    return inner


def fold(d: str, proof: Messages) -> str:
    """The root that a digest and its siblings give; levels at which the node was alone in its run still hash."""
    for left, right in proof:
        d = digest(left + d + right)
    return d


def _leaves(root: str, levels: int):
    """Of a block's leaves the digest of the proof, and the root that the leaf as it may have been tampered with gives."""

    def leaves(_, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        own, tampered = table.column("digest").to_pylist(), table.column("tampered").to_pylist()
        sent, folded = [""] * len(own), [""] * len(own)
        for k, proof in proofs(own, height(table.column("n")[0].as_py(), levels), _suffix(above)):
            sent[k] = digest("".join(left + right for left, right in proof))
            folded[k] = fold(tampered[k], proof)
        same = {"doc_id": table.column("doc_id"), "known": table.column("known"), "tree": table.column("tree"), "leaf": pa.array(own)}
        return pa.table(same | {"root": [root] * len(own), "proof_sha256": sent, "folded_root": folded, "verified": [x == root for x in folded]})

    return leaves


# --- the whole tree ---------------------------------------------------------------------------------------------
def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**levels))


def ascend(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (known, tree, pos, n, digest) block by block to one node for each tree: the nodes of each turn, and
    the trees' roots. Turns are as many as blocks lie above each other in the tallest tree."""
    turns = [nodes]
    while turns[-1].where("n > 1").limit(1).count():
        at = turns[-1]
        up = _blocked(at.where("n > 1"), levels).groupBy(*TREE, "block").applyInArrow(_block_root(levels), UP)
        turns.append(written(up.union(at.where("n = 1").select(up.columns))))
    return turns[:-1], turns[-1]


def descend(turns: list[DataFrame], suffixes: DataFrame, levels: int) -> DataFrame:
    """Proof suffixes (known, tree, block, proof) of the blocks of the lowest turn, from those of the roots."""
    for at in reversed(turns[1:]):
        alone = at.where("n = 1").select(*TREE)  # a tree that ended below keeps the suffix of its root
        here = suffixes.join(alone, TREE, "left_anti").groupBy(*TREE, "block")
        below = _blocked(at.where("n > 1"), levels).groupBy(*TREE, "block").cogroup(here)
        below = below.applyInArrow(_inner(levels), f"known boolean, tree string, block long, proof {PROOF}")
        suffixes = written(below.union(suffixes.join(alone, TREE, "left_semi")))
    return suffixes


def numbered(leaves: DataFrame, by: str) -> DataFrame:
    """Leaves (known, tree, digest, ...) with pos, their place in the tree by a column (nulls first, then by digest; rows
    that are alike in all come in the order of the table, which must be a written one), and n, the tree's leaves."""
    order = [*TREE, F.asc_nulls_first(by), "digest", "uid"]
    leaves = leaves.withColumn("uid", F.monotonically_increasing_id())
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    dealt = written(dealt.withColumns({"range": F.shiftright(mark, 33), "place": mark.bitwiseAND((1 << 33) - 1)}))
    runs = dealt.groupBy(*TREE, "range").agg(F.count("*").alias("m"), F.min("place").alias("first"))
    w = Window.partitionBy(*TREE)
    runs = runs.withColumns({"n": F.sum("m").over(w), "before": F.sum("m").over(w.orderBy("range")) - F.col("m")})
    placed = dealt.join(runs, [*TREE, "range"]).withColumn("pos", F.col("place") - F.col("first") + F.col("before"))
    return placed.drop("uid", "range", "place", "m", "first", "before")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    known, name = F.col("lang").isNotNull().alias("known"), F.coalesce("lang", F.lit("")).alias("tree")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(known, name, "doc_id", leaf(F.col("text")).alias("digest"), F.when(struck, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))
    leaves = written(leaves.withColumn("tampered", F.coalesce("tampered", "digest")))
    nodes = written(numbered(leaves, "doc_id"))
    turns, subroots = ascend(nodes.select(*TREE, "pos", "n", "digest"), levels)
    trees = subroots.select(F.lit(True).alias("known"), F.lit("").alias("tree"), F.struct("known", "tree").alias("of"), "digest")
    trees = written(numbered(written(trees), "of"))
    upper, top = ascend(trees.select(*TREE, "pos", "n", "digest"), levels)
    root = (top.first() or {"digest": ""})["digest"]
    suffixes = docs.sparkSession.createDataFrame([(True, "", 0, [])], f"known boolean, tree string, block long, proof {PROOF}")
    suffixes = descend([nodes, *upper], suffixes, levels)  # of the subroots
    suffixes = trees.join(suffixes.select(F.col("block").alias("pos"), "proof"), "pos").select("of.*", F.lit(0).cast("long").alias("block"), "proof")
    suffixes = descend(turns, suffixes, levels)
    found = _blocked(nodes, levels).groupBy(*TREE, "block").cogroup(suffixes.groupBy(*TREE, "block")).applyInArrow(
        _leaves(root, levels), "doc_id long, known boolean, tree string, leaf string, root string, proof_sha256 string, folded_root string, verified boolean")
    roots = subroots.select(*TREE, F.col("digest").alias("subroot"))
    return found.join(roots, TREE).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(levels: int = 7, above: int = 3) -> str:
    """The same in SQL, level by level, for up to 8 ** levels rows of a lang and 8 ** above langs."""
    values = ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in (f"CAST({n} AS VARCHAR)" for n in FIELDS))
    lower = values.replace("CAST(text AS VARCHAR)", f"translate(text, '{UPPER}', '{LOWER}')")
    step = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    parts = [
        f"c AS (SELECT list_transform(range(256), lambda x: {step}) AS t)",
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, lang, sha256(concat({values})) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256(concat({lower})) END AS tampered FROM documents, c)",
        "a0 AS (SELECT rid, doc_id, lang AS g, leaf AS d, coalesce(tampered, leaf) AS f, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        f"b0 AS (SELECT CAST(NULL AS VARCHAR) AS g, g AS of, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{levels})",
    ]
    for x, top in (("a", levels), ("b", above)):
        for k in range(top):
            at = len(parts) - (x == "a")
            run = f"OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN {{}})"
            parts[at:at] = [
                f"s{x}{k} AS (SELECT g, pos, n > 1 AS up, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') ELSE '' END AS r FROM {x}{k})",
                f"{x}{k + 1} AS (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {x}{k} GROUP BY g, pos // 8, n)",
            ]
    parts.append(f"p0 AS (SELECT a.rid, a.doc_id, a.d AS leaf, a.f, '' AS proof, a.g, a.pos, b.pos AS top, e.d AS subroot, r.d AS root FROM a0 a JOIN b0 b ON b.of IS NOT DISTINCT FROM a.g JOIN a{levels} e ON e.g IS NOT DISTINCT FROM a.g CROSS JOIN b{above} r)")
    for k in range(levels + above):
        x, j, place, key = ("a", k, "pos", "s.g IS NOT DISTINCT FROM p.g") if k < levels else ("b", k - levels, "top", "true")
        parts.append(f"p{k + 1} AS (SELECT p.* EXCLUDE (f, proof, {place}), p.{place} // 8 AS {place}, CASE WHEN s.up THEN sha256(s.l || p.f || s.r) ELSE p.f END AS f, p.proof || s.l || s.r AS proof FROM p{k} p JOIN s{x}{j} s ON {key} AND s.pos = p.{place})")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{levels + above}"
