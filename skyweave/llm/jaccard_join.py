"""N-gram Jaccard self-join with adaptive multi-match prefixes, exact for 100 * intersection >= 75 * union.

A document's set holds its distinct shingles of five words (lower-cased A-Z; words are runs without ASCII white
space; fewer than five words are one shingle; no words, no set). Its tokens have one global order: rare before
frequent by a count sketch over *all* documents, then by hash. With prefixes of n - ceil(3n/4) + l tokens, two sets
that reach the threshold share l prefix tokens at least, for any l. A document takes a larger l, and so a longer
prefix, if its prefix holds tokens of many documents; a pair must share as many prefix tokens as its two sizes and
prefixes allow to ask (`_shared`), each passing the length and the positional filter, before it is verified.

Equal sets are one node (a 64-bit sum over their tokens), so copies cost a row per map task. Near copies are never
listed pair by pair; nodes are joined up in two steps:

1. Stars (`_meet`). In a token's group each node is paired only with a hub: of the nodes of its own and of the next
   smaller length class the one with the fewest rarer tokens. Every node is verified against the hub that it shares
   most prefix tokens with; those that come together at a hub (in blocks of TOGETHER) are also compared with further
   pivots among them, if it is not too much work until no pair between components is open there (`_stars`). Of hubs
   with several blocks, nodes outside the hub's component are then compared with the other blocks (`_across`). A group
   gives two pairs a posting at most. A node's pairs and counts come from all buckets that have tokens of it; they
   travel packed, by the node's deal, so that rows do not multiply with the buckets.
2. Crossing pairs (`_cross`). Each posting then knows its node's component and how many shared prefix tokens the node
   has in all. All pairs of *different* components that were not settled together at a hub, pass the filters, and
   whose nodes have enough shared tokens at all, are counted over all tokens and verified if they share enough. So no
   link that could join components is lost, whatever the first step found.

The postings of a token whose cell of the sketch is estimated to hold more than HOT are dealt over pairs of blocks, so
that no task gets a whole hot group.

Null text counts as empty; documents without words are alone; rows with a null doc_id get their own row and a null
component unless they are linked with a row that has an id; repeated ids are rows of their own, each with the set of
its own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.components import connected_components

from .common import NO_ID, joined, mix64, modest_batches, packed, partitions, plain, release_memory, runs_of, settled, squeeze, text_buffers, text_bytes, unpacked, unsqueeze, written

WORDS, MOST, SMALL, TOGETHER, PIVOTS, WORK = 5, 4, 8, 2000, 8, 400_000_000
#: Estimated postings of a token from which its group is dealt over pairs of blocks.
HOT = 20_000
CELLS = 1 << 16
RUN, SENT = 1 << 20, 400_000
BASE, X60 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64((1 << 60) - 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MULTIPLIERS = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
PART_BYTES, DEAL_BYTES, BUCKET_ROWS = 4 << 20, 32 << 20, 1_000_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray | None = None, heads: tuple[int, ...] = ()):
    """Hash of each word of the values of a buffer, and how many words each value has.

    sep tells of each byte whether it parts words; for each k of heads the hashes of the words' first k bytes follow.
    """
    size = len(data)
    sep = (data == 32) | ((data >= 9) & (data <= 13)) if sep is None else sep[data]
    lower = data + np.uint8(32) * ((data >= 65) & (data <= 90)).view(np.uint8)
    start, end = ~sep, ~sep
    if size:
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        start[1:] &= sep[:-1] | edge[1:size]
        end[:-1] &= sep[1:] | edge[1:size]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size), out=total[1:], dtype=np.uint64)
    shift, count = _powers(INVERSE, size + 1)[s], np.diff(np.searchsorted(s, bounds))
    h = mix64((total[e] - total[s]) * shift + (e - s).astype(np.uint64))
    more = [mix64((total[np.minimum(s + k, e)] - total[s]) * shift + np.uint64(k << 32)) for k in heads]
    return (h, count, *more)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray | None = None):
    """Sorted distinct 60-bit tokens of each value (rank of the token's cell in the upper 4 bits), and their bounds."""
    w, count = word_hashes(data, bounds)
    at = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(at[:-1], n)
    left = np.repeat(np.minimum(count, WORDS), n)
    padded = np.concatenate([w, np.zeros(WORDS, np.uint64)])
    h = left.astype(np.uint64)
    for k in range(WORDS):
        h = h + np.where(k < left, padded[first + k] * MULTIPLIERS[k], np.uint64(0))
    x = mix64(h) >> np.uint64(4)
    if rank is not None:
        x |= rank[(x >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(60)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[ends[:-1][ends[:-1] < len(x)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return x[new], kept[ends]


def _identity(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A set's 64-bit name: the sum of its mixed tokens."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x & X60), dtype=np.uint64)])
    return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _signatures(batches):
    """(doc_id, row, n, node), and once a task its counts of tokens by cell, in 16 parts."""
    counts = np.zeros(CELLS, np.int64)
    names = ["doc_id", "row", "n", "node", "cells", "counts"]
    for batch in batches:
        for lo, hi, data, bounds in text_buffers(batch.column(2), RUN):
            x, b = shingle_sets(data, bounds)
            counts += np.bincount((x >> np.uint64(44)).astype(np.int64), minlength=CELLS)
            none = pa.nulls(hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(b)), pa.array(_identity(x, b)), none.cast(pa.int32()), none.cast(pa.binary())], names)
    none = pa.nulls(16).cast(pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(16), pa.int32()), pa.array([squeeze(c) for c in counts.reshape(16, -1)], pa.binary())], names)


def _add(table: pa.Table) -> pa.Table:
    total = sum(unsqueeze(x, "<i8")[0] for x in table.column("counts").to_pylist())
    return pa.table({"cells": table.column("cells").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _ranks(rows) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each cell its place in the global order (0: as few tokens as most cells, within four standard errors), its
    estimated cost as a multiple of what is usual, and that."""
    parts = [np.frombuffer(bytes(r["counts"]), np.int64) for r in sorted(rows, key=lambda r: r["cells"])]
    counts = np.concatenate(parts) if parts else np.zeros(CELLS, np.int64)
    usual = max(float(np.median(counts)), 1.0)
    over, sure = np.maximum(counts / usual, 1.0), 4 / np.sqrt(usual)
    hot = over - 1 > sure
    return np.where(hot, np.minimum(1 + 2 * np.log2(np.maximum((over - 1) / sure, 1)), 15), 0).astype(np.uint8), np.where(hot, over, 0.0), usual


def _dealt_hot(token: np.ndarray, blocks: np.ndarray, node: np.ndarray):
    """Rows, tokens and roles of postings: those of hot tokens once for each pair of blocks that has theirs.

    In the pair (i, i) all postings have role 0 and meet each other; in (i, j) block i has role 1 and block j role 2,
    and only different roles meet.
    """
    hot = np.flatnonzero(blocks > 1)
    row = np.repeat(hot, blocks[hot])
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks[hot]) - blocks[hot], blocks[hot])
    own = (mix64(node[row].view(np.uint64)) % blocks[row].astype(np.uint64)).astype(np.int64)
    pair = np.minimum(own, other).astype(np.uint64) << np.uint64(24) | np.maximum(own, other).astype(np.uint64)
    salted = mix64(token[row] ^ mix64(pair + np.uint64(1))) >> np.uint64(4)
    cold = np.flatnonzero(blocks == 1)
    role = np.where(own == other, 0, np.where(own < other, 1, 2))
    return np.append(cold, row), np.append(token[cold], salted), np.append(np.zeros(len(cold), np.int64), role)


def _prefixes(rank: np.ndarray, cost: np.ndarray, usual: float, buckets: int):
    """(bucket, blob of token, node, n, position, l, role) of all prefix tokens, each set once a batch."""
    many_blocks = np.maximum(1, np.ceil(np.where(cost > 0, cost - 1, 0) * usual / HOT)).astype(np.int64)

    def packed_up(got: list):
        token, node, n, pos, many = (np.concatenate(k) for k in zip(*got, strict=True))
        row, token, role = _dealt_hot(token, many_blocks[(token >> np.uint64(44)).astype(np.int64)], node)
        node, n, pos, many = node[row], n[row], pos[row], many[row] + 16 * role
        order, runs = runs_of(((token >> np.uint64(28)).astype(np.int64) * buckets) >> 32)
        blobs = []
        for _, lo, hi in runs:
            o = order[lo:hi]
            planes = np.ascontiguousarray((token[o] >> np.uint64(12)).astype("<u8").view("u1").reshape(-1, 8)[:, :6].T)
            blobs.append(squeeze(planes, node[o], n[o].astype("<u4"), pos[o].astype("<u4"), many[o].astype("u1")))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def send(batches):
        for batch in batches:
            got, held = [], 0
            seen = np.zeros(0, np.int64)
            for _, _, data, bounds in text_buffers(batch.column(0), RUN):
                x, b = shingle_sets(data, bounds, rank)
                node, n = _identity(x, b), np.diff(b)
                _, one = np.unique(node, return_index=True)
                one = one[(n[one] > 0) & ~np.isin(node[one], seen)]
                seen = np.union1d(seen, node[one])
                need = (3 * n + 3) // 4
                weight = np.concatenate([[0.0], np.cumsum(cost[((x & X60) >> np.uint64(44)).astype(np.int64)])])
                base = np.minimum(n - need + 1, n)
                heavy = weight[b[:-1] + base] - weight[b[:-1]]
                many = np.minimum(np.minimum(1 + np.ceil(np.log2(1 + heavy)).astype(np.int64), MOST), np.maximum(need, 1))
                size = np.minimum(n - need + many, n)[one]
                who = np.repeat(one, size)
                pos = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
                got.append((x[b[who] + pos] & X60, node[who], n[who], pos, many[who]))
                held += len(who)
                if held > SENT:
                    yield packed_up(got)
                    got, held = [], 0
            if held:
                yield packed_up(got)
        release_memory()

    return send


def _shared(n1, l1, n2, l2):
    """How many prefix tokens a pair must share, and its whole overlap. The prefixes reach as far as for the largest
    partner; between these two that allows min over both of (overlap - ceil(3n/4) + l) shared tokens to be asked for."""
    overlap = (3 * (n1 + n2) + 6) // 7
    return np.minimum(overlap - (3 * n1 + 3) // 4 + l1, overlap - (3 * n2 + 3) // 4 + l2), overlap


def _passes(n1, p1, l1, n2, p2, l2):
    """Length and positional filter: even if all that follows these places is shared, is it enough?"""
    shared, overlap = _shared(n1, l1, n2, l2)
    return (np.minimum(n1 - p1, n2 - p2) + shared - 1 >= overlap) & (np.minimum(n1, n2) >= overlap)


MET = "kind int, bucket long, deal long, blob binary, postings binary"
PAIRS, COUNTS, KNOWN = ("<i8", "<i8", "<i4", "<i4"), ("<i8", "<i4"), ("<i8", "<i8", "<i8", "<i8")
CROSSED = "a long, b long, ra long, rb long, l int, c int"
STARS = ["src", "dst", "star", "hub", "block", "lone"]


def _postings(blobs) -> tuple[np.ndarray, ...]:
    """token, node, n, position, l, role of packed postings."""
    planes, cols = [], [[], [], [], []]
    for blob in blobs:
        raw, *rest = unsqueeze(blob, "u1", "<i8", "<u4", "<u4", "u1")
        wide = np.zeros((len(rest[0]), 8), np.uint8)
        wide[:, :6] = raw.reshape(6, -1).T
        planes.append(wide.view("<u8").ravel().astype(np.int64))
        for to, x in zip(cols, rest, strict=True):
            to.append(x.astype(np.int64))
    token, node, n, pos, many = (np.concatenate(x) for x in (planes, *cols))
    return token, node, n, pos, many % 16, many // 16


def _met(kind: int, bucket: int, deal: list, blob: list, postings: list | None = None) -> pa.Table:
    size = len(deal)
    columns = ([kind] * size, [bucket] * size, deal, blob, postings or [None] * size)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({k.split()[0]: pa.array(x, to) for k, x, to in zip(MET.split(", "), columns, kinds, strict=True)})


def _by_deal(kind: int, bucket: int, deals: int, node: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """What a bucket has to say of nodes, one row for each deal."""
    order, runs = runs_of(node % deals)
    return _met(kind, bucket, [r[0] for r in runs], [squeeze(*(x[order[lo:hi]] for x in columns)) for _, lo, hi in runs])


def _counted(a: np.ndarray, b: np.ndarray, *more: np.ndarray):
    """Distinct pairs with what goes with them, and how often each came."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], *(x[order][at] for x in more), np.diff(np.append(at, len(a)))


def _meeting(deals: int):
    """`_meet` with that many deals."""

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, deals)

    return meet


def _meet(table: pa.Table, deals: int) -> pa.Table:
    """Of a bucket's postings: pairs of nodes with their hubs (kind 0), all that could have a partner packed again
    (kind 1), and how many of these each node has (kind 2); kinds 0 and 2 a row for each deal of nodes."""
    bucket = table.column("bucket")[0].as_py()
    token, node, n, pos, many, role = _postings(table.column("blob").to_pylist())
    order = np.argsort(token, kind="stable")
    t = token[order]
    twin = np.zeros(len(t) + 1, bool)
    twin[1:-1] = t[1:] == t[:-1]
    order = order[twin[1:] | twin[:-1]]
    order = order[np.lexsort((role[order], node[order], n[order], token[order]))]
    token, node, n, pos, many, role = (x[order] for x in (token, node, n, pos, many, role))
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1]) | (role[1:] != role[:-1])
    token, node, n, pos, many, role = (x[keep] for x in (token, node, n, pos, many, role))
    # in order of size, a posting without a partner of its length next to it has none at all
    close = np.zeros(len(token) + 1, bool)
    close[1:-1] = (token[1:] == token[:-1]) & (4 * n[:-1] >= 3 * n[1:])
    keep = close[1:] | close[:-1]
    token, node, n, pos, many, role = (x[keep] for x in (token, node, n, pos, many, role))
    if not len(token):
        return _met(0, bucket, [], [])
    length = np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)
    key = token * 128 + length
    order = np.lexsort((node, pos / n, key))
    hub = order[np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])]
    left, right = [], []
    for smaller in (0, 1):
        at = np.minimum(np.searchsorted(key[hub], key - smaller), len(hub) - 1)
        i = np.flatnonzero(key[hub[at]] == key - smaller)
        j = hub[at[i]]
        ok = (node[i] != node[j]) & ((role[i] == 0) | (role[i] != role[j])) & _passes(n[i], pos[i], many[i], n[j], pos[j], many[j])
        left.append(j[ok])
        right.append(i[ok])
    j, i = np.concatenate(left), np.concatenate(right)
    a, b, l, c = _counted(node[j], node[i], _shared(n[j], many[j], n[i], many[i])[0])  # noqa: E741
    own, count = np.unique(node, return_counts=True)
    planes = np.ascontiguousarray(token.astype("<u8").view("u1").reshape(-1, 8)[:, :6].T)
    blob = squeeze(planes, node, n.astype("<u4"), pos.astype("<u4"), (many + 16 * role).astype("u1"))
    release_memory()
    pairs = _by_deal(0, bucket, deals, b, a, b, l.astype("<i4"), c.astype("<i4"))
    return pa.concat_tables([pairs, _met(1, bucket, [None], [None], [blob]), _by_deal(2, bucket, deals, own, own, count.astype("<i4"))])


def _best(table: pa.Table) -> pa.Table:
    """Of a deal's pairs the hub (a) that each node (b) shares most prefix tokens with, if they are not too few."""
    a, b, l, c = joined(table.column("blob"), *PAIRS)  # noqa: E741
    order = np.lexsort((a, b))
    a, b, l, c = (x[order] for x in (a, b, l, c))  # noqa: E741
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, l, c = a[at], b[at], l[at], np.add.reduceat(c.astype(np.int64), at)  # noqa: E741
    enough = 4 * c >= l
    a, b, c = a[enough], b[enough], c[enough]
    order = np.lexsort((a, c, b))
    a, b = a[order], b[order]
    last = np.append(b[1:] != b[:-1], True)[: len(b)]
    return pa.table({"a": a[last], "b": b[last]})


def _told(counts: pa.Table, known: pa.Table) -> pa.Table:
    """For each bucket that counted nodes of a deal: node, shared prefix tokens in all, component, star."""
    if not len(counts):
        return pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    parts = [unsqueeze(x, *COUNTS) for x in counts.column("blob").to_pylist()]
    node, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    told = {"tot": np.bincount(at, np.concatenate([x[1] for x in parts])).astype(np.int64), "component": node.copy(), "star": node.copy()}
    for name in ("component", "star"):
        some = known.filter(known.column(name).is_valid())
        of, value = some.column("node").to_numpy(), some.column(name).to_numpy()
        to = np.minimum(np.searchsorted(node, of), len(node) - 1)
        ok = node[to] == of
        told[name][to[ok]] = value[ok]
    blobs = [squeeze(node[i], *(x[i] for x in told.values())) for i in np.split(at, np.cumsum([len(x[0]) for x in parts])[:-1])]
    return pa.table({"bucket": counts.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def _crossing(start: np.ndarray, size: np.ndarray, n: np.ndarray, comp: np.ndarray):
    """Row pairs of groups (in order of n) that may pass, some millions at a time; not yet filtered by component."""
    for k in range(2, SMALL + 1):
        g = start[size == k]
        if len(g):
            i, j = np.triu_indices(k, 1)
            yield (g[:, None] + i).ravel(), (g[:, None] + j).ravel()
    for s, k in zip(start[size > SMALL], size[size > SMALL], strict=True):
        if (comp[s : s + k] == comp[s]).all():
            continue
        longest = s + np.searchsorted(n[s : s + k], n[s : s + k] * 4 // 3, "right")
        for at in range(s, s + k, 256):
            end = min(at + 256, s + k)
            for to in range(at, longest[end - 1 - s], 8192):
                last = min(to + 8192, longest[end - 1 - s])
                i, j = np.nonzero(comp[at:end, None] != comp[to:last])
                ok = to + j > at + i
                yield at + i[ok], to + j[ok]


def _cross(postings: pa.Table, nodes: pa.Table) -> pa.Table:
    """Of a bucket's postings the pairs between components that pass the filters, counted."""
    names = [x.split()[0] for x in CROSSED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    none = pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    if not len(postings) or not len(nodes):
        return none
    known, tot, root, star = joined(nodes.column("blob"), *KNOWN)
    order = np.argsort(known)
    known, tot, root, star = known[order], tot[order], root[order], star[order]
    token, node, n, pos, many, role = _postings(postings.column("postings").to_pylist())
    order = np.lexsort((node, n, token))
    token, node, n, pos, many, role = (x[order] for x in (token, node, n, pos, many, role))
    at = np.searchsorted(known, node)
    tot, comp, star = tot[at], root[at], star[at]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    out, some, rows = [], [], 0

    def add():
        if some:
            i, j = (np.concatenate(x) for x in zip(*some, strict=True))
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append(_counted(node[i], node[j], comp[i], comp[j], _shared(n[i], many[i], n[j], many[j])[0]))
            some.clear()

    for i, j in _crossing(start, np.diff(np.append(start, len(token))), n, comp):
        ok = (comp[i] != comp[j]) & (star[i] != star[j]) & ((role[i] == 0) | (role[i] != role[j]))
        i, j = i[ok], j[ok]
        ok = _passes(n[i], pos[i], many[i], n[j], pos[j], many[j]) & (np.minimum(tot[i], tot[j]) >= _shared(n[i], many[i], n[j], many[j])[0])
        if ok.any():
            some.append((i[ok], j[ok]))
            rows += ok.sum()
            if rows > 1 << 19:
                add()
                rows = 0
    add()
    release_memory()
    if not out:
        return none
    return pa.Table.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _row():
    """What a row's text is dealt and looked up by: ids may be null or repeated."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text")


def _extract(documents: pa.Table, asked: pa.Table) -> pa.Table:
    """The sets of the documents asked for (48 bits of each token), once for each group that asks."""
    want: dict[tuple[int, int], list] = {}
    for row, node, group in zip(*(asked.column(k).to_pylist() for k in ("row", "node", "group")), strict=True):
        want.setdefault((row, node), []).append(group)
    rows = {row for row, _ in want}
    out = [[], [], []]
    for ids, data, bounds, _ in unpacked(documents.column("blob"), RUN) if want else ():
        if not any(i in rows for i in ids.tolist()):
            continue
        x, b = shingle_sets(data, bounds)
        node = _identity(x, b)
        short = np.ascontiguousarray((x >> np.uint64(12)).astype("<u8").view("u1").reshape(-1, 8)[:, :6])
        for k, i in enumerate(ids.tolist()):
            for group in want.pop((i, int(node[k])), ()):
                for to, v in zip(out, (group, node[k], short[b[k] : b[k + 1]].tobytes()), strict=True):
                    to.append(v)
    return pa.table({"group": pa.array(out[0], pa.int32()), "node": pa.array(out[1], pa.int64()), "tokens": pa.array(out[2], pa.binary())})


def _tokens(value) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _verify(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """The components (src, dst) of a group's pairs that reach the threshold, by their whole sets."""
    found = set()
    tokens = sets.column("tokens").combine_chunks()
    at = {m: k for k, m in enumerate(sets.column("node").to_pylist())}
    last, own = None, None
    for a, b, ra, rb in sorted(zip(*(pairs.column(k).to_pylist() for k in ("a", "b", "ra", "rb")), strict=True)):
        if (ra, rb) in found:
            continue
        if a != last:
            last, own = a, _tokens(tokens[at[a]])
        other = _tokens(tokens[at[b]])
        both = _overlap(own, other)
        if 100 * both >= 75 * (len(own) + len(other) - both):
            found.add((ra, rb))
    src, dst = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _linking(sets: list[np.ndarray]):
    """A function that tells of a set's number which sets reach the threshold with it, and the work of a call."""
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(len(sets)), size), np.cumsum(size)
    mark = np.zeros(len(flat) + 1, bool)

    def linking(pivot: int) -> np.ndarray:
        own = flat[ends[pivot] - size[pivot] : ends[pivot]]
        mark[own] = True
        both = np.bincount(owner[mark[flat]], minlength=len(sets))
        mark[own] = False
        return 100 * both >= 75 * (size + len(own) - both)

    return linking, len(flat)


def _pivot_links(nodes: list[int], sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], bool, np.ndarray]:
    """Links of the first node, the hub, and of further pivots with all others, until all are joined up or every node
    outside the largest component has been a pivot: then no pair between components is left open (True). Groups that
    would take more than WORK token comparisons are left open after PIVOTS. Of each node also whether it is in the
    largest component (0) or not (1); 2 for all if the hub is not in it."""
    linking, work = _linking(sets)
    label, links, pivot = np.arange(len(sets)), [], 0
    tried = np.zeros(len(sets), bool)
    for k in range(1 << 62):
        tried[pivot] = True
        hit = np.flatnonzero(linking(pivot) & (label != label[pivot]))
        if len(hit):
            links += [(nodes[pivot], nodes[j]) for j in hit]
            joined = np.isin(label, np.append(label[hit], label[pivot]))
            label[joined] = label[joined].min()
        most = label == np.bincount(label).argmax()
        rest = np.flatnonzero(~tried & ~most)
        if not len(rest):
            return links, True, (~most).astype(int) if most[0] else np.full(len(sets), 2)
        if k + 1 >= PIVOTS and (k + 1 + len(rest)) * work > WORK:
            return links, False, np.full(len(sets), 2)
        if k % 2 and k < PIVOTS and (~tried & most).any():
            rest = np.flatnonzero(~tried & most)
        pivot = int(rest[len(rest) // 2])


def _stars(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links (src, dst) of a group's hubs (a), with those that come to them (b), and of further pivots; of what came to
    a hub and has no open pair there also its star, hub and block, and how it stands there (lone, by `_pivot_links`)."""
    links, settled = [], []
    tokens = sets.column("tokens").combine_chunks()
    at = {m: k for k, m in enumerate(sets.column("node").to_pylist())}
    members: dict[tuple[int, int], list[int]] = {}
    for a, b, block in zip(*(pairs.column(k).to_pylist() for k in ("a", "b", "block")), strict=True):
        members.setdefault((a, block), []).append(b)
    for (a, block), those in sorted(members.items()):
        nodes = [a, *sorted(those)]
        found, closed, lone = _pivot_links(nodes, [_tokens(tokens[at[m]]) for m in nodes])
        links += [(*x, None, None, None, None) for x in found]
        star = int(mix64(np.array([a], np.int64).view(np.uint64) + np.uint64(block)).view(np.int64)[0])
        settled += [(m, None, star, a, block, int(k)) for m, k in zip(nodes[1:], lone[1:], strict=True)] if closed else []
    columns = zip(*links, *settled, strict=True) if links or settled else [()] * 6
    return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(STARS, columns, strict=True)})


def _across(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links (src, dst) of a hub's lone nodes of other blocks (guest) with this block's nodes, as many as join them up."""
    links = []
    tokens = sets.column("tokens").combine_chunks()
    at = {m: k for k, m in enumerate(sets.column("node").to_pylist())}
    members: dict[tuple[int, int], list[tuple[bool, int, int]]] = {}
    for a, b, block, lone, guest in zip(*(pairs.column(k).to_pylist() for k in ("a", "b", "block", "lone", "guest")), strict=True):
        members.setdefault((a, block), []).append((guest, lone, b))
    for _, those in sorted(members.items()):
        those = sorted(those)
        guest, lone = (np.array([x[k] for x in those], bool) for k in (0, 1))
        if guest.all() or not guest.any():
            continue
        linking, _ = _linking([_tokens(tokens[at[x[2]]]) for x in those])
        label = np.arange(len(those))
        label[~lone] = 0  # those in the hub's component come first
        for pivot in np.flatnonzero(guest):
            hit = np.flatnonzero(linking(pivot) & ~guest & (label != label[pivot]))
            if len(hit):
                _, one = np.unique(label[hit], return_index=True)
                links += [(those[pivot][2], those[j][2]) for j in hit[one]]
                joined = np.isin(label, np.append(label[hit], label[pivot]))
                label[joined] = label[joined].min()
    src, dst = zip(*links, strict=True) if links else ((), ())
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _part(parts: int):
    return F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")


def _blocks(pairs: DataFrame, home: str, member: str) -> DataFrame:
    """pairs with a block for each TOGETHER of the pairs of one home."""
    n = pairs.groupBy(home).agg(F.count("*").alias("d"))
    return pairs.join(n, home).withColumn("block", F.pmod(F.xxhash64(member), F.ceil(F.col("d") / TOGETHER))).drop("d")


def _compared(pairs: DataFrame, home: str, docs: DataFrame, first: DataFrame, parts: int, groups: int, verify, schema: str = "src long, dst long") -> DataFrame:
    """verify(sets, pairs) over groups of homes and blocks, as a table: each set comes once to a group that needs it."""
    pairs = pairs.withColumn("group", F.pmod(F.xxhash64(home, "block"), F.lit(groups)).cast("int"))
    asked = pairs.select("group", F.col("a").alias("node")).union(pairs.select("group", F.col("b").alias("node"))).distinct()
    asked = asked.join(first, "node").select(_part(parts), "row", "node", "group")
    dealt = packed(docs.select(_row().alias("doc_id"), "text"), parts)
    sets = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_extract, "group int, node long, tokens binary")
    return written(sets.groupBy("group").cogroup(pairs.groupBy("group")).applyInArrow(verify, schema))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    modest_batches(docs.sparkSession)
    return settled(docs.sparkSession, lambda: _components(plain(docs)))


def _components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    total = text_bytes(docs)
    parts, buckets = max(2 * partitions(spark), total // PART_BYTES), max(partitions(spark), total // 24 // BUCKET_ROWS)
    deals = 1 + total // DEAL_BYTES
    signed = written(docs.select("doc_id", _row().alias("row"), "text").mapInArrow(_signatures, "doc_id long, row long, n long, node long, cells int, counts binary"))
    rank, cost, usual = _ranks(signed.where("cells is not null").groupBy("cells").applyInArrow(_add, "cells int, counts binary").collect())
    signed = signed.where("cells is null").select("doc_id", "row", "n", "node")
    first = written(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))
    places = first.select("node", "row")
    sent = docs.select("text").mapInArrow(_prefixes(rank, cost, usual, buckets), "bucket long, blob binary")
    met = written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meeting(deals), MET))

    best = written(met.where("kind = 0").groupBy("deal").applyInArrow(_best, "a long, b long"))
    links = _compared(_blocks(best, "a", "b"), "a", docs, places, parts, parts, _stars, ", ".join(f"{k} long" for k in STARS))
    settled, joined_up = links.where("star is not null").withColumnRenamed("src", "node"), links.where("dst is not null").select("src", "dst")
    # hubs of several blocks that are settled each: lone nodes meet the other blocks
    known = settled.groupBy("hub").agg(F.max("lone").alias("worst"), F.count("*").alias("n"))
    all_of = best.groupBy(F.col("a").alias("hub")).agg(F.count("*").alias("d"))
    several = written(all_of.where(F.col("d") > TOGETHER).join(known, "hub").where("n = d and worst < 2").select("hub", F.ceil(F.col("d") / TOGETHER).alias("blocks")))
    if not several.isEmpty():
        own = settled.join(several, "hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "block", "lone", "blocks")
        guests = own.where("lone = 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to != block")
        rows = own.select("a", "b", "block", "lone", F.lit(False).alias("guest")).union(guests.select("a", "b", "to", "lone", F.lit(True)))
        joined_up = joined_up.union(_compared(rows, "a", docs, places, parts, parts, _across))
        settled = settled.join(several, "hub", "left").withColumn("star", F.when(F.col("blocks").isNotNull(), F.xxhash64("hub")).otherwise(F.col("star")))
    roots = connected_components(joined_up).withColumnRenamed("id", "node")
    none = F.lit(None).cast("long")
    stands = roots.select("node", "component", none.alias("star")).union(settled.select("node", none, "star"))
    stands = stands.withColumn("deal", F.pmod("node", F.lit(deals)))

    counts = met.where("kind = 2").select("deal", "bucket", "blob")
    nodes = counts.groupBy("deal").cogroup(stands.groupBy("deal")).applyInArrow(_told, "bucket long, blob binary")
    postings = met.where("kind = 1").select("bucket", "postings")
    crossed = postings.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(_cross, CROSSED)
    crossed = written(crossed.groupBy("a", "b", "ra", "rb", "l").agg(F.sum("c").alias("c")).where("c >= l").drop("l", "c"))
    joins = _compared(_blocks(crossed, "ra", "b"), "ra", docs, places, parts, parts, _verify)
    joined = connected_components(joins).select(F.col("id").alias("component"), F.col("component").alias("whole"))

    named = first.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node")).join(joined, "component", "left")
    named = named.select("node", "doc_id", F.coalesce("whole", "component").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    out = signed.join(named.withColumn("some", F.lit(True)), (signed.node == named.node) & (signed.n > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
