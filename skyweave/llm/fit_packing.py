"""Best-fit packing with a swap-based local search.

A document's ids, with the end id after them, are cut only if there are more than SEQUENCE: the first piece takes the
remainder, all others are full. Full pieces are sequences of their own; the others are dealt at random into groups of
some GROUP pieces, each packed in one task:

* best fit, largest pieces first, starts the search (bins by the room they have left, one bit for each room);
* then documents move between underfull bins: one moves over, one is exchanged for a smaller one, or two for one, always
  so that the fuller bin gains and the sum of squared fills grows; bins that lose all they hold are gone. A group is
  done when no step is left or when it has as few bins as its sizes allow at all.

Bins with SLACK or more to spare are dealt again, whole, in fewer groups, up to TURNS times in all: what one group has
too many of, another lacks. A step knows pieces by length only, so a group holds a few
numbers for each piece, whatever the texts are. Rows are dealt by their place in a written table, so that copies of a
document, or rows without an id, part like any others.

Ids come from tiktoken with the ranks of the tokenizer file where its merges are in the order of their ids (a test
compares with tokenizers over whole texts), else from tokenizers. The end-of-text mark in a text is one id in both.

Null text counts as empty (its only id is the end id); rows with a null doc_id are packed too; repeated rows are packed
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, release_memory, written

SEQUENCE, END = 1024, 2
GROUP, SLACK, TURNS = 65_536, 16, 3
LONGEST = 1 << 20  #: characters that go to the splitting pattern at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- ids --------------------------------------------------------------------------------------------------------
#: The splitting pattern of byte-level tokenizer files that use their own (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves,
    the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def encoder(path: str):
    """text to ids (an array of uint32) by the tokenizer file at path, without special tokens added."""
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    slow = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model.get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
    if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        _encoders[path] = slow
        return slow
    import tiktoken

    byte = _letters()
    ranks = {bytes(byte[c] for c in word): k for word, k in vocab.items()}
    marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={b: k for b, k in ranks.items() if k not in marks.values()}, special_tokens=marks)
    allowed = set(marks)

    def encode(text: str) -> np.ndarray:
        return slow(text) if len(text) > LONGEST else np.asarray(fast.encode_to_numpy(text, allowed_special=allowed), "<u4")

    _encoders[path] = encode
    return encode


def _pieces(path: str):
    def pieces(batches):
        encode = encoder(path)
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                raw, n = memoryview(ids).cast("B"), len(ids)
                ends = range((n - 1) % SEQUENCE + 1, n + 1, SEQUENCE)
                for k, end in enumerate(ends):
                    start = max(0, end - SEQUENCE) if k else 0
                    for to, v in zip(out, (doc, k, start, end - start, zlib.crc32(raw[4 * start : 4 * end])), strict=True):
                        to.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        release_memory()

    return pieces


# --- packing of one group ---------------------------------------------------------------------------------------
def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins below which no packing goes: pieces of more than half share no bin, and for each k the small
    pieces of k or more need what the large ones of at most capacity - k leave."""
    count = np.bincount(sizes, minlength=capacity + 1)
    some, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, 0
    for k in range(half + 1):
        alone, large = some[capacity] - some[capacity - k], some[capacity - k] - some[half]
        room = large * capacity - (weight[capacity - k] - weight[half])
        small = weight[half] - (weight[k - 1] if k else 0)
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that has room."""
    rooms: list[list] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for s in sorted(sizes, reverse=True):
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, []
            bins.append(b)
        b.append(s)
        rooms[room - s].append(b)
        mask |= 1 << (room - s)
    return bins


class Search:
    """Steps between underfull bins. `one` and `two` list, for a size or for the sum of two, the bins that hold them,
    emptiest first; entries of bins that have changed since are dropped when they come up."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.fill = [sum(b) for b in bins]
        self.live = sum(f > 0 for f in self.fill)
        self.one: dict[int, list] = {}
        self.two: dict[int, list] = {}
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        fill = self.fill[b]
        if not 0 < fill < self.capacity:
            return
        held = sorted(set(self.bins[b]))
        for k, s in enumerate(held):
            heapq.heappush(self.one.setdefault(s, []), (fill, b))
            for t in held[k:]:
                if s != t or self.bins[b].count(s) > 1:
                    heapq.heappush(self.two.setdefault(s + t, []), (fill, b, s))

    def _holds(self, b: int, s: int, t: int) -> bool:
        has = self.bins[b]
        return s in has and t in has and (s != t or has.count(s) > 1)

    def _emptiest(self, table: dict, key: int, gaining: int, below: int) -> tuple[int, list[int]] | None:
        """The emptiest bin other than `gaining`, filled less than `below`, with a piece (or two) of that size."""
        heap, aside, found = table.get(key), None, None
        while heap:
            fill, b, *s = heap[0]
            parts = [key] if not s else [s[0], key - s[0]]
            if fill != self.fill[b] or not (self._holds(b, *parts) if s else key in self.bins[b]):
                heapq.heappop(heap)
            elif b == gaining and aside is None:
                aside = heapq.heappop(heap)
            else:
                found = (b, parts) if fill < below and b != gaining else None
                break
        if aside:
            heapq.heappush(heap, aside)
        return found

    def step(self, b: int) -> bool:
        """Bin b gains as much as it can by one step at the cost of a bin that stays emptier than b gets."""
        fill, held = self.fill[b], set(self.bins[b])
        for gain in range(self.capacity - fill, 0, -1):
            below = fill + gain
            for out in (0, *held):
                for table in (self.one, self.two) if out else (self.one,):
                    found = self._emptiest(table, out + gain, b, below)
                    if found:
                        self._swap(b, [out] if out else [], *found)
                        return True
        return False

    def _swap(self, b: int, out: list[int], a: int, parts: list[int]) -> None:
        for s in parts:
            self.bins[a].remove(s)
        for s in out:
            self.bins[b].remove(s)
        self.bins[a] += out
        self.bins[b] += parts
        for x in (a, b):
            self.fill[x] = sum(self.bins[x])
            self._enter(x)
        self.live -= not self.fill[a]

    def run(self, least: int) -> list[list[int]]:
        moved = True
        while moved and self.live > least:
            moved = False
            for b in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: -self.fill[b]):
                while 0 < self.fill[b] < self.capacity and self.live > least and self.step(b):
                    moved = True
        return [b for b in self.bins if b]


def packed_bins(sizes: list[int], capacity: int, start: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of sizes, from best fit or from `start` where that has fewer bins, improved by the search."""
    bins = best_fit(sizes, capacity)
    if start is not None and len(start) < len(bins):
        bins = [list(b) for b in start]
    least = least_bins(sizes, capacity) if sizes else 0
    return Search(bins, capacity).run(least) if len(bins) > least else bins


def _packed(capacity: int):
    """A group's rows with bin, fill and offset in place of those they came with."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        sizes = table.column("length").to_pylist()
        start: dict[int, list[int]] = {}
        for b, s in zip(table.column("bin").to_pylist(), sizes, strict=True):
            if b is not None:
                start.setdefault(b, []).append(s)
        bins = sorted((sorted(b, reverse=True) for b in packed_bins(sizes, capacity, list(start.values()) or None)), reverse=True)
        places: dict[int, list] = {}
        for k in range(len(bins) - 1, -1, -1):
            at = 0
            for s in bins[k]:
                places.setdefault(s, []).append((k, sum(bins[k]), at))
                at += s
        rows = [places[s].pop() for s in sizes]
        for k, name in enumerate(("bin", "fill", "offset")):
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array([r[k] for r in rows], pa.int64()))
        return table

    return pack


# --- packing of a table -----------------------------------------------------------------------------------------
def fit_pack(docs: DataFrame, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = written(docs.mapInArrow(_pieces(tokenizer or default_tokenizer()), PIECES)).withColumn("uid", F.monotonically_increasing_id())
    names = [x.split()[0] for x in PIECES.split(", ")]
    full = F.col("length") == SEQUENCE
    done = cut.where(full).select(*names, (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = F.lit(None).cast("long")
    rest = written(cut.where(~full).withColumns({"bin": none, "fill": none, "offset": none, "deal": F.xxhash64("uid")}))
    n, turn = rest.count(), 1
    while n:
        groups = -(-n // group)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(groups)))
        dealt = dealt.withColumn("bin", F.when(F.col("bin").isNotNull(), F.col("deal")))
        tried = written(dealt.groupBy("part").applyInArrow(_packed(SEQUENCE), dealt.schema))
        more, turn = turn < TURNS and groups > 1, turn + 1
        open_ = F.col("fill") <= SEQUENCE - SLACK if more else F.lit(False)
        number = F.col("part") * (1 << 20) + F.col("bin")
        done = done.union(tried.where(~open_).select(*names, (number * 4 + turn - 1).alias("sequence_id"), "offset"))
        rest = tried.where(open_).withColumn("deal", number).drop("part")
        n = rest.count() if more else 0
    return done
