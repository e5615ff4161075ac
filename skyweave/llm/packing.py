"""Packing along a space-filling curve.

Token ids are hashed to fixed random directions; their mean is a document's vector in DIMS dimensions. Quantised, it
gives a Hilbert key; documents are range-sorted by that key (then by a hash of doc_id, so that equal texts part as
finely as any others) and laid end to end into sequences of SEQUENCE tokens: neighbours on the curve share sequences,
and only the last sequence is padded. Range bounds are quantiles of all keys; a range's place in the whole is the sum
of token counts before it.

Ids are those of the whole text: the tokenizer drops white space, ignores case and never joins letters with digits or
signs, so texts are cut there (`_units`, in numpy, over about a MB of texts), the units are dictionary-encoded by Arrow, and
each distinct one is encoded once and kept (`Known`; `encode` is tested against whole texts). Units of lower-case Latin-1 letters
alone are words already, and go to the tokenizer's model without its normalizer and splitter. Ids of all occurrences and
the sums of their directions come from array look-ups.

Null text counts as empty (its only id is the end id); rows with a null doc_id are packed too; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, modest_batches, partitions, plain, release_memory, text_buffers, written
from .fit_packing import _letters

SEQUENCE, END = 4096, 2
DIMS, BITS, SCALE = 4, 6, 0.12
RANGE_TOKENS, KNOWN, SUPER = 2 << 20, 200_000, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TOGETHER, TEXT_BYTES = 200, 1 << 20
#: The tokenizer's own mark between texts, by which units are told apart that are encoded in one call.
MARK = "<|endoftext|>"
#: Units that the tokenizer neither changes nor cuts.
WORD = re.compile("[a-zß-öø-ÿ]+")
#: Bytes of such units that byte-level vocabularies have another character for.
SHOWN = [(chr(b), c) for c, b in _letters().items() if b in b"\x9f\xa0\xad"]
_known: dict[str, Known] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte: 0 ASCII white space, 1 (part of a) letter up to U+00FF, 2 digit, 3 apostrophe, 4 other ASCII, 5 part of another character."""
    kind = np.full(256, 4, np.uint8)
    kind[[9, 10, 13, 32]] = 0
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    kind[39] = 3
    kind[128:] = 5
    kind = kind[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] | 0x20) != 0xB7]  # but the signs of multiplication and division
    kind[lead] = kind[lead + 1] = 1
    return kind


def _lower(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The bytes with letters up to U+00FF in lower case, but for letters before other characters: these may compose."""
    upper = (data >= 65) & (data <= 90)
    after = np.flatnonzero((data[:-1] == 0xC3) & (kind[:-1] == 1)) + 1
    upper[after] = data[after] <= 0x9E
    upper[:-1] &= kind[1:] != 5
    return data + np.uint8(32) * upper.view(np.uint8)


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of a buffer of texts that the tokenizer encodes independently, and how many each text has.

    Cuts are made at ASCII white space, on both sides of an ASCII digit, and between a letter up to U+00FF and an ASCII sign
    (not from an apostrophe to a letter: that may be a contraction); next to other characters only at white space.
    """
    kind = _kinds(data)
    lower = _lower(data, kind)
    size = len(data)
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    a, b = kind[:-1], kind[1:]
    cut[1:size] |= (a == 0) != (b == 0)
    if MARK.split("|")[0].encode() + b"|" in lower.tobytes():  # the tokenizer's own marks stay whole
        lower = data
    else:
        plain = (a != 0) & (b != 0) & (a != 5) & (b != 5)
        cut[1:size] |= plain & ((a == 2) | (b == 2) | ((a == 1) & (b >= 3)) | ((a == 4) & (b == 1)))
    at = np.flatnonzero(cut[:size])
    at = at[kind[at] != 0]
    solid = kind != 0
    place = np.cumsum(solid, dtype=np.int32)
    offsets = np.append(place[at] - 1, place[-1:] if size else 0).astype(np.int32)
    units = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lower[solid]))])
    return units, np.diff(np.searchsorted(at, bounds))


class Known:
    """Units that a tokenizer has encoded, with their ids one after another. Beyond KNOWN units those go that were met
    in the fewest buffers, so that words of all texts stay and those of a single text do not push them out."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.words, self.last = _word_tokenizer(path)
        self.units, self.ids = pa.array([], pa.string()), np.zeros(0, "<u2")
        self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units, new ones last."""
        if len(self.units) > KNOWN:
            self._shrink()
        at = pc.index_in(units, value_set=self.units)
        new = units.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[at < 0] = len(self.units) + np.arange(len(new))
            ids, size = self._encoded(new.to_numpy(zero_copy_only=False).tolist())
            self.units = pa.concat_arrays([self.units, new])
            self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
            self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.met[at] += 1
        return at

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.met, kind="stable")[: KNOWN // 2])
        first = np.cumsum(self.size) - self.size
        self.ids = self.ids[_runs(first[keep], self.size[keep])]
        self.units, self.size, self.met = self.units.take(pa.array(keep)), self.size[keep], self.met[keep] // 2

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new, one unit after another, and how many each has."""
        word = np.fromiter(map(bool, map(WORD.fullmatch, new)), bool, len(new)) if self.words else np.zeros(len(new), bool)
        odd = np.array([self.mark is None or "<|" in w for w in new]) & ~word
        size, first, ids, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        for some, encode in ((word, self._of_words), (odd, self._of_each), (~word & ~odd, self._of_marked)):
            if some.any():
                got, n = encode([new[k] for k in np.flatnonzero(some).tolist()])
                size[some], first[some] = n, at + np.cumsum(n) - n
                ids.append(got)
                at += len(got)
        return np.concatenate(ids)[_runs(first, size)], size

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._of_groups(self.words, [_shown(" ".join(words[at : at + TOGETHER])) for at in range(0, len(words), TOGETHER)])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _of_each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _of_marked(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._of_groups(self.tokenizer, [MARK.join([*units[at : at + TOGETHER], ""]) for at in range(0, len(units), TOGETHER)])
        marked = ids == self.mark
        return ids[~marked], np.diff(np.flatnonzero(marked), prepend=-1) - 1

    @staticmethod
    def _of_groups(tokenizer, groups: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(groups), 64):
            out += [np.array(e.ids, "<u2") for e in tokenizer.encode_batch_fast(groups[at : at + 64], add_special_tokens=False)]
        return np.concatenate(out)


def _word_tokenizer(path: str):
    """The model of the tokenizer at path for words parted by spaces, their bytes as `_shown`, and of each id whether it
    ends a word; (None, None) if the file is not made so."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    vocab, suffix = model.get("vocab", {}), model.get("end_of_word_suffix")
    plain = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
    if not plain or not suffix or model.get("dropout") or any(c not in vocab or c + suffix not in vocab for c in _letters()):
        return None, None
    last = np.zeros(1 << 16, bool)
    last[[k for w, k in vocab.items() if w.endswith(suffix)]] = True
    own = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(own)), last


def _shown(words: str) -> str:
    """Words with each byte as the character that byte-level vocabularies have for it, spaces as they are."""
    if words.isascii():
        return words
    words = words.encode().decode("latin-1")
    for byte, shown in SHOWN:
        words = words.replace(byte, shown)
    return words


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of that first place and size, one run after another."""
    total = np.cumsum(size)
    return np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def encoded(data: np.ndarray, bounds: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a buffer by the tokenizer at path, without special tokens, each text with the end id after
    them (all below 65,536), and the bounds of the texts in them."""
    if path not in _known:
        _known[path] = Known(path)
    known = _known[path]
    units, count = _units(data, bounds)
    coded = units.dictionary_encode()
    at = known.places(coded.dictionary)[coded.indices.to_numpy()]
    size = known.size[at]
    total = np.concatenate([[0], np.cumsum(size)])
    ends = total[np.concatenate([[0], np.cumsum(count)])] + np.arange(len(count) + 1)  # with the end ids before
    out = np.full(int(ends[-1]), END, "<u2")
    inner = np.ones(len(out), bool)
    inner[ends[1:] - 1] = False
    out[inner] = known.ids[_runs((np.cumsum(known.size) - known.size)[at], size)]
    return out, ends


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """`encoded` of each text."""
    (_, _, data, bounds), = text_buffers(pa.array(texts, pa.string()), 1 << 62) if texts else [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    ids, ends = encoded(data, bounds, path)
    return [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _directions(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (1 << 16, DIMS)).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) below 2**bits: coordinates to the transposed index by
    undoing the curve's reflections and rotations bit by bit, then a Gray decode."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _keyed(path: str):
    """(key, doc_id, n, ids) of each document."""

    def keyed(batches):
        directions = _directions()
        for batch in batches:
            for lo, hi, data, bounds in text_buffers(batch.column(1), TEXT_BYTES):
                doc = batch.column(0).slice(lo, hi - lo)
                ids, ends = encoded(data, bounds, path)
                n = np.diff(ends)
                mean = np.stack([np.add.reduceat(directions[:, k][ids], ends[:-1]) for k in range(DIMS)], 1) / n[:, None]
                cells = 1 << BITS
                points = np.minimum((0.5 + 0.5 * np.tanh(mean / SCALE)) * cells, cells - 1)
                # rows without an id part by their place in the batch
                name = np.where(doc.is_null().to_numpy(zero_copy_only=False), np.arange(lo, hi), doc.fill_null(0).to_numpy(zero_copy_only=False))
                key = (hilbert_key(points, BITS) << 28) | (mix64(name.astype(np.uint64)) >> np.uint64(36)).astype(np.int64)
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(key), doc, pa.array(n), blobs], ["key", "doc_id", "n", "ids"])
        release_memory()

    return keyed


def _flat(ids: pa.Array) -> np.ndarray:
    """The ids of all rows, one row after another."""
    ids = ids.cast(pa.large_binary())
    lo, hi = np.frombuffer(ids.buffers()[1], np.int64)[[ids.offset, ids.offset + len(ids)]]
    return np.frombuffer(ids.buffers()[2], "<u2")[lo // 2 : hi // 2]


def _laid():
    """The pieces of a range's documents, from its first place (base) on."""

    def lay(table: pa.Table) -> pa.Table:
        base = table.column("base")[0].as_py()
        table = table.select(["key", "doc_id", "n", "ids"]).sort_by([("key", "ascending"), ("doc_id", "ascending")])
        n = table.column("n").to_numpy()
        ids = np.concatenate([_flat(chunk) for chunk in table.column("ids").chunks])
        end = base + int(n.sum())
        first = base + np.cumsum(n) - n
        at = np.union1d(first, np.arange(base + -base % SEQUENCE, end, SEQUENCE))
        length = np.diff(at, append=end)
        doc = np.searchsorted(first, at, "right") - 1
        crc = [zlib.crc32(ids[lo:hi].astype("<u4")) for lo, hi in zip((at - base).tolist(), (at - base + length).tolist(), strict=True)]
        columns = [table.column("doc_id").take(pa.array(doc)), at - first[doc], length, crc, n[doc], at // SEQUENCE, at % SEQUENCE]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in PIECES.split(", ")])

    return lay


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    modest_batches(spark)
    path = tokenizer or default_tokenizer()
    docs = plain(docs)
    keyed = written(docs.mapInArrow(_keyed(path), "key long, doc_id long, n long, ids binary"))
    total = keyed.agg(F.sum("n")).first()[0] or 0
    ranges = max(partitions(spark), total // RANGE_TOKENS)
    bounds = keyed.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if total else []
    bounds = np.unique(np.array(bounds, np.float64))  # keys are below 2**53

    def ranged(rows: DataFrame) -> DataFrame:
        if not len(bounds):
            return rows.withColumn("range", F.lit(0))
        cut = Bucketizer(splits=[-np.inf, *bounds.tolist(), np.inf], inputCol="at", outputCol="range")
        return cut.transform(rows.withColumn("at", F.col("key").cast("double"))).drop("at").withColumn("range", F.col("range").cast("int"))

    tokens = ranged(keyed.select("key", "n")).groupBy("range").agg(F.sum("n").alias("n"))
    tokens = written(tokens.withColumn("super", F.floor(F.col("range") / SUPER)))
    starts, at = [(-1, 0)], 0  # of every SUPER ranges, so that the driver holds few
    for r in sorted(tokens.groupBy("super").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["super"]):
        starts.append((r["super"], at))
        at += r["n"]
    before = F.sum("n").over(Window.partitionBy("super").orderBy("range")) - F.col("n")
    bases = tokens.withColumn("before", before).join(spark.createDataFrame(starts, "super long, start long"), "super")
    bases = bases.select("range", (F.col("start") + F.col("before")).alias("base"))
    return ranged(keyed).join(bases, "range").groupBy("range").applyInArrow(_laid(), PIECES)
