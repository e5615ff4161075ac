"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces and scores come from a public model file. White space markers (U+2581) stand for spaces, one before the text.
No piece holds a marker after another character (checked when the model is read), so the best path of a text is that
of its units, a run of markers with what follows; distinct units are solved once a task, many side by side: at every
byte position all units' walks go through the trie together; in a unit of more than LONG bytes the walks from all its
positions do. A character that no piece covers becomes byte pieces with
a score below all others; so does a marker in the text itself, which makes decoding exact.

Null text counts as empty (no pieces). Rows are independent: repeated rows and null ids pass through; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
KNOWN, TOGETHER, LONG, BLOCK = 400_000, 4096, 512, 1 << 16
_models: dict[str, Model] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, scores and their double-array trie: child of node s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.score = np.array([sp.get_score(i) for i in range(size)])
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        words = [(p, i) for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s]
        if bad := [p for p, _ in words if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces with a marker inside: {bad[:3]}")
        self.fallback = float(min(self.score[i] for _, i in words)) - 10
        self.build({p.encode(): i for p, i in words})
        self.text_of = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(self.pieces, self.is_byte, strict=True)]
        self.known: dict[str, tuple[bytes, float]] = {}
        #: A marker of the text itself, as byte pieces.
        self.own = self.byte_ids[list(MARK.encode())].astype("<u4").tobytes(), len(MARK.encode()) * self.fallback

    def build(self, words: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for w, i in words.items():
            s = 0
            for c in w:
                t = children[s].get(c)
                if t is None:
                    t = len(children)
                    children.append({})
                    value.append(-1)
                    children[s][c] = t
                s = t
            value[s] = i
        room = 2 * len(children) + 1024
        base, check, ids, used = np.zeros(room, np.int64), np.full(room, -1), np.full(room, -1), np.zeros(room, bool)
        used[0], place, free, top = True, {0: 0}, 257, 257
        for s, kids in enumerate(children):
            if not kids:
                continue
            codes = np.array(sorted(kids))
            while used[free]:
                free += 1
            # a lone child takes the first free slot it can; others look near the end, where few are taken
            b = (free if len(codes) == 1 else max(free, top - 64)) - int(codes[0]) - 1
            while True:
                if b + 258 > len(used):
                    base, check, ids, used = (np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (ids, -1), (used, False)))
                if not used[b + codes + 1].any():
                    break
                b += 1
            at = place[s]
            base[at], top = b, max(top, b + int(codes[-1]) + 1)
            for c in codes.tolist():
                t = b + c + 1
                used[t], check[t], place[kids[c]], ids[t] = True, at, t, value[kids[c]]
        self.base, self.check, self.ids = (np.concatenate([x, np.full(258, fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (ids, -1)))

    def solve(self, units: list[bytes]) -> list[tuple[bytes, float]]:
        """Best path of each unit: (ids as uint32 bytes, score)."""
        size = np.array([len(u) for u in units])
        longest = int(size.max())
        text = np.zeros((len(units), longest + 1), np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        row = np.repeat(np.arange(len(units)), size)
        text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        best = np.full((len(units), longest + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(units), longest + 1), np.int64)
        piece = np.full((len(units), longest + 1), -1)
        width = np.array([1] * 128 + [1] * 64 + [2] * 32 + [3] * 16 + [4] * 16)
        for i in range(longest):
            live = np.flatnonzero((size > i) & np.isfinite(best[:, i]))
            if not len(live):
                continue
            end = np.minimum(i + width[text[live, i]], size[live])  # byte pieces of one character
            score = best[live, i] + self.fallback * (end - i)
            better = score > best[live, end]
            best[live[better], end[better]], back[live[better], end[better]], piece[live[better], end[better]] = score[better], i, -2
            node, d = np.zeros(len(live), np.int64), i
            while len(live):
                ok = size[live] > d
                live, node = live[ok], node[ok]
                to = self.base[node] + text[live, d] + 1
                ok = self.check[to] == node
                live, node, d = live[ok], to[ok], d + 1
                hit = np.flatnonzero(self.ids[node] >= 0)
                if len(hit):
                    r, p = live[hit], self.ids[node[hit]]
                    score = best[r, i] + self.score[p]
                    better = score > best[r, d]
                    r, p = r[better], p[better]
                    best[r, d], back[r, d], piece[r, d] = score[better], i, p
        out = []
        for k, u in enumerate(units):
            ids, at = [], len(u)
            while at > 0:
                start = int(back[k, at])
                ids += [int(piece[k, at])] if piece[k, at] >= 0 else [int(self.byte_ids[c]) for c in reversed(u[start:at])]
                at = start
            out.append((np.array(ids[::-1], "<u4").tobytes(), float(best[k, len(u)])))
        return out

    def solve_long(self, unit: bytes) -> tuple[bytes, float]:
        """solve() of one long unit: the pieces that begin at BLOCK positions are looked up together, then the best path
        goes through them."""
        text = np.frombuffer(unit, np.uint8).astype(np.int64)
        size = len(text)
        width = np.array([1] * 128 + [1] * 64 + [2] * 32 + [3] * 16 + [4] * 16)
        best, back, piece = [0.0] + [-np.inf] * size, [0] * (size + 1), [-1] * (size + 1)
        for at in range(0, size, BLOCK):
            live = np.arange(at, min(size, at + BLOCK))
            after = np.minimum(live + width[text[live]], size).tolist()
            node, d, found = np.zeros(len(live), np.int64), 0, []
            while len(live):
                ok = live + d < size
                live, node = live[ok], node[ok]
                to = self.base[node] + text[live + d] + 1
                ok = self.check[to] == node
                live, node, d = live[ok], to[ok], d + 1
                hit = self.ids[node] >= 0
                found.append(np.stack([live[hit], live[hit] + d, self.ids[node[hit]]]))
            start, end, which = np.concatenate(found, 1)
            order = np.argsort(start, kind="stable")  # shorter pieces first
            first = np.searchsorted(start[order], np.arange(at, at + len(after) + 1)).tolist()
            end, gain, which = end[order].tolist(), self.score[which[order]].tolist(), which[order].tolist()
            for k, to in enumerate(after):
                i, here = at + k, best[at + k]
                if here == -np.inf:
                    continue
                score = here + self.fallback * (to - i)
                if score > best[to]:
                    best[to], back[to], piece[to] = score, i, -2
                for e in range(first[k], first[k + 1]):
                    score, to = here + gain[e], end[e]
                    if score > best[to]:
                        best[to], back[to], piece[to] = score, i, which[e]
        ids, at = [], size
        while at > 0:
            start = back[at]
            ids += [piece[at]] if piece[at] >= 0 else [int(self.byte_ids[c]) for c in reversed(unit[start:at])]
            at = start
        return np.array(ids[::-1], "<u4").tobytes(), float(best[size])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each text."""
        if len(self.known) > KNOWN:
            self.known.clear()
        cut = []
        for t in texts:
            parts = [UNIT.findall(MARK * (not k) + part.replace(" ", MARK)) for k, part in enumerate(t.split(MARK))] if t else [[]]
            cut.append(parts[0] + [u for part in parts[1:] for u in (None, *part)])  # None: a marker of the text itself
        new = sorted({u for units in cut for u in units if u is not None and u not in self.known}, key=len)
        for u in [u for u in new if len(u.encode()) > LONG]:
            self.known[u] = self.solve_long(u.encode())
        new = [u for u in new if u not in self.known]
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            for a in range(0, len(part), max(1, min(TOGETHER, (4 << 20) // (4 * len(part[-1]) + 1)))):
                some = part[a : a + max(1, min(TOGETHER, (4 << 20) // (4 * len(part[-1]) + 1)))]
                self.known |= dict(zip(some, self.solve([u.encode() for u in some]), strict=True))
        found = [[self.own if u is None else self.known[u] for u in units] for units in cut]
        return [(np.frombuffer(b"".join([f[0] for f in units]), "<u4"), sum(f[1] for f in units)) for units in found]

    def decode(self, ids: np.ndarray) -> str:
        """Markers of pieces to spaces, byte pieces to bytes; the first space goes."""
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace")


def model_at(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), score of each row."""
    path = path or default_model()

    def run(batches):
        model = model_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = model.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got])], ["doc_id", "ids", "score"])

    return plain(docs).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of ids."""
    path = path or default_model()

    def run(batches):
        model = model_at(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_byte_pieces, ids_crc32 (little-endian uint32), score, round_trip of each row."""
    path = path or default_model()

    def run(batches):
        model = model_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = model.encode(texts)
                columns = [[len(t) for t in texts], [len(x[0]) for x in got], [int(model.is_byte[x[0]].sum()) for x in got], [zlib.crc32(x[0].tobytes()) for x in got]]
                back = [model.decode(x[0]) == t for x, t in zip(got, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([x[1] for x in got], pa.float64()), pa.array(back)], ["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids_crc32", "score", "round_trip"])

    return plain(docs).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_crc32 long, score double, round_trip boolean")
