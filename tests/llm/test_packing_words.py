"""Words of Latin-1 letters, which go to the tokenizer's model directly, and letters that compose with what follows."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from skyweave.llm import packing

PATH = packing.default_tokenizer()


def _same(texts, path=PATH):
    tok = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.encode(texts, path)] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_words_need_no_normalizer_and_signs_no_words_of_their_own(monkeypatch):
    known = packing.Known(PATH)
    known.tokenizer = None  # words do without
    monkeypatch.setattr(packing, "_known", {PATH: known})
    _same(["Élan naïve ÀÍÑÖØÞ straße ÿ íàß", "", "the THE"])
    data = "été, (Été). été!×2÷é".encode()
    units, count = packing._units(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert units.to_pylist() == ["été", ",", "(", "été", ").", "été", "!×2÷é"] and count.tolist() == [7]


def test_capitals_compose_before_they_are_lowered():
    _same(["T̈ H̱a W̊ Y̊ J̌", "Éa Å À̧Í Ǻx", "ABC", "́", "H", "̱h"])


def test_odd_characters_beside_words():
    rnd = random.Random(3)
    signs = [*"abthTW09'!<| \n\t\x0b\x1c\x00éÉßÿÞ×÷ªµ½\xa0\xad\x85íÍ̱́̈ĀİıſΣẞ日अ😀 ‍", "'s", "'LL", "<|endoftext|>"]
    _same(["".join(rnd.choices(rnd.sample(signs, 12), k=rnd.randint(0, 30))) for _ in range(1500)])


def test_a_file_without_ends_of_words_is_read_as_before(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"end_of_word_suffix": None, "merges": spec["model"]["merges"][:1]}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert packing.Known(str(path)).words is None
    _same(["Élan in the straße, (ÀÍ) don't 12", ""], str(path))


def test_pieces_of_a_range_follow_one_another():
    ids = [np.arange(k, dtype="<u2") for k in (1, 5000, 4096, 3, 9000, 2)]
    rows = {"key": [3, 1, 2, 2, 9, 2], "doc_id": [7, None, 5, 4, 8, None], "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}
    got = packing._laid()(pa.table(rows | {"base": [4000] * 6})).to_pylist()
    at, docs = 4000, []
    for r in got:
        assert (r["sequence_id"], r["offset"]) == divmod(at, packing.SEQUENCE) and r["offset"] + r["length"] <= packing.SEQUENCE
        whole = next(x for x in ids if len(x) == r["doc_tokens"])
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes())
        at += r["length"]
        docs += [r["doc_id"]] if not r["start"] else []
    assert docs == [None, 4, 5, None, 7, 8] and at == 4000 + sum(rows["n"])
