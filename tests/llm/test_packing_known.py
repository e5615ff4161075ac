"""Units that are kept encoded between buffers of texts."""

import numpy as np
from tokenizers import Tokenizer

from skyweave.llm import packing


def test_common_units_stay_known_when_rare_ones_go(monkeypatch):
    path = packing.default_tokenizer()
    tok, asked = Tokenizer.from_file(path), []
    encoded = packing.Known._encoded
    monkeypatch.setattr(packing, "KNOWN", 300)
    monkeypatch.setattr(packing, "_known", {})
    monkeypatch.setattr(packing.Known, "_encoded", lambda self, new: asked.append(new) or encoded(self, new))
    common = [f"gr{a}{b}en" for a in "aeiouy" for b in "bcdfghklmnprst"]
    for k in range(12):
        texts = [" ".join(common), " ".join(f"{a}{b}{'xyzw'[k % 4] * (k + 1)}" for a in "qjvkz" for b in "abcdefghijklmno"), ""]
        got = packing.encode(texts, path)
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    known = packing._known[path]
    assert len(known.units) <= 300 + 75 and len(known.ids) == known.size.sum()
    assert sum(w in set(common) for new in asked for w in new) == len(common)


def test_no_units():
    ids, ends = packing.encoded(np.frombuffer(b"  ", np.uint8), np.array([0, 1, 2]), packing.default_tokenizer())
    assert ids.tolist() == [2, 2] and ends.tolist() == [0, 1, 2]
