import random
import re

import numpy as np

from foliospark.llm import words
from tests.llm.helpers import prose

PATTERN = re.compile("[0-9a-zÀ-ÖØ-öø-῿⁰-⿿぀-\U0010ffff]+")


def test_scan_agrees_with_the_pattern():
    r = random.Random(1)
    texts = [prose(r, 50), None, "", "Ünïcode ß — “quotes” ½ 日本語テスト 3×4", "a" * 1000 + " b", "x y z", "İstanbul"]
    h, starts, ends, first, joined = words.scan(texts)
    found = [joined[a:b].decode() for a, b in zip(starts, ends)]
    wanted = [PATTERN.findall((t or "").lower()) for t in texts]
    assert found == [w for ws in wanted for w in ws]
    assert np.diff(first).tolist() == [len(ws) for ws in wanted]
    by = {}
    for w, x in zip(found, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_ngrams_stay_within_texts():
    h, _, _, first, _ = words.scan(["a b c", "d", "", "a b"])
    g, pos = words.ngrams(h, first, 2)
    assert pos.tolist() == [0, 1, 4]
    assert g[0] == g[2] != g[1]
