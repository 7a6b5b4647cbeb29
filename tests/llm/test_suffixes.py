import random

import numpy as np
import pytest

from foliospark.llm import suffixes
from tests.llm.helpers import awkward, docs, empty, prose


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    t = np.array([r.randrange(3) + 1 for _ in range(r.randint(1, 120))] * r.randint(1, 3) + [0])
    sa = suffixes.suffix_array(t)
    x = t.tolist()
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])

    def common(a, b):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        return n

    assert suffixes.common_prefixes(t, sa).tolist() == [0] + [common(a, b) for a, b in zip(sa, sa[1:])]


def brute(texts, size):
    toks = [(t or "").lower().replace(",", " ").replace(".", " ").split() for t in texts]
    at = {}
    for d, w in enumerate(toks):
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i : i + size]), set()).add(d)
    out = set()
    for d, w in enumerate(toks):
        mark = [False] * (len(w) + 1)
        for i in range(len(w) - size + 1):
            if len(at[tuple(w[i : i + size])]) > 1:
                mark[i : i + size] = [True] * size
        i = 0
        while i < len(w):
            j = i
            while mark[j]:
                j += 1
            if j > i:
                out.add((d, i, j - i))
            i = j + 1
    return out


@pytest.mark.parametrize("block", [1 << 22, 900])
def test_against_brute_force(spark, block):
    """In one shard, and across many."""
    r = random.Random(7)
    passages = [prose(r, n) for n in (8, 12, 30)]
    texts = []
    for k in range(60):
        t = prose(r, r.randint(5, 60))
        if k % 3 == 0:
            t = t + " " + r.choice(passages) + " " + prose(r, r.randint(0, 9))
        texts.append(t)
    texts += ["same " * 40, "again again " * 30, texts[5], texts[5]]
    got = {tuple(x) for x in suffixes.spans(docs(spark, texts).repartition(3), 8, block).collect()}
    assert got == brute(texts, 8) and len(got) > 20


def test_awkward_rows(spark):
    df = awkward(spark)
    assert suffixes.spans(df).count() == 0
    two = df.unionAll(df)
    got = {tuple(x) for x in suffixes.spans(two).collect()}
    assert got == {(2, 0, 6000), (None, 0, 80), (5, 0, 60)}
    assert suffixes.spans(empty(spark)).count() == 0
