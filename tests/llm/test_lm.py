import math
import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import lm, words
from tests.llm.helpers import awkward, docs, empty, prose


def brute(texts, order, held, rounds=lm.ROUNDS, levels=lm.LEVELS):
    toks = [(t or "").lower().replace(",", " ").replace(".", " ").split() for t in texts]

    def counts(docs):
        c, ctx = Counter(), Counter()
        for w in docs:
            for n in range(1, order + 1):
                for i in range(len(w) - n + 1):
                    c[tuple(w[i : i + n])] += 1
                    if i + n < len(w):
                        ctx[tuple(w[i : i + n])] += 1
        return c, ctx

    whole, whole_ctx = counts(toks)
    total, vocabulary = sum(map(len, toks)), len({w for t in toks for w in t})

    def rows(w):
        mine, mine_ctx = counts([w])
        for i in range(len(w)):
            p = [(whole[(w[i],)] - mine[(w[i],)]) / max(1, total - len(w))]
            b = 0
            for n in range(2, order + 1):
                c = 0
                g = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else None
                if g:
                    c = whole_ctx[g[:-1]] - mine_ctx[g[:-1]]
                p.append((whole[g] - mine[g]) / max(1, c) if g else 0.0)
                b = b * levels + min(math.ceil(math.log2(c + 1)), levels - 1)
            yield b, p

    weights = {}
    sample = []
    for t, w in zip(texts, toks):
        h, _, _, first, _ = words.scan([t])
        if lm.held_out(first, h, held)[0]:
            sample += list(rows(w))
    for _ in range(rounds):
        sums, n = {}, Counter()
        for b, p in sample:
            m = weights.get(b, np.full(order + 1, 1 / (order + 1))) * np.array([1 / (vocabulary + 1), *p])
            sums[b] = sums.get(b, 0) + m / m.sum()
            n[b] += 1
        new = {b: np.maximum(s, 1e-6 * n[b]) for b, s in sums.items()}
        new = {b: s / s.sum() for b, s in new.items()}
        moved = max((np.abs(new[b] - weights.get(b, 1 / (order + 1))).max() for b in new), default=0)
        weights = new
        if moved < 1e-4:
            break
    out = []
    for w in toks:
        s = 0.0
        for b, p in rows(w):
            s += math.log2((weights.get(b, np.full(order + 1, 1 / (order + 1))) * np.array([1 / (vocabulary + 1), *p])).sum())
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order,block", [(2, 1 << 22), (2, 700), (3, 700)])
def test_against_brute_force(spark, order, block):
    r = random.Random(2)
    texts = [prose(r, r.randint(1, 50)) for _ in range(60)] + ["", "one", "one one one"]
    want = brute(texts, order, 300)
    got = {x.doc_id: x for x in lm.score(docs(spark, texts), order, 300, block=block).collect()}
    assert [got[k].words for k in range(len(texts))] == [n for n, _ in want]
    assert np.allclose([got[k].log2_prob for k in range(len(texts))], [s for _, s in want])
    assert got[60].bits_per_word is None


def test_other_chunks_are_an_error(spark):
    h, _, _, first, _ = words.scan(["a b c"])
    import pandas as pd

    from foliospark.llm.suffixes import pack_sorted, planes

    rows = pd.DataFrame({"part": [-1], "chunk": [0], "n": [0], "a": [lm._zip(pack_sorted(np.unique(h)))], "b": [lm._zip(planes(np.arange(3), 4))], "c": [lm._zip(planes(first, 4))], "ids": [[1]]})
    with pytest.raises(ValueError):
        lm._restore(rows, 2)
    held = pd.DataFrame({"part": [-1], "chunk": [0], "n": [0], "a": [planes(np.arange(5), 4)], "b": [planes(np.array([3, 2]), 8)], "c": [planes(first, 4)]})
    with pytest.raises(ValueError):
        lm._restore_held(held, 2)


def test_other_splits_after_the_plan_was_made(spark, sf):
    want = sorted(map(tuple, lm.score(spark.read.parquet(f"{sf}/documents.parquet"), block=100_000).collect()))
    out, old = lm.score(spark.read.parquet(f"{sf}/documents.parquet"), block=100_000), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = lm.score(df).collect()
    assert len(rows) == df.count() and sum(x.words == 0 for x in rows) == 2
    assert lm.score(empty(spark)).count() == 0
