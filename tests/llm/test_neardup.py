import random
from collections import Counter

import numpy as np

from foliospark.llm import neardup
from tests.llm.helpers import DOCS, awkward, bare, docs, empty, prose


def jaccard(a, b, n=2):
    def bag(t):
        w = t.lower().replace(",", " ").replace(".", " ").split()
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter(w)

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signature_is_unbiased_for_weights():
    r = np.random.default_rng(0)
    e = np.sort(r.integers(0, 2**62, 200).astype(np.uint64))
    for spread in (1, 40):
        a, b = r.integers(1, 1 + spread * 3, 200), r.integers(1, 1 + spread * 3, 200)
        s = neardup.signatures(np.repeat([0, 1], 200), np.concatenate((e, e)), np.concatenate((a, b)), 2, 8192)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)


def test_signature_does_not_depend_on_the_limit():
    e = np.arange(1, 4, dtype=np.uint64)
    one = neardup.signatures(np.zeros(3, int), e, np.array([1, 5, 2]), 1, 64)
    two = neardup.signatures(np.repeat([0, 1], 3), np.concatenate((e, e)), np.array([1, 5, 2, 1, 5, 2]), 2, 64)
    assert (one[0] == two[1]).all() and np.isfinite(one).all()


def brute(texts, ids, threshold=0.5):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= threshold:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {(i, find(i)) for i in ids if find(i) != i}


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(25):
        t = prose(r, r.randint(30, 120))
        texts.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            w = t.split()
            for _ in range(r.randint(0, len(w) // 12)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["spam " * 60, "spam " * 70, "one", "one"]
    ids = list(range(100, 100 + len(texts)))
    got = {tuple(x) for x in neardup.near_copies(docs(spark, texts, ids)).collect()}
    want = brute(texts, ids)
    assert len(got & want) >= 0.9 * len(want) and got <= want
    kept = neardup.stage(spark, docs(spark, texts, ids), "")
    assert {x.doc_id for x in kept.collect()} == set(ids) - {a for a, _ in got}


def test_pairs_across_components_of_a_bucket_are_verified(spark):
    """A bucket whose least document is unlike the others still joins those."""
    r = random.Random(8)
    base = prose(r, 100)
    shared = " ".join(base.split()[:45])
    texts = [shared + " " + prose(r, 55)] + [base.replace(base.split()[k], "q", 1) for k in (60, 70, 80)]
    got = {tuple(x) for x in neardup.near_copies(docs(spark, texts), bands=64, rows=1).collect()}
    assert {(2, 1), (3, 1)} <= got and brute(texts, list(range(4))) == got


def test_awkward_rows(spark):
    df = awkward(spark)
    assert [tuple(x) for x in neardup.near_copies(bare(df)).collect()] == []
    out = neardup.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == df.count() - 1
    assert neardup.stage(spark, empty(spark), "").count() == 0 and neardup.stage(spark, empty(spark), "").columns == DOCS.names
