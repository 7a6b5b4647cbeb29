import random

import pytest

from foliospark.llm import decontaminate
from tests.llm.helpers import awkward, docs, empty, prose


def greedy(item, doc, k):
    """Greedy string tiling by looking at everything each time."""
    used_i, used_j, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_j:
                    n += 1
                if n >= k and (n, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (n, i, j)
        if not best[0]:
            return out
        n, i, j = best
        out.append((i, j, n))
        used_i |= set(range(i, i + n))
        used_j |= set(range(j, j + n))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_brute_force(seed):
    r = random.Random(seed)
    item = [r.choice("abcd") for _ in range(r.randint(4, 30))]
    doc = [r.choice("abcd") for _ in range(r.randint(4, 40))]
    cut = r.randint(0, len(item))
    doc[5:5] = item[cut:] + item[:cut]
    want = greedy(item, doc, 3)
    idx = decontaminate.index([7], [" ".join(item)], 3, 0.01)
    got = decontaminate.contaminated([" ".join(doc)], idx, 0.01)
    assert got == [(0, 0, pytest.approx(sum(t[2] for t in want) / len(item)), len(want))]


@pytest.mark.parametrize("seed", range(6))
def test_rare_seeds_lose_no_pair(seed):
    """Items that share phrases: the pairs are those of tiling everything."""
    r = random.Random(seed)
    phrases = [[r.choice("abcdefgh") for _ in range(6)] for _ in range(4)]
    part = lambda: [w for _ in range(r.randint(1, 3)) for w in r.choice(phrases)] + [r.choice("ijklm") for _ in range(r.randint(0, 6))]
    items, texts = [part() for _ in range(12)], [part() + part() for _ in range(12)]
    idx = decontaminate.index(list(range(12)), [" ".join(i) for i in items], 4)
    got = {(d, i): (c, n) for d, i, c, n in decontaminate.contaminated([" ".join(t) for t in texts], idx)}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            g = greedy(item, t, 4)
            if sum(x[2] for x in g) >= decontaminate.COVERAGE * len(item):
                want[d, i] = (pytest.approx(sum(x[2] for x in g) / len(item)), len(g))
    assert got == want and got


def test_repetitive_document_and_a_thousand_items():
    import time

    unit = "a b c d e f g".split()
    texts = [" ".join((unit[k % 7 :] + unit[: k % 7]) * 57) + f" x{k}" for k in range(1000)]
    idx = decontaminate.index(list(range(1000)), texts)
    began = time.time()
    got = decontaminate.contaminated([" ".join(unit * 2858)], idx)
    assert len(got) == 1000 and time.time() - began < 20


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_reordered_passages_and_clean_documents(spark):
    r = random.Random(2)
    items = [prose(r, 30) for _ in range(5)]
    w = items[1].split()
    texts = [prose(r, 60) + " " + items[0] + " " + prose(r, 50), " ".join(w[18:] + ["z", "y"] + w[9:18] + ["x"] + w[:9]), prose(r, 100), " ".join(items[2].split()[:10]) + prose(r, 40)]
    d = docs(spark, texts)
    got = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.pairs(d, bench(spark, items)).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0}
    assert {x.doc_id for x in decontaminate.clean(d, bench(spark, items)).collect()} == {2, 3}
    sliced = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.pairs(d, bench(spark, items), limit=500).collect()}
    assert sliced == got


def test_awkward_rows(spark):
    df = awkward(spark)
    b = bench(spark, [None, "", "x", prose(random.Random(9), 20), "x" * 300_000]).selectExpr("*", "1 as TEXT", "2 as Item_Id")
    long = docs(spark, ["y" * 1_000_000, "x" * 300_000])
    assert decontaminate.pairs(long, b).count() == 0
    out = decontaminate.clean(df, b)
    assert out.columns == df.columns and out.count() == df.count()
    assert decontaminate.pairs(empty(spark), b).count() == 0
    assert decontaminate.clean(empty(spark), b.limit(0)).count() == 0
