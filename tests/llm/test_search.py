import math
import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import search
from tests.llm.helpers import awkward, docs, empty, prose


def brute(texts, ids, queries, k=10):
    toks = [(t or "").lower().replace(",", " ").replace(".", " ").split() for t in texts]
    n, mean = len(toks), max(1, sum(map(len, toks))) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    out = {}
    for item, q in queries:
        scores = []
        for i, t in zip(ids, toks):
            c, s, hit = Counter(t), 0.0, False
            for w, m in Counter((q or "").lower().replace(",", " ").replace(".", " ").split()).items():
                if c[w]:
                    hit = True
                    s += m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if hit:
                scores.append((-round(s, 6), i))
        out[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("limit", [1 << 26, 3000])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(search, "RANGE", 16)
    monkeypatch.setattr(search, "BLOCK", 4000)
    r = random.Random(1)
    texts = [prose(r, r.choice([3, 20, 80])) for _ in range(150)] + [None, ""]
    texts += texts[:20]
    ids = list(range(len(texts)))
    queries = [(k, prose(r, r.choice([1, 5, 30]))) for k in range(25)] + [(90, None), (91, ""), (92, "unknownword")]
    q = spark.createDataFrame(queries, "item_id long, text string")
    rows = sorted(search.search(docs(spark, texts, ids), q, limit=limit).collect(), key=lambda x: (x.item_id, x.rank))
    got = {}
    for x in rows:
        got.setdefault(x.item_id, []).append((x.doc_id, x.score))
    want = {k: v for k, v in brute(texts, ids, queries).items() if v}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(np.allclose([s for _, s in got[k]], [s for _, s in want[k]], atol=2e-6) for k in want)


def test_awkward_rows(spark):
    q = spark.createDataFrame([(1, "x"), (1, "x"), (None, "unicode ünïcode")], "item_id long, text string").selectExpr("*", "1 as ITEM_ID", "2 as rank")
    rows = search.search(awkward(spark), q).collect()
    assert sorted((x.item_id or 0, x.rank, x.doc_id) for x in rows) == [(0, 1, 4), (1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3)]
    assert search.search(empty(spark), q).count() == 0 and search.search(awkward(spark), q.limit(0)).count() == 0
