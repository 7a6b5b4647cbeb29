import math
import random

import numpy as np
import pytest

from foliospark.llm import mixing, ordering, sharding
from tests.llm.helpers import awkward, docs, empty, prose


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    y = ordering.permute(np.arange(n), n, 42)
    assert sorted(y.tolist()) == list(range(n))
    if n > 60:
        assert (y != np.arange(n)).mean() > 0.9 and (y != ordering.permute(np.arange(n), n, 43)).any()


def py_hash(x, seed):
    a, b, c = 2654435761, 1540483477, 1 << 32
    x = (((x or 0) % (1 << 31)) ^ seed) * a % c
    return (x ^ (x >> 15)) * b % c


def test_shards_can_be_computed(spark):
    d = docs(spark, [f"t{k}" for k in range(57)], ids=[k * 31 - 400 for k in range(57)])
    rows = sharding.shard(d.repartition(5), key=9, shard_rows=10).collect()
    ids = sorted((r.doc_id for r in rows), key=lambda i: (py_hash(i, 0), i))
    slots = ordering.permute(np.arange(57), 57, 9)
    assert {r.doc_id: r.slot for r in rows} == {i: int(s) for i, s in zip(ids, slots)}
    assert all((r.shard, r.place) == (r.slot // 10, r.slot % 10) for r in rows)
    for limit in (None, 0):
        small = ordering.row_numbers(d, "doc_id", "n", range_rows=7, limit=limit)[0].collect()
        assert {r.doc_id: r.n for r in small} == {i: k for k, i in enumerate(ids)}
    assert sharding.shard(d, shard_rows=10).rdd.getNumPartitions() == 6


def test_null_and_repeated_ids_in_many_ranges(spark):
    d = docs(spark, [f"t{k % 5}" for k in range(90)], ids=[None] * 40 + [7] * 40 + list(range(10)))
    one = ordering.row_numbers(d.repartition(3), "doc_id", "n", range_rows=8)[0].collect()
    two = ordering.row_numbers(d.repartition(5), "doc_id", "n", range_rows=11, limit=0)[0].collect()
    assert sorted(r.n for r in one) == list(range(90))
    assert sorted((r.n, r.doc_id or -1, r.text) for r in one) == sorted((r.n, r.doc_id or -1, r.text) for r in two)


def test_shard_awkward_rows(spark):
    df = awkward(spark, ("place",))
    out = sharding.shard(df)
    assert out.count() == df.count() and sorted(r.slot for r in out.select("slot").collect()) == list(range(df.count()))
    assert {"SLOT_in", "shard_in", "place_in"} <= set(out.columns)
    assert sharding.shard(empty(spark)).count() == 0


def brute_mix(rows, steps, start, end, seed, total=None):
    """rows: (doc_id, text, source)."""
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((py_hash(i, seed), i, max(1, len((t or "").split()))))
    supply = {s: sum(x[2] for x in v) for s, v in by.items()}
    w = [{s: supply[s] ** (start + (end - start) * (k + 0.5) / steps) for s in by} for k in range(steps)]
    share = {s: [x[s] / sum(x.values()) / steps for x in w] for s in by}
    total = max(supply[s] / sum(share[s]) for s in by) if total is None else total
    out = []
    for s, v in by.items():
        d = np.concatenate(([0], np.cumsum(np.array(share[s]) * total)))
        c, e = 0, 0
        while c < round(d[-1]):
            for _, i, n in sorted(v):
                if c >= round(d[-1]):
                    break
                k = min(int(np.searchsorted(d, c, "right")) - 1, steps - 1)
                out.append((i, e, (k + min(1.0, (c - d[k]) / (d[k + 1] - d[k]))) * total / steps))
                c += n
            e += 1
    return out


@pytest.mark.parametrize("total,limit", [(None, None), (900, 0)])
def test_mix_against_brute_force(spark, total, limit):
    r = random.Random(4)
    rows = [(k, prose(r, r.randint(1, 60)), r.choice("aaaab") if k else "c") for k in range(60)]
    got = [(x.doc_id, x.epoch, x.position) for x in mixing.mix(docs(spark, [x[1] for x in rows], sources=[x[2] for x in rows]), total_tokens=total, range_rows=9, part_tokens=300, limit=limit).collect()]
    want = brute_mix(rows, mixing.STEPS, mixing.START, mixing.END, mixing.SEED, total)
    assert [p for _, _, p in got] == sorted(p for _, _, p in got)
    a, b = sorted(got), sorted(want)
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])
    if total is None:
        assert {x[0] for x in got} == set(range(60))


def test_mix_reaches_the_targets_over_time(spark):
    r = random.Random(6)
    d = docs(spark, [prose(r, 20) for _ in range(900)], sources=["big" if k % 9 else "small" for k in range(900)])
    rows = mixing.mix(d, total_tokens=12_000).collect()
    third = [x for x in rows if x.position < 4000]
    share = sum(x.n_tokens for x in third if x.source == "small") / sum(x.n_tokens for x in third)
    supply = {"small": 2000, "big": 16000}
    want = np.mean([supply["small"] ** a / (supply["small"] ** a + supply["big"] ** a) for a in np.linspace(0.7, 0.8, 20)])
    assert math.isclose(share, want, abs_tol=0.02)


def test_mix_awkward_rows(spark):
    df = awkward(spark, ("n_tokens",))
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns and out.count() >= df.count()
    assert mixing.stage(spark, empty(spark), "").count() == 0
