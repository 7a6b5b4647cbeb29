import itertools
import random

import numpy as np
import pytest

from foliospark.llm import toxicity
from foliospark.runtime import save_table  # noqa: F401
from tests.llm.helpers import awkward, bare, docs, empty, prose

INSULTS = "blockhead nitwit scoundrel numbskull".split()


def kernel(s, t, n, decay, span):
    """Gap-weighted subsequence kernel by listing subsequences."""

    def phi(x):
        out = {}
        for c in itertools.combinations(range(len(x)), n):
            if c[-1] - c[0] < span:
                k = "".join(x[i] for i in c)
                out[k] = out.get(k, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = phi(s), phi(t)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0


@pytest.mark.parametrize("pair", [("idiot", "idiot"), ("idiot", "idxiot"), ("banana", "bandana"), ("aaaa", "aaaaaa"), ("abc", "abcd")])
def test_kernel_against_brute_force(pair):
    s, t = pair

    def phi(x):
        out = np.zeros(32**toxicity.LENGTH)
        for _, code, weight in toxicity.features([toxicity._letters(x.encode())]):
            np.add.at(out, code[0], weight[0])
        codes, values = toxicity.summed(toxicity._letters(x.encode()))
        assert np.allclose(out[codes], values) and np.count_nonzero(out) == len(codes)
        return out

    assert phi(s) @ phi(t) == pytest.approx(kernel(s, t, toxicity.LENGTH, toxicity.DECAY, toxicity.SPAN))


def test_long_units_in_blocks(monkeypatch):
    r = random.Random(9)
    for size in (65, 200, 1000):
        x = np.array([r.randrange(26) for _ in range(size)])
        codes, values = toxicity.summed(x)
        monkeypatch.setattr(toxicity, "POSITIONS", 37)
        again, sums = toxicity.summed(x)
        monkeypatch.undo()
        assert codes.tolist() == again.tolist() and np.allclose(values, sums)
        if size == 65:
            phi = {}
            for c in itertools.combinations(range(size), toxicity.LENGTH):
                if c[-1] - c[0] < toxicity.SPAN:
                    k = int("".join(f"{x[i]:05b}" for i in c), 2)
                    phi[k] = phi.get(k, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
            norm = np.sqrt(sum(v * v for v in phi.values()))
            assert codes.tolist() == sorted(phi) and np.allclose(values, [phi[k] / norm for k in sorted(phi)])


def test_unbroken_text_of_a_million_letters():
    import resource
    import time

    r = random.Random(2)
    model = toxicity.train(*corpus(60, 8))
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    s = toxicity.score_texts([text, "a " + text[:70_000] + " b"], model)
    assert np.isfinite(s).all() and time.time() - began < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB


def test_nystroem_map_and_machine_against_brute_force():
    """The map's inner products are K(x, L) K(L, L)^-1 K(L, y), and the machine's weights have no gradient."""
    r = random.Random(6)
    units = [prose(r, 1).strip(".,") * 2 for _ in range(30)]
    marks = [u for u in dict.fromkeys(units) if len(u) >= 4][:6]
    k = lambda a, b: np.array([[kernel(x, y, toxicity.LENGTH, toxicity.DECAY, toxicity.SPAN) for y in b] for x in a])
    value, vector = np.linalg.eigh(k(marks, marks))
    keep = value > 1e-8
    mapped = k(units, marks) @ (vector[:, keep] / np.sqrt(value[keep]))
    assert np.allclose(mapped @ mapped.T, k(units, marks) @ np.linalg.pinv(k(marks, marks), rcond=1e-8) @ k(marks, units), atol=1e-6)
    y = np.where(np.arange(30) % 3 == 0, 1.0, -1.0)
    w = toxicity._svm(mapped, y)
    x = np.hstack((mapped, np.ones((30, 1))))
    c = np.where(y > 0, 15 / (y > 0).sum(), 15 / (y < 0).sum())

    def loss(w):
        return (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (w[:-1] ** 2).sum() + 1e-6 * w[-1] ** 2

    for d in np.eye(len(w)):
        assert abs(loss(w + 1e-5 * d) - loss(w - 1e-5 * d)) / 2e-5 < 1e-3


def test_units_and_sentences():
    u = toxicity.units(["Hi there! You id*iot. u i d i o t\nIdiot idiot idiot", None, "end"])
    words = [x.decode() for x in toxicity.spellings(u, np.arange(len(u["h"])))]
    assert words == ["hi", "there", "you", "idiot", "uidiot", "idiot", "end"]
    assert u["sent"].tolist() == [0, 0, 1, 1, 2, 3, 4] and u["sent_doc"].tolist() == [0, 0, 0, 0, 2]


def corpus(n, seed):
    r = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        t = prose(r, r.randint(40, 120)).split()
        bad = k % 4 == 0
        for _ in range(r.randint(3, 6) if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(INSULTS))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_held_out_accuracy_and_obfuscation():
    model = toxicity.train(*corpus(240, 1))
    texts, toxic = corpus(120, 2)
    guess = toxicity.score_texts(texts, model) >= model["threshold"]
    assert (guess == toxic.astype(bool)).mean() >= 0.95
    assert guess[toxic == 0].mean() <= 0.02
    clean = prose(random.Random(3), 60)
    hidden = clean + " nit-wit and b l o c k h e a d, scound*rel! numbsskull."
    s = toxicity.score_texts([clean, hidden], model)
    assert s[0] < model["threshold"] <= s[1]


def test_stage_and_awkward_rows(spark, tmp_path):
    texts, toxic = corpus(80, 4)
    spark.createDataFrame([(k, 1, int(x)) for k, x in enumerate(toxic)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    kept = toxicity.stage(spark, d, str(tmp_path))
    gone = {r.doc_id for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert {r.doc_id for r in kept.collect()} == set(range(80)) - gone
    assert len(gone ^ set(np.flatnonzero(toxic).tolist())) <= 2
    df = awkward(spark)
    assert toxicity.stage(spark, df, str(tmp_path)).columns == df.columns
    assert toxicity.stage(spark, df, str(tmp_path)).count() == df.count()
    assert toxicity.stage(spark, empty(spark), str(tmp_path)).count() == 0
    model = toxicity.train(texts, toxic)
    there = toxicity.trained(d, spark.read.parquet(f"{tmp_path}/labels.parquet").selectExpr("*", "1 as Toxic", "2 as DOC_ID"))
    assert there["threshold"] == pytest.approx(model["threshold"], abs=1e-3) and np.allclose(there["table"], model["table"], atol=1e-4)
    assert toxicity.trained(empty(spark), spark.read.parquet(f"{tmp_path}/labels.parquet"))["threshold"] == np.inf
    s = toxicity.score_texts([r.text for r in bare(df).collect()], model)
    assert s[0] == s[1] == 0
    assert toxicity.train(texts, np.zeros(80))["threshold"] == np.inf
