"""Queries use every file and every row of their tables."""

import time
import tracemalloc
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import foliospark.plans.extras  # noqa: F401
from foliospark.cells import CELL, SLICE_BYTES, cells, slices
from foliospark.operators import knowledge, models, synth, vectors
from foliospark.plans import relational
from foliospark.plans.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect


def test_streams_read_every_part_file(spark, sf, tmp_path):
    parts = tmp_path / "parts"
    for name, n in (("documents", 3), ("events", 20), ("nation", 1)):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(n).write.parquet(f"{parts}/{name}.parquet")
    for name, table in (("stream_columns", "documents"), ("stream_windows", "events")):
        assert len(spark.read.parquet(f"{parts}/{table}.parquet").inputFiles()) > 1
        compare(QUERIES[name](spark, str(parts)), connect(sf), ORACLE[name])


TURNS = [
    (7, 0, "user", "Ada builds engines. The engine is a machine"),
    (7, 1, "assistant", "Paris is 12 miles of road."),
    (7, 2, "user", None),
    (7, 10, "user", "Berlin is a town. Zuse builds computers"),
    (8, 1, "user", "Rome is old."),
    (8, 0, "system", "Answer the question"),
]


def whole_conversations():
    """Tokens by conversation, of all turns in order."""
    out = {}
    for conv, _, _, text in sorted(TURNS, key=lambda r: r[:2]):
        own = out.setdefault(conv, [])
        at, sents = len(own), own[-1]["sent"] + 1 if own else 0
        own += [x | {"i": x["i"] + at, "head": x["head"] + at, "sent": x["sent"] + sents} for x in knowledge.rule_tokens(text)]
    return out


def test_conversations_are_read_to_their_last_turn(spark, sf, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want = whole_conversations()
    chunks, names = set(), set()
    for conv, own in want.items():
        for (noun, sent), run in groupby(own, lambda x: (x["pos"] in ("NOUN", "NUM"), x["sent"])):
            run = list(run)
            if noun:
                chunks.add((conv, sent, run[0]["i"], " ".join(x["text"] for x in run)))
        names |= {(conv, label, sum(x["ent"] == label for x in own)) for label in ("NAME", "NUMBER") if any(x["ent"] == label for x in own)}
    assert {(r.conv_id, r.sent, r.start, r.chunk) for r in rows("noun_chunks")} == chunks
    assert {(r.conv_id, a, b) for r in rows("entities_by_label") for a, b in zip(r.labels, r.counts)} == names
    word = {(c, x["i"]): x["text"] for c, own in want.items() for x in own}
    related = {(r.conv_id, word[r.conv_id, r.n1], word[r.conv_id, r.n2], r.type, r.label) for r in rows("semantic_relations")}
    assert {(7, "Ada", "engines", "SVO", "builds"), (7, "engine", "machine", "Attribute", "is"), (7, "Paris", "miles", "Attribute", "is"), (7, "Zuse", "computers", "SVO", "builds"), (8, "Rome", "old", "Attribute", "is")} <= related
    labels = {r.label for r in rows("document_graph_vertices")}
    assert {"Zuse", "Rome", "7", "8"} <= labels
    edges = rows("document_graph_edges")
    assert {r.src.split(":")[0] for r in edges} == {"7", "8"} and all(r.src.split(":")[0] == r.dst.split(":")[0] for r in edges)
    assert {r.conv_id: len(r.keywords) for r in rows("keywords_textrank")} == {7: 5, 8: len({x[3] for x in chunks if x[0] == 8})}
    assert {(r.conv_id, r.turn) for r in rows("question_answers")} == {x[:2] for x in TURNS}


def test_segment_vectors_cover_long_documents(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join("x" * 300 for _ in range(400)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.pos for r in QUERIES["segment_vectors"](spark, str(tmp_path)).collect()) == list(range(400))


def test_vectors_are_compared_in_cells(spark, monkeypatch):
    """Nothing comes to the driver, and no task holds a whole group."""
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", None)
    r = np.random.default_rng(3)
    v = r.normal(size=(90, 4))
    v[40:60] = v[0]
    df = spark.createDataFrame([(k, k // 80, x.tolist()) for k, x in enumerate(v)], "id long, g int, vector array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 6)
    for group in (None, "g"):
        got = {}
        for x in vectors.knn(df, df, 3, group=group, drop_self=True, limit=400, block=2).collect():
            got.setdefault(x.query, []).append((x.rank, x.id))
        for q in range(90):
            own = [k for k in range(90) if k != q and (group is None or k // 80 == q // 80)]
            assert [k for _, k in sorted(got[q])] == sorted(own, key=lambda k: (d[q, k] + 0.0, k))[:3]
    left, right = cells(df, df, ["g"], "id", "id", 30)
    most = lambda x: x.groupBy("g", *CELL).count().agg({"count": "max"}).first()[0]
    assert max(most(left), most(right)) < 60 and left.select(*CELL).distinct().count() == 9


def test_neighbours_take_little_memory():
    r = np.random.default_rng(0)
    q, d = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(512, 8)), r.normal(size=(40_000, 8))))
    tracemalloc.start()
    got = vectors._nearest(np.arange(512), q, np.arange(40_000), d, 3, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(got[0]) == 3 * 512


def test_nearest_rows_without_all_pairs(spark):
    """Cut groups, ties, ties after rounding, nulls, other pages: as by all pairs."""
    r = np.random.default_rng(5)
    box = lambda n, k: [(i, "f" if r.random() < 0.9 else "g", None if r.random() < 0.05 else int(r.integers(0, 4)), *[float(x) for x in r.integers(0, 12, 4)]) for i in range(k, k + n)]
    a, b = box(70, 0), [*box(40, 100), (900, "f", 9, 1.0, 1.0, 1.0, 1.0)]
    a += [(80, "f", 30, 1.0, 1.0, 1.0, 1.0), (81, None, 1, 1.0, 1.0, 1.0, 1.0), (82, "none", 1, 1.0, 1.0, 1.0, 1.0)]
    left, right = (spark.createDataFrame(x, f"{i} long, file string, page int, x0 double, y0 double, x1 double, y1 double") for x, i in ((a, "l"), (b, "r")))

    def want(x, cost):
        each = [(d is None, d, y[0]) for y in b if y[1] == x[1] for d in [None if None in (*x, *y) else cost(x, y)]]
        return min(each, key=lambda e: (e[0], e[1] or 0, e[2]), default=None)

    cost = lambda x, y: abs(x[2] - y[2]) * 1e7 + sum(abs(p - q) for p, q in zip(x[3:], y[3:]))
    for block in (1 << 17, 11):
        got = {x.l: (x.distance, x.match) for x in relational.nearest(left, right, ["file"], "l", "r", [(c, c) for c in ("x0", "y0", "x1", "y1")], ("page", "page"), block=block).collect()}
        assert got == {x[0]: w[1:] for x in a if (w := want(x, cost))}
    close = spark.createDataFrame([(1, 1.0), (2, 1.0000001), (3, 5.0), (4, None)], "r long, v double").withColumn("k", F.lit(0))
    asked = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "l long, v double").withColumn("k", F.lit(0))
    got = {(x.l, x.match, x.distance) for x in relational.nearest(asked, close, ["k"], "l", "r", [("v", "v")], digits=6).collect()}
    assert got == {(1, 1, 1.0), (2, 1, 2.0), (3, 1, None)}


def test_nearest_of_large_groups(spark):
    """25,000 rows a side in one group: 625 million pairs, if all were made."""
    a = spark.range(25_000).select("id", F.lit("f").alias("file"), F.lit(1).alias("page"), *[(F.col("id") * 7 % 400).cast("double").alias(c) for c in ("x0", "x1")], *[(F.col("id") * 11 % 300).cast("double").alias(c) for c in ("y0", "y1")], F.lit("m").alias("md5"))
    labels = a.withColumnRenamed("id", "label_id").withColumn("classification", F.lit("table"))
    began = time.time()
    got = relational.match_labels(labels, a).agg(F.count("*"), F.max("match_md5"), F.max("distance"), F.max(F.col("match") - F.col("label_id") % 1200)).first()
    assert tuple(got) == (25_000, 0, 0.0, 0) and time.time() - began < 40


def test_results_of_texts_are_built_in_slices():
    """A batch of 4000 texts holds the objects of a part of them only."""
    column, live, most = pa.array(["word " * 200] * 4000), 0, 0
    for s in slices(column):
        most, live = max(most, len(s)), live + len(s)
    assert live == 4000 and most * 1000 <= SLICE_BYTES
    assert [len(s) for s in slices(pa.array(["x" * (SLICE_BYTES * 2), None, "a"]))] == [1, 2] and [len(s) for s in slices(pa.array([], pa.string()))] == [0]


def test_random_chunks_are_those_of_the_hash(spark):
    texts = ["", None, "a", "ä€" * 700, "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    size = 20 + F.pmod(F.xxhash64("text", F.col("i").cast("int"), F.lit(0)), F.lit(61))
    sizes = {(r.k, r.i): r.n for r in df.join(spark.range(5001).withColumnRenamed("id", "i")).filter(F.col("i") <= F.length("text") / 20).select("k", "i", size.alias("n")).collect()}
    began = time.time()
    got = {r.k: r.c for r in df.select("k", synth.random_chunks(F.col("text")).alias("c")).collect()}
    assert time.time() - began < 20
    for k, x in enumerate(texts):
        want, at = [], 0
        while x and at < len(x):
            want.append(x[at : at + sizes[k, len(want)]])
            at += sizes[k, len(want) - 1]
        assert got[k] == (None if x is None else want)


def test_annotations_leave_slice_by_slice(spark):
    """Results that are alive in the worker while a text is annotated: those of some slices, not of its whole batch."""

    class Kept(list):
        live = 0

        def __del__(self):
            Kept.live -= 1

    def annotator(text):
        Kept.live += 1
        return Kept([{"i": 0, "text": str(Kept.live), "pos": "NOUN", "dep": "dep", "head": 0, "sent": 0, "ent": None}])

    df = spark.createDataFrame([(k, "word " * 1000) for k in range(1000)], "id long, text string").coalesce(1)
    live = [int(r.tokens[0].text) for r in knowledge.annotate(df, annotator=annotator).collect()]
    assert len(live) == 1000 and max(live) <= 3 * SLICE_BYTES // 5000


def test_zero_shot_scores_are_those_of_trigram_sets():
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    text = "There the others gather. ABABAB"
    want = {x: round(len(grams(x.lower()) & grams(text.lower())) / max(1, len(grams(x.lower()))), 6) for x in ("the", "gathering", "BABA", "no", "")}
    assert models.overlap_scores(text, list(want)) == want


def test_turns_are_annotated_once(spark, sf):
    for name in ("semantic_relations", "document_graph_edges", "document_graph_vertices"):
        assert "EvalPython" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
