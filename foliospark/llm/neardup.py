"""MinHash near-dedup: BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its word ``NGRAM``-grams (of its single word, if it has one only). Two
documents are near copies if their weighted Jaccard similarity, sum of min counts over sum of max
counts, is at least ``THRESHOLD``. Groups are the connected components; the least doc_id stays.

Signatures are BagMinHash (Ertl 2018). The weights are counts, so the discretisation is that of
the integers and the estimate is unbiased. Each element has one Poisson process for each
dyadic range of weight levels ([0,1), [1,2), [2,4), [4,8), ...) that its count reaches into, with
the rate of the range's width; points come in ascending order, each with a signature component and
a level of the range. The bits of the level are the choices of a hierarchical split of the process
down to single levels, drawn at once (thinning) in place of one split after another; a point counts if its level is below the element's count. Only points below
a limit that the document's total weight suggests are drawn; where a component stays empty, the
document is drawn again with the limit doubled, so the limit never changes the result.

Equal bags are joined by a 128-bit hash first. The other documents meet in bands of equal
signature parts: in each bucket every document is compared with the least one, and the components
of the links found are taken. Of the other pairs of a bucket only those count that lie in different components, and
1 - similarity being a metric, those only whose distances to the least document differ by no more than a link may
measure; they are verified then. So no candidate pair is dropped: each is verified, ruled out or already joined.
Least documents are found by aggregation and joined back, so a large bucket or group of copies is split by
the adaptive skew join and never sorted in one task.

Defined results: documents without words (null, empty) are near copies of nothing; rows without a
doc_id too; rows of one doc_id are taken as one document, the least of their texts, and a stage
keeps one row of them; other columns don't matter and may have any names; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import save_table, settle, small
from . import words

NGRAM, THRESHOLD, BANDS, ROWS, BLOCK = 2, 0.5, 72, 5, 2 << 20
U = np.uint64


def bags(texts: list, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, element hash and count of all bags, sorted by text and element."""
    h, _, _, first, _ = words.scan(texts)
    g, pos = words.ngrams(h, first, ngram)
    doc = words.doc_of(first)[pos]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < ngram))
    if len(few):
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in few])
        g, doc = np.concatenate((g, h[at])), np.concatenate((doc, np.repeat(few, np.diff(first)[few])))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))) if len(g) else np.zeros(0, np.int64)
    return doc[new], g[new], np.diff(np.append(new, len(g)))


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n_docs x m) of bags; rows of absent documents are infinite."""
    sig = np.full((n_docs, m), np.inf)
    if not len(doc):
        return sig
    weight = np.bincount(doc, count, minlength=n_docs)
    limit = np.where(weight > 0, (np.log(m) + 3) / np.maximum(weight, 1), 0)
    ranges = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    e = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(e)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    todo = weight > 0
    while todo.any():
        use = todo[doc[e]]
        idx, lev = e[use], level[use]
        low = np.where(lev > 0, 1 << np.maximum(lev - 1, 0), 0)
        width = np.where(lev > 0, low, 1)
        state = words.mix(element[idx] + (lev + 1).astype(U) * words._GOLD)
        d, c, x = doc[idx], count[idx], np.zeros(len(idx))
        sig[todo] = np.inf
        while len(idx):
            state = words.mix(state + words._GOLD)
            x = x - np.log1p(-((state >> U(11)).astype(np.float64) * 2.0**-53)) / (m * width)
            go = x < limit[d]
            idx, d, c, x, low, width, state = idx[go], d[go], c[go], x[go], low[go], width[go], state[go]
            draw = words.mix(state ^ U(0xD6E8FEB86659FD93))
            hit = low + ((draw >> U(32)).astype(np.int64) & (width - 1)) < c
            component = (draw & U(0xFFFFFFFF)).astype(np.int64) % m
            np.minimum.at(sig.reshape(-1), (d * m + component)[hit], x[hit])
        todo &= np.isinf(sig).any(1)
        limit[todo] *= 2
    return sig


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags (sorted elements, counts)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) and len(b[0]) else 0.0


def _band_table(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the bag, hashes of the bands; one row for each document with words."""
    m = bands * rows

    def run(batches):
        for ids, texts in words.blocks(batches, BLOCK):
            doc, element, count = bags(texts, ngram)
            sig = signatures(doc, element, count, len(texts), m)
            there = np.flatnonzero(np.bincount(doc, minlength=len(texts)))
            part = sig[there].view(U).reshape(len(there), bands, rows)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(there), bands)) * words._GOLD
            for r in range(rows):
                h = words.mix(h ^ part[:, :, r])
            one = words.mix(element ^ words.mix(count.astype(U)))
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            full = [np.add.reduceat(words.mix(one + U(k)), start) if len(start) else one for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in there], pa.int64()), *(pa.array(f.view(np.int64)) for f in full), pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))],
                names=["doc_id", "f0", "f1", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, f0 long, f1 long, bands array<long>")


def _bag_table(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id and its bag: elements and counts as bytes."""

    def run(batches):
        for ids, texts in words.blocks(batches, BLOCK):
            doc, element, count = bags(texts, ngram)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            c = count.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([element[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                names=["doc_id", "e", "c"],
            )

    return docs.mapInArrow(run, "doc_id long, e binary, c binary")


def _compared(pairs: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with the overlap of their bags, where the sizes allow for ``least``, else with an upper bound of
    it. Pairs are sent to their bags, not broadcast."""
    left = bag.select(F.col("doc_id").alias("a"), F.col("e").alias("ea"), F.col("c").alias("ca"))
    right = bag.select(F.col("doc_id").alias("b"), F.col("e").alias("eb"), F.col("c").alias("cb"))

    def run(batches):
        for t in (x for whole in batches for x in words.slices(whole)):
            got = []
            for ea, ca, eb, cb in zip(*(t.column(k).to_pylist() for k in range(2, 6))):
                a = np.frombuffer(ea, U), np.frombuffer(ca, np.uint32).astype(np.int64)
                b = np.frombuffer(eb, U), np.frombuffer(cb, np.uint32).astype(np.int64)
                wa, wb = a[1].sum(), b[1].sum()
                most = min(wa, wb) / max(wa, wb)
                got.append(overlap(a, b) if most >= least else most)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(got, pa.float64())], names=["a", "b", "sim"])
        words.give_back()

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "ca", "eb", "cb")
    return joined.mapInArrow(run, "a long, b long, sim double")


def _one_text(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id and text, one row for each doc_id that isn't null; rows are grouped only if ids repeat."""
    own = docs.select("doc_id", "text").filter("doc_id is not null")
    repeated = own.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return own
    ids = small(repeated, 8, limit)
    return own.join(ids, "doc_id", "left_anti").unionByName(own.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, bands: int = BANDS, rows: int = ROWS, limit: int | None = None) -> DataFrame:
    """(doc_id, kept_id) for each document that has to go: its group's least doc_id stays."""
    docs = _one_text(settle(docs, ["doc_id", "text"]), limit)
    table = save_table(_band_table(docs, ngram, bands, rows), "bands")
    whole = table.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"))
    equal = table.select("f0", "f1", "doc_id").join(whole, ["f0", "f1"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    equal = save_table(equal, "equal")
    gone = small(equal.select(F.col("b").alias("doc_id")), 8, limit)
    spread = table.join(gone, "doc_id", "left_anti").select("doc_id", F.posexplode("bands").alias("band", "h"))
    sizes = spread.groupBy("band", "h").agg(F.min("doc_id").alias("center"), F.count("*").alias("size")).filter("size > 1").drop("size")
    met = save_table(spread.join(sizes, ["band", "h"]), "buckets")
    bag = save_table(_bag_table(docs.join(small(met.select("doc_id").distinct(), 8, limit), "doc_id", "left_semi"), ngram), "bags")
    pairs = met.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = save_table(_compared(pairs, bag, 0.0), "pairs")
    linked = star.filter(F.col("sim") >= threshold).select("a", "b")
    part = connected_components(linked)
    named = met.join(part.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = save_table(named.join(star.select(F.col("a").alias("center"), F.col("b").alias("doc_id"), "sim"), ["center", "doc_id"], "left").withColumn("far", 1 - F.coalesce("sim", F.lit(1.0))), "named")
    several = named.groupBy("band", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "h")
    mixed = save_table(named.filter("doc_id <> center").join(several, ["band", "h"]).select("band", "h", "doc_id", "component", "far"), "mixed")
    one, two = (mixed.select("band", "h", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "far")]) for k in "ab")
    rest = one.join(two, ["band", "h"]).filter("doc_id_a < doc_id_b and component_a <> component_b").filter(F.abs(F.col("far_a") - F.col("far_b")) <= 1 - threshold + 1e-9)
    rest = rest.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = _compared(rest, bag, threshold).filter(F.col("sim") >= threshold).select("a", "b")
    edges = equal.unionByName(linked).unionByName(more)
    return connected_components(edges).filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies and the document that stays for them."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one document of each group."""
    settled = settle(docs, ["doc_id", "text"])
    gone = save_table(near_copies(docs).select("doc_id"), "gone")
    kept = settled.join(small(gone, 8), "doc_id", "left_anti")
    repeated = settled.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        ids = small(repeated, 8)
        first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in settled.columns]))
        one = kept.join(ids, "doc_id", "left_semi").withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
        kept = kept.join(ids, "doc_id", "left_anti").unionByName(one)
    return kept.select(*settled.columns).toDF(*docs.columns)
