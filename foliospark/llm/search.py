"""Exact top-k search: BM25 by MaxScore over sharded postings.

Documents are cut into shards; a shard's postings (document, frequency) of the words of any query are
written once. Document frequencies, count and mean length are those of all documents. In each
shard and for each query, words are ordered by their bound (the highest score any posting of the shard
gives). With the k-th best score so far as threshold, the words whose bounds together stay
below it are non-essential: only postings of the others are traversed, and the non-essential
words are probed, highest bound first, for documents that can still get in. Documents go by in
ranges, so the threshold rises within the shard. The shards' k best are merged. Nothing is
approximate: the k best are those of scoring everything.

Queries are taken in slices of a checked size; each slice scans the documents once.

Scores are compared to 6 digits; ties go to the smaller doc_id (null last), and k documents are
returned in any case. A query word counts as often as it occurs. Defined results: null and
empty queries have no hits; null and empty texts are never hits but count as documents; only
documents with a query word are hits; repeated documents and queries are rows of their own; other
columns don't matter; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, save_table, settle
from . import words
from .suffixes import planes, unplanes

K, K1, B, BLOCK, RANGE = 10, 1.2, 0.75, 16 << 20, 1024
U = np.uint64


def query_terms(texts: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sorted vocabulary of the queries, and each query's words (places in it) with counts."""
    h, _, _, first, _ = words.scan(texts)
    vocabulary, place = np.unique(h, return_inverse=True)
    return vocabulary, [np.unique(place[i:j], return_counts=True) for i, j in zip(first, first[1:])]


def postings(texts: list, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts; where each word's postings begin; documents and frequencies."""
    h, _, _, first, _ = words.scan(texts)
    at = np.searchsorted(vocabulary, h)
    there = at < len(vocabulary)
    there[there] = vocabulary[at[there]] == h[there]
    key, tf = np.unique(at[there].astype(np.int64) * len(texts) + words.doc_of(first)[there], return_counts=True)
    begin = np.searchsorted(key, np.arange(len(vocabulary) + 1) * len(texts))
    return np.diff(first), begin, key % max(1, len(texts)), tf


def best(terms: tuple[np.ndarray, np.ndarray], begin: np.ndarray, doc: np.ndarray, gain: np.ndarray, bound: np.ndarray, docs: int, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for one query and their scores, by MaxScore. ``tie``: the
    place of each document among equals."""
    at = [(q, doc[begin[t] : begin[t + 1]], gain[begin[t] : begin[t + 1]] * q, bound[t] * q) for t, q in zip(*terms) if begin[t + 1] > begin[t]]
    at.sort(key=lambda x: x[3])
    below = np.cumsum([x[3] for x in at])
    found, score, threshold = np.zeros(0, np.int64), np.zeros(0), -np.inf
    for lo in range(0, docs, RANGE):
        hi = min(docs, lo + RANGE)
        essential = int(np.searchsorted(below, threshold - 1e-5))
        if essential == len(at):
            break
        total, touched = np.zeros(hi - lo), np.zeros(hi - lo, bool)
        for _, d, g, _ in at[essential:]:
            i, j = np.searchsorted(d, (lo, hi))
            total[d[i:j] - lo] += g[i:j]
            touched[d[i:j] - lo] = True
        alive = np.flatnonzero(touched)
        for t in range(essential - 1, -1, -1):
            alive = alive[total[alive] + below[t] >= threshold - 1e-5]
            if not len(alive):
                break
            d, g = at[t][1], at[t][2]
            p = np.minimum(np.searchsorted(d, alive + lo), len(d) - 1)
            hit = d[p] == alive + lo
            total[alive[hit]] += g[p[hit]]
        alive = alive[total[alive] >= threshold - 1e-5]
        if len(alive):
            found, score = np.concatenate((found, alive + lo)), np.concatenate((score, np.round(total[alive], 6)))
            order = np.lexsort((tie[found], -score))[:k]
            found, score = found[order], score[order]
            if len(found) == k:
                threshold = score[-1]
    return found, score


def _slice(docs: DataFrame, item_ids: list, texts: list, k: int) -> DataFrame:
    vocabulary, terms = query_terms(texts)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, terms, item_ids))

    def build(batches):
        v = shared.value[0]
        for ids, texts in words.blocks(batches, BLOCK):
            size, begin, doc, tf = postings(texts, v)
            step = np.diff(doc, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), *(pa.array([planes(x, w)], pa.binary()) for x, w in ((size, 4), (begin, 8), (step.astype(np.int32), 4), (tf, 4)))],
                names=["ids", "size", "begin", "doc", "tf"],
            )

    table = save_table(docs.mapInArrow(build, "ids array<long>, size binary, begin binary, doc binary, tf binary"), "postings")

    def counts(batches):
        for b in batches:
            for size, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = unplanes(size, 4)
                df = np.diff(unplanes(begin, 8).astype(np.int64))
                t = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], t))), pa.array(np.concatenate(([len(n), int(n.sum())], df[t])))], names=["t", "n"])

    got = dict(table.select("size", "begin").mapInArrow(counts, "t long, n long").groupBy("t").agg(F.sum("n")).collect())
    n, mean = got.get(-2, 0), max(1, got.get(-1, 0)) / max(1, got.get(-2, 0))
    df = np.array([got.get(t, 0) for t in range(len(vocabulary))], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def search(batches):
        _, all_terms, items = shared.value
        for b in batches:
            for ids, *raw in zip(*(b.column(c).to_pylist() for c in range(5))):
                size, begin = unplanes(raw[0], 4).astype(np.float64), unplanes(raw[1], 8).astype(np.int64)
                doc = np.cumsum(unplanes(raw[2], 4).view(np.int32).astype(np.int64))
                tf = unplanes(raw[3], 4).astype(np.float64)
                own = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                gain = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
                bound = np.zeros(len(begin) - 1)
                np.maximum.at(bound, own, gain)
                tie = np.lexsort((np.array([x or 0 for x in ids]), np.array([x is None for x in ids]))).argsort()
                out = []
                for q, t in enumerate(all_terms):
                    found, score = best(t, begin, doc, gain, bound, len(ids), k, tie)
                    out += [(q, items[q], ids[d], s) for d, s in zip(found.tolist(), score.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["q", "item_id", "doc_id", "score"])

    hits = table.mapInArrow(search, "q int, item_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each row of ``queries``."""
    docs = settle(docs, ["doc_id", "text"]).select("doc_id", "text")
    queries = settle(queries, ["item_id", "text"]).select("item_id", "text").filter("text is not null")
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, out = 1 + int(size) * 6 // limit, None
    for s in range(slices):
        rows = queries.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).collect() if slices > 1 else queries.collect()
        part = _slice(docs, [r["item_id"] for r in rows], [r["text"] for r in rows], k)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


SQL = f"""WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{words.WORD_RE}')) AS w FROM documents),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM dw GROUP BY ALL),
    size AS (SELECT doc_id, count(*) AS dl FROM dw GROUP BY ALL),
    total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM dw) / (SELECT count(*) FROM documents) AS mean),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
    q AS (SELECT item_id, w, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{words.WORD_RE}')) AS w FROM benchmark) GROUP BY ALL),
    hits AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), 6) AS score
      FROM q JOIN tf USING (w) JOIN df USING (w) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM hits QUALIFY rank <= {K}"""
