"""Benchmark decontamination: greedy string tiling of test items over documents.

Words are compared as 64-bit hashes. Documents and items meet through shared seeds of ``MIN_MATCH`` words. An item
needs matched seeds at ``COVERAGE`` / ``MIN_MATCH`` of its words at least, so it only has to be met by one of its
rarer seeds: those that many items share are left out of the meeting as far as that bound allows, and no pair is lost.

For each pair that meets, the longest match that touches no marked word is marked as a tile, again and again, ties in
the order of item and document position, by running Karp-Rabin: the hash of each window of L words follows from
running sums, equal hashes are checked word by word, and the search length L falls from one longest match to
the next (found by bisection, as a match of L words holds one of L - 1). At each length every window that matches is a
longest match, so item windows are gone through once and take the first free window of the document: no table of
all pairs of places is made, however often a phrase is repeated.
An item whose tiles cover at least ``COVERAGE`` of its words is contaminated, in whatever order its
passages stand in the document. Pairs whose seeds cover too little of the item can't reach it and aren't tiled.

The items are broadcast in slices of a checked size; a larger benchmark takes more passes over
the documents and gives the same result.

Defined results: null and empty texts match nothing; items of fewer than ``MIN_MATCH`` words match
nothing; very long texts are compared whole; null ids are kept as they are; repeated documents or items are each
reported; other columns pass unchanged, whatever their names; empty tables give no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, settle
from . import words

MIN_MATCH, COVERAGE, BLOCK = 4, 0.6, 4 << 20
U = np.uint64
_BITS = 22


class _Running:
    """Karp-Rabin hashes of all windows of a sequence of words, by running sums, and its marks."""

    def __init__(self, h: np.ndarray, free: np.ndarray):
        self.h, self.free, self.sums = h, free, np.zeros(len(h) + 1, U)
        np.cumsum((h + U(1)) * _powers(len(h))[0], out=self.sums[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a mark, and their hashes."""
        marks = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(marks[size:] == marks[: len(marks) - size])
        return at, (self.sums[at + size] - self.sums[at]) * _powers(len(self.h))[1][at]


_BASE = U(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, U(pow(int(_BASE), -1, 1 << 64)))):
            p = np.full(max(n, 1 << 12), base)
            p[0] = 1
            _tables[k] = np.cumprod(p)
    return _tables[0][:n], _tables[1][:n]


def tiles(item: np.ndarray, doc: np.ndarray, k: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) of two sequences of words. ``free``: where the
    document's words may be used."""
    a, b = _Running(item, np.ones(len(item), bool)), _Running(doc, np.ones(len(doc), bool) if free is None else free.copy())
    out: list[tuple[int, int, int]] = []

    def same(i: int, j: int, size: int) -> bool:
        return np.array_equal(item[i : i + size], doc[j : j + size])

    def meet(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the item's windows, the place of each one's hash in the sorted ones; starts of the
        document's windows that have one of these hashes, and the place of it."""
        (i, hi), (j, hj) = a.windows(size), b.windows(size)
        known, of = np.unique(hi, return_inverse=True)
        at = np.minimum(np.searchsorted(known, hj), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == hj) if len(known) else np.zeros(0, np.int64)
        return i, of, j[hit], at[hit]

    def there(size: int) -> bool:
        i, of, j, at = meet(size)
        one = np.full(len(of) + 1, -1)
        one[of[::-1]] = i[::-1]
        if not len(j) or same(int(one[at[0]]), int(j[0]), size):
            return bool(len(j))
        return any(same(x, y, size) for x, o in zip(i.tolist(), of.tolist()) for y in j[at == o].tolist())

    top = min(len(item), len(doc))
    while top >= k:
        low, high = k - 1, top  # the longest match has ``low`` words at least, ``high`` at most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if there(mid) else (low, mid - 1)
        if low < k:
            break
        i, of, j, own = meet(low)
        order = np.argsort(own, kind="stable")
        j, begin = j[order], np.searchsorted(own[order], np.arange(len(of) + 1))
        at: dict[int, int] = {}
        for x, o in zip(i.tolist(), of.tolist()):
            if not a.free[x : x + low].all():
                continue
            q = int(begin[o + 1])
            p = at.get(o, int(begin[o]))
            while p < q and not b.free[j[p] : j[p] + low].all():
                p += 1
            at[o] = p
            for r in range(p, q):
                y = int(j[r])
                if b.free[y : y + low].all() and same(x, y, low):
                    out.append((x, y, low))
                    a.free[x : x + low] = b.free[y : y + low] = False
                    break
        top = low - 1
    return out


def index(item_ids: list, texts: list, k: int = MIN_MATCH, coverage: float = COVERAGE) -> dict:
    """The items' words and seeds: the sorted distinct seeds, by item those of each position, by seed the
    items that must be met through it, and a bitmap over the seeds."""
    h, _, _, first, _ = words.scan(texts)
    g, pos = words.ngrams(h, first, k)
    item = words.doc_of(first)[pos]
    seed, own = np.unique(g, return_inverse=True)
    pair = np.unique(own * np.int64(len(texts) + 1) + item)
    often = np.bincount(pair // (len(texts) + 1), minlength=len(seed))
    order = np.lexsort((own, often[own], item))
    begin = np.searchsorted(item, np.arange(len(texts) + 1))
    size = np.diff(first)
    met = np.diff(begin) - np.ceil(coverage * size / k - 1e-9).astype(np.int64) + 1  # one of so many rarest seeds has to match
    use = order[np.arange(len(order)) - begin[item] < np.maximum(met, 1)[item]] if coverage > 0 else order
    pair = np.unique(own[use] * np.int64(len(texts) + 1) + item[use])
    bits = np.zeros(1 << _BITS, bool)
    bits[(seed >> U(64 - _BITS)).astype(np.int64)] = True
    return {
        "k": k, "ids": item_ids, "words": size, "h": h, "first": first, "seed": seed, "of": own, "begin": begin, "bits": bits,
        "met": np.searchsorted(pair // (len(texts) + 1), np.arange(len(seed) + 1)), "items": pair % (len(texts) + 1),
    }


def contaminated(texts: list, idx: dict, coverage: float = COVERAGE) -> list[tuple[int, int, float, int]]:
    """(text, item, covered share, tiles) for each pair that reaches the coverage."""
    k, out = idx["k"], []
    h, _, _, first, _ = words.scan(texts)
    g, pos = words.ngrams(h, first, k)
    near = np.flatnonzero(idx["bits"][(g >> U(64 - _BITS)).astype(np.int64)])
    g, pos = g[near], pos[near]
    at = np.searchsorted(idx["seed"], g)
    there = at < len(idx["seed"])
    there[there] = idx["seed"][at[there]] == g[there]
    seed, pos = at[there], pos[there]
    doc = np.searchsorted(first, pos, side="right") - 1
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.unique(doc).tolist():
        own, where = seed[edge[d] : edge[d + 1]], pos[edge[d] : edge[d + 1]]
        has = np.unique(own)
        n = idx["met"][has + 1] - idx["met"][has]
        reach = np.unique(idx["items"][np.repeat(idx["met"][has] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        for item in reach.tolist():
            total, seeds = int(idx["words"][item]), idx["of"][idx["begin"][item] : idx["begin"][item + 1]]
            matched = np.flatnonzero(np.isin(seeds, has))
            seen = np.zeros(total, bool)
            for t in range(k):
                seen[matched + t] = True
            if seen.sum() < coverage * total:
                continue
            used = where[np.isin(own, seeds[matched])]
            free = np.zeros(first[d + 1] - first[d], bool)
            for t in range(k):
                free[used - first[d] + t] = True
            inside = np.flatnonzero(free | np.concatenate(([False], free[:-1])))  # each stretch and one word after it, that stays marked
            got = tiles(idx["h"][idx["first"][item] : idx["first"][item + 1]], h[first[d] + inside], k, free[inside])
            share = sum(t[2] for t in got) / total
            if share >= coverage:
                out.append((d, item, float(share), len(got)))
    return out


def _indexes(bench: DataFrame, k: int, coverage: float, limit: int):
    """Broadcasts of the items' seeds, one slice after another."""
    sc = bench.sparkSession.sparkContext
    bench = bench.select("item_id", "text").filter("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + int(size) * 6 // limit
    for s in range(slices):
        rows = bench.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).collect() if slices > 1 else bench.collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield sc.broadcast(index([r["item_id"] for r in rows], [r["text"] for r in rows], k, coverage))


def pairs(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of the contaminated documents."""
    docs, out = settle(docs, ["doc_id", "text"]).select("doc_id", "text"), None
    for bc in _indexes(settle(bench, ["item_id", "text"]), min_match, coverage, limit):

        def run(batches, bc=bc):
            idx = bc.value
            for ids, texts in words.blocks(batches, BLOCK):
                got = contaminated(texts, idx, coverage)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[g[0]] for g in got], pa.int64()), pa.array([idx["ids"][g[1]] for g in got], pa.int64()), pa.array([round(g[2], 6) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int32())],
                    names=["doc_id", "item_id", "coverage", "tiles"],
                )

        part = docs.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows."""
    names = docs.columns
    docs = settle(docs, ["doc_id", "text"])
    at = docs.columns.index("text")
    for bc in _indexes(settle(bench, ["item_id", "text"]), min_match, coverage, limit):

        def run(batches, bc=bc):
            for b in (x for whole in batches for x in words.slices(whole)):
                texts, keep, lo, size = b.column(at).to_pylist(), np.ones(b.num_rows, bool), 0, 0
                for r, t in enumerate(texts):
                    size += len(t or "")
                    if size >= BLOCK or r == len(texts) - 1:
                        keep[[lo + g[0] for g in contaminated(texts[lo : r + 1], bc.value, coverage)]] = False
                        lo, size = r + 1, 0
                yield b.filter(pa.array(keep))
            words.give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items found in them."""
    return pairs(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without contaminated ones."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
