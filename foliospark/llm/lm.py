"""LM scoring: deleted interpolation of n-gram estimates, with weights learned by EM.

The probability of a word is the mix of its maximum-likelihood estimates after the last ``ORDER`` - 1,
..., 1, 0 words and of a uniform one (1 / (words known + 1)). Mixture weights depend on a bucket:
the bit lengths of how often the contexts occur. They are learned by expectation-maximisation on
held-out documents (a hash picks ``HELD_OUT`` of 1000). Estimates are deleted ones: a document is scored,
held out or not, on the counts of the whole corpus less its own.

Counts cover all words of all documents. Chunks of documents are written once, as lists of words. A chunk
sends its distinct n-grams, as sorted hashes with counts, to ranges of the hash (``RANGES`` for eight chunks, so a range
takes about as much at any size); each range adds up its chunks' lists and answers each of
them with the corpus counts in the order of its list, one n after the other; the chunk's own row meets the answers and scores its
documents. The table of counts is never held in one place, what is moved grows
with the distinct n-grams of the chunks, and no later step depends on how the documents were split.

Result: doc_id, words, log2 probability of the words, bits per word. Defined results: null and empty
texts have 0 words, 0 bits and null bits per word; very long
texts make chunks of their own, scored whole; nulls in doc_id stay; a repeated row is a document of
its own; other columns don't matter; an empty table gives no rows. If fewer than ``LEAST`` words are
held out, the weights are learned from all documents (their own counts are deleted all the same).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import save_table, settle
from . import words
from .suffixes import pack_sorted, planes, unpack_sorted, unplanes

ORDER, HELD_OUT, LEAST, ROUNDS, LEVELS, BLOCK, RANGES = 3, 20, 100, 12, 12, 2 << 20, 2
U = np.uint64


def _small(x: np.ndarray) -> bytes:
    """Numbers, most of them small, as compressed planes."""
    return zstandard.ZstdCompressor(level=1).compress(planes(x, 8))


def _large(b: bytes) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(b), 8).astype(np.int64)


def _layout(first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By n: where n-grams start, and whether a word follows each."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    out = []
    for n in range(1, order + 1):
        pos = np.flatnonzero(left >= n)
        out.append((pos, left[pos] > n if n < order else np.zeros(len(pos), bool)))
    return out


def _gram(h: np.ndarray, first: np.ndarray, n: int, order: int) -> tuple:
    """Sorted distinct n-grams, place of each n-gram in them, start of each, and whether a word follows it."""
    pos, follows = _layout(first, order)[n - 1]
    key, inverse = np.unique(words.ngrams(h, first, n)[0], return_inverse=True)
    return key, inverse, pos, follows


def _grams(h: np.ndarray, first: np.ndarray, order: int) -> list[tuple]:
    """``_gram`` by n."""
    return [_gram(h, first, n, order) for n in range(1, order + 1)]


def bucket_of(contexts: list[np.ndarray], levels: int = LEVELS) -> np.ndarray:
    """Bucket from the counts of the contexts, longest last."""
    b = np.zeros(len(contexts[0]), np.int64) if contexts else None
    for c in contexts:
        b = b * levels + np.minimum(np.ceil(np.log2(c + 1.0)).astype(np.int64), levels - 1)
    return b


def chances(first: np.ndarray, grams: list[tuple], counts: list[tuple], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and estimates (words x orders, lowest first) of each word, with its document's own
    counts deleted. ``counts``: by n, corpus counts of the distinct n-grams and of those with a
    following word."""
    size = first[-1]
    doc = words.doc_of(first)
    own = np.diff(first)[doc]
    p = np.zeros((size, len(grams)))
    contexts, before = [], None
    for n, ((_, inverse, pos, follows), (count, ctx)) in enumerate(zip(grams, counts), 1):
        _, at, mine = np.unique(doc[pos] * np.int64(len(count) + 1) + inverse, return_inverse=True, return_counts=True)
        rest = count[inverse] - mine[at]
        word = pos + n - 1
        if n == 1:
            p[:, 0] = rest / np.maximum(total - own, 1)
        else:
            c = np.zeros(size)
            c[word] = before[pos]
            contexts.append(c)
            p[word, n - 1] = rest / np.maximum(c[word], 1)
        mine_ctx = np.bincount(at, follows, minlength=len(mine))
        before = np.zeros(size)
        before[pos] = ctx[inverse] - mine_ctx[at]
    return bucket_of(contexts) if contexts else np.zeros(size, np.int64), p


def chance_of(p: np.ndarray, bucket: np.ndarray, weights: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixed probabilities. ``weights``: buckets x (orders + 1), the uniform one first."""
    w = weights[bucket]
    return w[:, 0] / (vocabulary + 1) + (w[:, 1:] * p).sum(1)


_ROW = "part int, chunk long, n int, a binary, b binary, c binary"
_CHUNK = "part int, chunk long, n int, a binary, b binary, c binary, ids array<long>"
_NAMES = ["part", "chunk", "n", "a", "b", "c"]


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=_NAMES)


def _chunks(docs: DataFrame, block: int) -> DataFrame:
    """One row (part -1) for each chunk of documents: distinct words, words as places in them, layout, doc_ids."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(words.blocks(batches, block)):
            h, _, _, first, _ = words.scan(texts)
            key, inverse = np.unique(h, return_inverse=True)
            got = _batch([(-1, (task << 32) + k, 0, _zip(pack_sorted(key)), _zip(planes(inverse, 4)), _zip(planes(first, 4)))])
            yield got.append_column("ids", pa.array([ids], pa.list_(pa.int64())))

    return save_table(docs.mapInArrow(run, _CHUNK), "chunks")


def _words(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk and the first one of each document."""
    key, first = unpack_sorted(_unzip(a)), unplanes(_unzip(c), 4).astype(np.int64)
    return key[unplanes(_unzip(b), 4)] if len(key) else np.zeros(0, U), first


def _each(batches):
    """(chunk, words, first) of chunk rows, one at a time."""
    for b in (x for whole in batches for x in words.slices(whole, 1)):
        chunk, *raw = (b.column(c)[0].as_py() for c in range(4))
        yield chunk, *_words(*raw)
    words.give_back()


def _count(chunks: DataFrame, n: int, order: int, bits: int) -> DataFrame:
    """Answers about n-grams: (part, chunk, n, corpus counts, counts with a following word); rows with chunk -1
    hold a range's count of distinct n-grams and total. A chunk has rows for the ranges it meets only."""

    def ask(batches):
        for chunk, h, first in _each(batches):
            key, inverse, _, follows = _gram(h, first, n, order)
            count, ctx = np.bincount(inverse, minlength=len(key)), np.bincount(inverse, follows, minlength=len(key))
            part = (key >> U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.append(np.diff(part, prepend=-1) != 0, True)).tolist()
            yield _batch([(int(part[i]), chunk, n, pack_sorted(key[i:j]), _small(count[i:j]), _small(ctx[i:j])) for i, j in zip(cut, cut[1:])])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(a) for a in rows["a"]]
        union, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([_large(x) for x in rows[c]]), minlength=len(union)).astype(np.int64) for c in ("b", "c")]
        cut = np.cumsum([0, *map(len, keys)])
        out = rows.assign(a=None, b=[_small(sums[0][inverse[i:j]]) for i, j in zip(cut, cut[1:])], c=[_small(sums[1][inverse[i:j]]) for i, j in zip(cut, cut[1:])])
        stat = pd.DataFrame({"part": [rows["part"].iloc[0]], "chunk": [-1], "n": [rows["n"].iloc[0]], "a": [None], "b": [_small(np.array([len(union)]))], "c": [_small(np.array([sums[0].sum()]))]})
        return pd.concat([out, stat])

    return chunks.select("chunk", "a", "b", "c").mapInArrow(ask, _ROW).groupBy("part").applyInPandas(answer, _ROW)


def _held_rows(chunks: DataFrame, order: int, share: int) -> DataFrame:
    """One row (part -1) for each chunk with held-out documents: places of their n-grams in the chunk's lists, sizes of
    the lists, layout."""

    def run(batches):
        for chunk, h, first in _each(batches):
            pick = held_out(first, h, share)
            if pick.any():
                own, grams = pick[words.doc_of(first)], _grams(h, first, order)
                at = np.concatenate([inverse[own[pos]] for _, inverse, pos, _ in grams])
                yield _batch([(-1, chunk, 0, planes(at, 4), planes(np.array([len(g[0]) for g in grams]), 8), planes(np.concatenate(([0], np.cumsum(np.diff(first)[pick]))), 4))])

    return chunks.select("chunk", "a", "b", "c").mapInArrow(run, _ROW)


def _counts(rows: pd.DataFrame, order: int, sizes: list[int]) -> list[tuple]:
    """By n: the chunk's answers, in the order of its distinct n-grams."""
    out = []
    for n in range(1, order + 1):
        own = rows[rows["n"] == n].sort_values("part")
        got = tuple(np.concatenate([_large(x) for x in own[c]]) if len(own) else np.zeros(0, np.int64) for c in ("b", "c"))
        if len(got[0]) != sizes[n - 1]:
            raise ValueError("the answers don't fit the chunk")
        out.append(got)
    return out


def _restore(rows: pd.DataFrame, order: int) -> tuple:
    """Documents, n-grams and corpus counts of one chunk."""
    info = rows[rows["part"] < 0].iloc[0]
    h, first = _words(info["a"], info["b"], info["c"])
    grams = _grams(h, first, order)
    return info["ids"], first, grams, _counts(rows, order, [len(g[0]) for g in grams])


def _restore_held(rows: pd.DataFrame, order: int) -> tuple:
    """The same for the held-out documents only."""
    info = rows[rows["part"] < 0].iloc[0]
    first, places = unplanes(info["c"], 4).astype(np.int64), unplanes(info["a"], 4).astype(np.int64)
    grams, at = [], 0
    for pos, follows in _layout(first, order):
        grams.append((None, places[at : at + len(pos)], pos, follows))
        at += len(pos)
    return first, grams, _counts(rows, order, unplanes(info["b"], 8).astype(np.int64).tolist())


def held_out(first: np.ndarray, h: np.ndarray, share: int) -> np.ndarray:
    """Which documents are held out: a hash of their words picks ``share`` of 1000."""
    if not len(h):
        return np.zeros(len(first) - 1, bool)
    s = np.concatenate(([U(0)], np.cumsum(words.mix(h + U(1)), dtype=U)))
    return words.mix(s[first[1:]] - s[first[:-1]]) % U(1000) < share


def _learn(table: DataFrame, buckets: int, orders: int, vocabulary: int, rounds: int) -> np.ndarray:
    """Weights by expectation-maximisation over rows (bucket, p by order)."""
    weights = np.full((buckets, orders + 1), 1.0 / (orders + 1))
    for _ in range(rounds):
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
        w = F.element_at(rows, F.col("bucket") + 1)
        parts = [F.element_at(w, 1) / F.lit(vocabulary + 1.0)] + [F.element_at(w, k + 2) * F.col(f"p{k + 1}") for k in range(orders)]
        whole = sum(parts[1:], parts[0])
        got = table.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(x / whole).alias(f"r{k}") for k, x in enumerate(parts)]).collect()
        new = weights.copy()
        for r in got:
            share = np.array([r[f"r{k}"] for k in range(orders + 1)])
            share = np.maximum(share, 1e-6 * r["n"])
            new[r["bucket"]] = share / share.sum()
        if np.abs(new - weights).max() < 1e-4:
            return new
        weights = new
    return weights


def score(docs: DataFrame, order: int = ORDER, held: int = HELD_OUT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, words, log2_prob, bits_per_word)."""
    chunks = _chunks(settle(docs, ["doc_id", "text"]).select("doc_id", "text"), block)
    bits = max(1, (chunks.count() * RANGES // 8).bit_length())
    tables = [save_table(_count(chunks, n, order, bits), f"answers{n}") for n in range(1, order + 1)]  # one at a time: less is on disk at once
    answers = reduce(DataFrame.unionByName, tables)
    whole = answers.filter("chunk = -1 and n = 1").select("b", "c")
    numbers = lambda c: int(sum(_large(r[c])[0] for r in whole.collect()))
    vocabulary, total = numbers("b"), numbers("c")
    own = answers.filter("chunk >= 0")
    names = [f"p{n}" for n in range(1, order + 1)]

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        if not (rows["part"] < 0).any():
            return pd.DataFrame({"bucket": np.zeros(0, np.int32), **{c: np.zeros(0) for c in names}})
        first, grams, counts = _restore_held(rows, order)
        bucket, p = chances(first, grams, counts, total)
        return pd.DataFrame({"bucket": bucket.astype(np.int32), **{c: p[:, k] for k, c in enumerate(names)}})

    buckets = LEVELS ** (order - 1)

    def drawn(share: int) -> DataFrame:
        return save_table(_held_rows(chunks, order, share).unionByName(own).groupBy("chunk").applyInPandas(learn, "bucket int, " + ", ".join(f"{c} double" for c in names)), "heldout")

    sample = drawn(held)
    if sample.count() < LEAST:
        sample = drawn(1000)
    weights = _learn(sample, buckets, order, vocabulary, rounds)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        ids, first, grams, counts = _restore(rows, order)
        bucket, p = chances(first, grams, counts, total)
        logs = np.concatenate(([0.0], np.cumsum(np.log2(chance_of(p, bucket, weights, vocabulary)))))
        n = np.diff(first)
        log2 = logs[first[1:]] - logs[first[:-1]]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in ids], dtype="Int64"), "words": n, "log2_prob": np.where(n > 0, log2, 0.0), "bits_per_word": pd.array([-a / b if b else None for a, b in zip(log2, n)], dtype="Float64")})

    return chunks.unionByName(own.withColumn("ids", F.lit(None).cast("array<long>"))).groupBy("chunk").applyInPandas(finish, "doc_id long, words long, log2_prob double, bits_per_word double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, to 6 digits."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "words", F.round("log2_prob", 6).alias("log2_prob"), F.round("bits_per_word", 6).alias("bits_per_word"))
