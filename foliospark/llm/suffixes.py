"""Suffix-array dedup: passages of at least ``MIN_WORDS`` words that repeat across documents.

Documents are cut into shards. In each one the suffix array over word hashes is built by
Larsson-Sadakane refinement (prefix doubling that re-sorts unsorted groups only), and the longest
common prefixes of neighbours by Kasai's rule in its text-order form: where a suffix and its
neighbour are preceded by the same word, the prefix is the previous one less 1; only the other ones
are compared word by word. Suffixes with a common prefix of ``MIN_WORDS`` form a class; a class
with several documents is a repeat. Across shards, each one sends its suffixes of at least that
length as sorted hashes of their first ``MIN_WORDS`` words, cut into ranges; a range is merged by
binary search of each shard's list in the union of all. Of a class that is a repeat within its
shard one suffix is sent. The result is the words covered by repeats, as maximal spans.

All words of all texts take part. Memory is bounded by the shard size (a longer document is a
shard of its own) and by the range size, as the number of ranges grows with the input.

Defined results: each row is a document: a repeated row repeats all its passages; repeats within
one row only don't count; null, empty and shorter texts have none; a null doc_id is reported as
null; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from . import words

MIN_WORDS, BLOCK = 50, 4 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence whose last value is unique, by Larsson-Sadakane."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    act, key = np.arange(n), t[sa]
    rank = np.zeros(n, np.int64)
    h = 0
    while len(act):
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        size = np.diff(end, prepend=-1)
        idx = sa[act]
        rank[idx] = np.repeat(act[end], size)
        open_ = np.repeat(size > 1, size)
        act, idx = act[open_], idx[open_]
        if not len(act):
            break
        h = 2 * h if h else 1
        nxt = idx + h
        key = rank[idx] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[act] = idx[order]
        key = key[order]
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix and its predecessor in the array (the first has 0)."""
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (before < 0) | (i == 0) | (before == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[before[rest] - 1]
    a = np.flatnonzero(fresh & (before >= 0))
    b, size = before[a], np.zeros(len(a), np.int64)
    padded = np.concatenate((t, np.full(512, -1, t.dtype)))
    todo, step = np.arange(len(a)), 2
    while len(todo):
        for lo in range(0, len(todo), 1 << 18):
            part = todo[lo : lo + (1 << 18)]
            off = size[part][:, None] + np.arange(step)
            same = padded[a[part][:, None] + off] == padded[b[part][:, None] + off]
            size[part] += np.where(same.all(1), step, same.argmin(1))
            todo[lo : lo + (1 << 18)] = np.where(same.all(1), part, -1)
        todo = todo[todo >= 0]
        step = min(2 * step, 256)
    plcp = np.zeros(n, np.int64)
    plcp[a] = size
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.maximum(plcp[last] - (i - last), 0)
    return plcp[sa]


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Rolling Karp-Rabin hash of each run of ``size`` words."""
    n = len(h)
    power = np.full(n + 1, _BASE)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(n + 1, _BACK)
    back[0] = 1
    back = np.cumprod(back)
    s = np.zeros(n + 1, U)
    np.cumsum(h * power[:n], out=s[1:])
    return words.mix((s[size:] - s[:-size]) * back[: n - size + 1])


def local(texts: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: first word of each text, starts of windows that repeat within it, and the
    sorted hashes and starts of the windows to be sent."""
    h, _, _, first, _ = words.scan(texts)
    n, docs = len(h), len(first) - 1
    none = np.zeros(0, np.int64)
    if n < size:
        return first, none, none.astype(U), none
    doc = words.doc_of(first)
    ids = np.unique(h, return_inverse=True)[1] + docs
    at = np.arange(n) + doc
    t = np.zeros(n + docs, np.int64)
    t[at] = ids
    t[first[1:] + np.arange(docs)] = np.arange(docs)
    word = np.full(n + docs, -1)
    word[at] = np.arange(n)
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa)
    head = np.flatnonzero(lcp < size)
    group = np.cumsum(lcp < size) - 1
    place = word[sa]
    owner = np.where(place >= 0, doc[place], -1)
    several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
    left = np.where(place >= 0, first[owner + 1] - place, 0)
    valid = left >= size
    repeated = place[valid & several[group]]
    is_head = np.zeros(len(sa), bool)
    is_head[head] = True
    send = place[valid & (~several[group] | is_head)]
    key = windows(h, size)[send]
    order = np.argsort(key)
    return first, np.sort(repeated), key[order], send[order]


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes by significance: planes of zeros shrink to nothing in the shuffle."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(f"<u{width}")


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as planes of differences."""
    return planes(np.diff(x, prepend=U(0)), 8)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, 8).astype(U), dtype=U)


def parts_of(df: DataFrame, each: int) -> int:
    """Bits of a number of ranges that grows with the partitions of the input."""
    return max(1, (each * df.rdd.getNumPartitions() - 1).bit_length())


_ROW = "part int, shard long, ids array<long>, a binary, b binary"


def spans(docs: DataFrame, size: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, words) of the maximal spans covered by repeats, in words from 0."""
    docs = settle(docs, ["doc_id", "text"]).select("doc_id", "text")
    bits = parts_of(docs, 3)

    def build(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(words.blocks(batches, block)):
            shard = (task << 32) + k
            first, repeated, key, send = local(texts, size)
            part = [-1 - shard % (1 << bits)]
            rows = [(ids, planes(first, 4), pack_sorted(repeated.astype(U)))]
            met = (key >> U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.append(np.diff(met, prepend=-1) != 0, True)).tolist()
            for i, j in zip(cut, cut[1:]):  # the ranges that the shard meets only, however many there are
                part.append(int(met[i]))
                rows.append((None, pack_sorted(key[i:j]), planes(send[i:j], 4)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([shard] * len(part), pa.int64()), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.list_(pa.int64()), pa.binary(), pa.binary())))],
                names=["part", "shard", "ids", "a", "b"],
            )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] < 0:
            return rows
        lists = [unpack_sorted(a) for a in rows["a"]]
        union = np.concatenate([x[np.flatnonzero(np.append(True, x[1:] != x[:-1]))] for x in lists])
        union.sort()
        out = []
        for x, b in zip(lists, rows["b"]):
            hit = np.searchsorted(union, x, "right") - np.searchsorted(union, x, "left") > 1
            out.append(planes(unplanes(b, 4)[hit], 4) if hit.any() else None)
        return rows.assign(a=None, b=out).dropna(subset=["b"])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        info = rows[rows["part"] < 0].iloc[0]
        first = unplanes(info["a"], 4).astype(np.int64)
        at = np.concatenate([unpack_sorted(info["b"]).astype(np.int64), *(unplanes(b, 4).astype(np.int64) for b in rows.loc[rows["part"] >= 0, "b"])])
        edge = np.bincount(at, minlength=first[-1] + 1)[: first[-1] + 1] - np.bincount(at + size, minlength=first[-1] + 1)[: first[-1] + 1]
        covered = np.cumsum(edge)[:-1] > 0
        mark = np.concatenate(([False], covered, [False]))
        new = np.zeros(first[-1] + 1, bool)
        new[first] = True
        start = np.flatnonzero(covered & (~mark[:-2] | new[:-1]))
        end = np.flatnonzero(covered & (~mark[2:] | new[1:])) + 1
        doc = np.searchsorted(first, start, "right") - 1
        ids = np.array(info["ids"], dtype=object)
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(ids[d]) else int(ids[d]) for d in doc], dtype="Int64"), "start": (start - first[doc]).astype(np.int32), "words": (end - start).astype(np.int32)})

    sent = docs.mapInArrow(build, _ROW).groupBy("part").applyInPandas(merge, _ROW)
    return sent.groupBy("shard").applyInPandas(finish, "doc_id long, start int, words int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the documents that repeat in other documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
