"""Seeded generators of address blocks, lists and text blocks, and their augmentation.

A row depends on (seed, id) alone: any partitioning gives the same rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..cells import slices

STREETS = "Oak Elm Mill Station Harbour Castle Garden Market River Forest".split()
TOWNS = "Northam Eastwick Lindau Marbach Torrevieja Avignon Westerly Oldenburg".split()
NAMES = "Ana Ben Clara David Elena Frank Greta Hugo Iris Jonas".split()
FIRMS = "Solar Micro Data Metal Print Cargo Alpine Delta".split()
KINDS = ("address", "contact", "list", "text", "code")


def address(r: random.Random, contact: bool = False, field_names: float = 0.3) -> str:
    """An address or contact block of weighted parts."""
    lines = [r.choice(NAMES) + " " + r.choice(FIRMS) + "son"]
    if r.random() < 0.7:
        lines.append(r.choice(FIRMS) + r.choice([" GmbH", " Ltd.", " Inc.", " S.A."]))
    lines += [f"{r.choice(STREETS)} {r.choice(['Street', 'Road', 'Avenue'])} {r.randint(1, 200)}", f"{r.randint(10000, 99999)} {r.choice(TOWNS)}"]
    if contact:
        for label, value in (("Tel", f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(10000, 99999)}"), ("E-mail", f"{r.choice(NAMES).lower()}@{r.choice(FIRMS).lower()}.example")):
            lines.append(f"{label}: {value}" if r.random() < field_names + 0.5 else value)
    return "\n".join(lines)


def bullets(r: random.Random) -> str:
    sign = r.choice(["- ", "* ", "• ", "1. "])
    return "\n".join(sign + sentence(r, 4) for _ in range(r.randint(2, 8)))


def sentence(r: random.Random, most: int = 12) -> str:
    return " ".join(r.choice(STREETS + TOWNS + NAMES + FIRMS).lower() for _ in range(r.randint(2, most))).capitalize() + "."


def block(r: random.Random, kind: str) -> str:
    if kind in ("address", "contact"):
        return address(r, kind == "contact")
    if kind == "list":
        return bullets(r)
    if kind == "code":
        return "\n".join(f"{'  ' * r.randint(0, 2)}{r.choice(NAMES).lower()} = {r.randint(0, 99)}" for _ in range(r.randint(2, 8)))
    return " ".join(sentence(r) for _ in range(1 + int(r.gammavariate(2, 2))))


def augment(r: random.Random, text: str, rate: float = 0.1) -> str:
    """Noise on words and letters: dropped, doubled, swapped or re-cased ones, changed separators."""
    words = []
    for w in text.split(" "):
        if r.random() >= rate or len(w) < 2:
            words.append(w)
            continue
        k, how = r.randrange(len(w) - 1), r.choice(["drop", "double", "swap", "upper", "lower", "cut", "twice"])
        words += {"drop": [w[:k] + w[k + 1 :]], "double": [w[:k] + w[k] + w[k:]], "swap": [w[:k] + w[k + 1] + w[k] + w[k + 2 :]], "upper": [w.upper()], "lower": [w.lower()], "cut": [], "twice": [w, w]}[how]
    return (" " if r.random() > rate else "\n").join(words)


def generate(spark: SparkSession, n: int, seed: int = 0, weights: dict[str, float] | None = None, noise: float = 0.1) -> DataFrame:
    """(id, kind, text): ``n`` blocks of a weighted mix of kinds."""
    weights = weights or {k: 1.0 for k in KINDS}

    def run(batches):
        for b in batches:
            rows = []
            for i in b["id"]:
                r = random.Random(f"{seed}:{i}")
                kind = r.choices(list(weights), list(weights.values()))[0]
                rows.append((i, kind, augment(r, block(r, kind), noise)))
            yield pd.DataFrame(rows, columns=["id", "kind", "text"])

    return spark.range(n).mapInPandas(run, "id long, kind string, text string")


def _hash_ints(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 32-bit integers, after what has the hash ``seeds``."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    u = np.uint64
    h = (seeds + p5 + u(4)) ^ (values.astype(u) & u(0xFFFFFFFF)) * p1
    h = (h << u(23) | h >> u(41)) * p2 + p3
    h = (h ^ h >> u(33)) * p2
    h = (h ^ h >> u(29)) * p3
    return h ^ h >> u(32)


def random_chunks(text: Column, seed: int = 0, smallest: int = 20, largest: int = 80) -> Column:
    """Array of chunks of hashed sizes that together are the text.

    The size of chunk k is ``smallest + pmod(xxhash64(text, k, seed), largest - smallest + 1)``; the text is hashed once.
    """
    kind = T.ArrayType(T.StringType())

    def chunks(texts: list, hashes: np.ndarray) -> list:
        n = np.array([0 if x is None else -(-len(x) // smallest) for x in texts])
        ends = np.cumsum(n)
        k = np.arange(n.sum()) - np.repeat(ends - n, n)
        h = _hash_ints(np.full(len(k), seed), _hash_ints(k, np.repeat(hashes, n))).view(np.int64)
        size, out = smallest + h % (largest - smallest + 1), []
        for x, end, m in zip(texts, ends, n):
            cut = [0, *np.cumsum(size[end - m : end]).tolist()]
            out.append(None if x is None else [x[a:b] for a, b in zip(cut, cut[1:]) if a < len(x)])
        return out

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, h in batches:
            hashes, at = h.to_numpy(zero_copy_only=False).view(np.uint64), 0
            for s in slices(b):
                yield pa.array(chunks(s.to_pylist(), hashes[at : at + len(s)]), to_arrow_type(kind))
                at += len(s)

    return F.arrow_udf(run, kind)(text, F.xxhash64(text))


def text_sample(text: Column, size: int, seed: int = 0) -> Column:
    """A substring at a hashed place."""
    return F.substring(text, F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(F.length(text) - size, F.lit(1)).cast("long")).cast("int") + 1, F.lit(size))
