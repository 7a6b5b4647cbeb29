"""Row numbers that don't depend on the layout of the input, and keyed permutations of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import places

ROUNDS = 6
_A, _B, _C = 2654435761, 1540483477, 1 << 32


def order_hash(key: Column, seed: int = 0) -> Column:
    """A 32-bit hash of a long in plain arithmetic, so that SQL can repeat it; null counts as 0."""
    x = F.pmod(F.coalesce(key.cast("long"), F.lit(0)), F.lit(1 << 31)).bitwiseXOR(F.lit(seed % (1 << 31)))
    x = (x * F.lit(_A)) % F.lit(_C)
    return (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(_B)) % F.lit(_C)


def order_hash_sql(key: str, seed: int = 0) -> str:
    x = f"((xor(((coalesce({key}, 0) % 2147483648) + 2147483648) % 2147483648, {seed % (1 << 31)}) * {_A}) % {_C})"
    return f"((xor({x}, {x} >> 15) * {_B}) % {_C})"


def row_numbers(df: DataFrame, key: str, name: str, seed: int = 0, **kw) -> tuple[DataFrame, int]:
    """``df`` with its global row number in the order of (hash of key, key with nulls first, hash of the row), and
    the count of rows.

    Only hash, key and place of each row are shuffled; the numbers go back to the rows by their places.
    """
    df = places.located(df)
    own = [F.col(f"`{c}`") for c in df.columns if c not in (places.FOLDER, places.ROW)]
    k = F.col(f"`{key}`")
    narrow = df.select(places.FOLDER, places.ROW, order_hash(k, seed).alias("__h"), k.alias("__key"), F.xxhash64(*own).alias("__x"), F.lit(1).alias("__w"))
    numbered = places.running(narrow, ["__h", F.col("__key").asc_nulls_first(), "__x"], "__w", **kw)
    path = places.write(numbered, "__c")
    return df.withColumn(name, places.answer(path)).drop(places.FOLDER, places.ROW), numbered.count()


def round_keys(key: int) -> list[int]:
    """Round keys of 31 bits from a key."""
    out, x = [], key % (1 << 64)
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 33)
    return out


def half_bits(n: int) -> int:
    """The least h from 1 with 4^h >= n."""
    return max(1, -(-max(0, n - 1).bit_length() // 2))


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the next power of four; values
    that fall outside walk the cycle until they come back."""
    half = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(k) for k in round_keys(key)]
    low = np.uint64(_C - 1)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            f = ((right ^ k) * np.uint64(_A)) & low
            f = ((f ^ (f >> np.uint64(15))) * np.uint64(_B)) & low
            left, right = right, left ^ ((f ^ (f >> np.uint64(13))) & mask)
        return (left << half) | right

    y = network(np.asarray(x).astype(np.uint64))
    while len(out := np.flatnonzero(y >= n)):
        y[out] = network(y[out])
    return y.astype(np.int64)


def slot_of(number: Column, n: int, key: int) -> Column:
    """The permuted row number as a column."""

    @F.pandas_udf("long")
    def slot(v: pd.Series) -> pd.Series:
        return pd.Series(permute(v.to_numpy(), n, key))

    return slot(number)


def permute_sql(source: str, key: int) -> str:
    """CTEs on a table ``source`` (x, n, and other columns), ending in ``slots`` with the column slot."""

    def network(table: str, value: str, cols: str) -> str:
        q = f"SELECT {cols}, half, ({value} >> half) AS l, ({value} & ((1::UBIGINT << half) - 1)) AS r FROM {table}"
        for k in round_keys(key):
            f = f"(xor(r, {k}::UBIGINT) * {_A}::UBIGINT) & {_C - 1}::UBIGINT"
            q = f"SELECT {cols}, half, l, r, {f} AS f FROM ({q})"
            q = f"SELECT {cols}, half, l, r, (xor(f, f >> 15) * {_B}::UBIGINT) & {_C - 1}::UBIGINT AS f FROM ({q})"
            q = f"SELECT {cols}, half, r AS l, xor(l, xor(f, f >> 13) & ((1::UBIGINT << half) - 1)) AS r FROM ({q})"
        return f"SELECT {cols}, half, ((l << half) | r) AS y FROM ({q})"

    return f"""sized AS (SELECT x, n, (SELECT min(h) FROM range(1, 32) t(h) WHERE pow(4, h) >= n)::UBIGINT AS half, x::UBIGINT AS v FROM {source}),
    walk AS ({network("sized", "v", "x, n")}
      UNION ALL {network("(SELECT x, n, half, y AS v FROM walk WHERE y >= n)", "v", "x, n")}),
    slots AS (SELECT x, y::BIGINT AS slot FROM walk WHERE y < n)"""
