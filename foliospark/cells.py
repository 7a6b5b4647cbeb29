"""Joins that are quadratic within a group, cut into cells of bounded size; slices of bounded length for Python columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Keys that ``cells`` adds to both sides.
CELL = ["_left", "_right"]
#: Bytes of text whose results a Python worker holds at once.
SLICE_BYTES = 256 << 10


def cells(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, block: int, sizes: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys ``CELL``: rows of a pair that is equal in ``on`` meet in exactly one cell, and a cell
    has about ``block`` rows of each side at most.

    Only groups over ``block`` are cut, by hashes of the ids; their rows are copied to all slices of the other side.
    ``sizes``: cheaper tables with the same groups, to count instead. Rows with a null in ``on`` are left out.
    """
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own, where both are one table
    for c in on:
        left, right = left.filter(F.col(c).isNotNull()), right.filter(F.col(c).isNotNull())

    def large(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > block)
        return n.select(*on, F.ceil(F.col("n") / block).cast("int").alias(name))

    a, b = sizes or (left, right)
    parts = large(a, "_l").join(large(b, "_r"), on, "full_outer").select(*on, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_l", "_r")])
    each = lambda df: df.join(F.broadcast(parts), on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_l", "_r")})
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = each(left).withColumn("_left", own(left_id, "_l")).withColumn("_right", every("_r")).drop("_l", "_r")
    right = each(right).withColumn("_right", own(right_id, "_r")).withColumn("_left", every("_l")).drop("_l", "_r")
    return left, right


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """An array of texts in slices of at most so many bytes, or of one text."""
    at, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if k > at and held + n + 64 > most:
            yield column.slice(at, k - at)
            at, held = k, 0
        held += n + 64
    yield column.slice(at)


def mapped(f: Callable, kind: T.DataType, column: Column | str) -> Column:
    """Column of f of each text. Texts become Python objects, and results are given back, slice by slice."""
    out = to_arrow_type(kind)
    plain = (lambda x: None if x is None else list(x.items())) if isinstance(kind, T.MapType) else (lambda x: x)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for s in slices(b):
                yield pa.array([plain(f(x)) for x in s.to_pylist()], out)

    return F.arrow_udf(run, kind)(column)
