"""Relational idioms of document work: deduplication, label merging, recoding, pivots, metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..cells import CELL, cells


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with ``_merge``: both, left_only, right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    out = a.join(b, on, "full_outer")
    flag = F.when(F.col("_l").isNull(), F.lit("right_only")).when(F.col("_r").isNull(), F.lit("left_only")).otherwise(F.lit("both"))
    return out.withColumn("_merge", flag).drop("_l", "_r")


#: Rows of a cell's side, candidate pairs held at once, and what rounding to 6 digits may hide.
BLOCK, PAIRS, HIDDEN = 1 << 17, 1 << 20, 2e-6


def _closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, start: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, id, distance) of the rows of ``b`` at the least distance from each row of ``a``, up to ``HIDDEN``:
    ``start`` and the sum of absolute differences. Of equal rows of ``b`` the least id counts.

    That sum is at least the difference of the rows' sums, so only a range of the sorted sums is looked at.
    """
    order = np.lexsort((ids, *b.T))
    b, ids = b[order], ids[order]
    new = np.append(True, (b[1:] != b[:-1]).any(1))
    b, ids = b[new], ids[new]
    order = np.argsort(b.sum(1), kind="stable")
    b, ids = b[order], ids[order]
    sums, own = b.sum(1), a.sum(1)

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.full(len(x), start)
        for c in range(x.shape[1]):
            d += np.abs(x[:, c] - y[:, c])
        return d

    near, best = np.searchsorted(sums, own), np.full(len(a), np.inf)
    for step in range(-4, 4):
        best = np.minimum(best, distance(a, b[np.clip(near + step, 0, len(b) - 1)]))
    reach = best - start + HIDDEN + 1e-9 * (np.abs(own) + best)
    lo, hi = np.searchsorted(sums, own - reach), np.searchsorted(sums, own + reach, "right")
    ends, out, k = np.cumsum(hi - lo), [], 0
    while k < len(a):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        n = hi[k:to] - lo[k:to]
        row = np.repeat(np.arange(k, to), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[k:to], n)
        d = distance(a[row], b[at])
        least = np.minimum.reduceat(d, np.cumsum(n) - n)
        kept = d <= np.repeat(least, n) + HIDDEN
        out.append((row[kept], ids[at[kept]], d[kept]))
        k = to
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, values: list[tuple[str, str]], level: tuple[str, str] | None = None, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """(left_id, match, distance): for each left row the right row of the same key with the least distance, rounded to
    ``digits``, ties by id; a null distance is the greatest.

    The distance is the sum of the absolute differences of ``values``, pairs of a left and a right column, and 1e7 times
    that of ``level``. Groups are cut into ``cells``, within which rows are sorted: pairs aren't enumerated.
    """
    pair = [*([level] if level else []), *values]
    side = lambda df, id, k: df.select(*on, F.col(id).alias("id"), *[F.col(p[k]).cast("double").alias(f"v{i}") for i, p in enumerate(pair)])
    a, b = cells(side(left, left_id, 0), side(right, right_id, 1), on, "id", "id", block)
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((left, left_id), (right, right_id))]
    out = pa.schema([(left_id, kinds[0]), ("match", kinds[1]), ("d", pa.float64())])
    keys = [*on, *CELL]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return out.empty_table()
        (xi, xv), (yi, yv) = ((t.column("id").to_numpy(), np.column_stack([t.column(f"v{i}").to_numpy() for i in range(len(pair))])) for t in (x, y))
        full, whole = ~np.isnan(xv).any(1), ~np.isnan(yv).any(1)
        none = np.ones(len(xi), bool) if not whole.any() else ~full
        parts = [(xi[none], np.full(none.sum(), yi.min()), np.full(none.sum(), np.nan))]
        xi, xv, yi, yv = xi[full], xv[full], yi[whole], yv[whole]
        if level is None and len(yi) and len(xi):
            r, m, d = _closest(xv, yv, yi)
            parts.append((xi[r], m, d))
        elif len(yi) and len(xi):
            levels = np.unique(yv[:, 0])
            places = {p: np.flatnonzero(yv[:, 0] == p) for p in levels}
            for own in np.unique(xv[:, 0]):
                mine = np.flatnonzero(xv[:, 0] == own)
                best = np.full(len(mine), np.inf)
                for p in levels[np.argsort(np.abs(levels - own), kind="stable")]:
                    more = abs(p - own) * 1e7
                    left_ = np.flatnonzero(best + HIDDEN >= more)
                    if not len(left_):
                        break
                    r, m, d = _closest(xv[mine[left_], 1:], yv[places[p], 1:], yi[places[p]], more)
                    np.minimum.at(best, left_[r], d)
                    parts.append((xi[mine[left_[r]]], m, d))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.Table.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), pa.array(cols[2], pa.float64(), from_pandas=True)], schema=out)

    schema = T.StructType([T.StructField(left_id, left.schema[left_id].dataType), T.StructField("match", right.schema[right_id].dataType), T.StructField("d", T.DoubleType())])
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)
    d = F.col("d") if digits is None else F.round("d", digits)
    best = F.min(F.struct(F.col("d").isNull(), d.alias("distance"), F.col("match")))
    return found.groupBy(left_id).agg(best.alias("m")).select(left_id, "m.match", "m.distance")


def match_labels(labels: DataFrame, detected: DataFrame, pixels: int = 3) -> DataFrame:
    """Labels with the detected table they belong to: by content md5 on the same page, else the nearest
    box of the same file within ``4 * pixels`` (page counts 1e7), unless the label is a good one."""
    keys = ["md5", "page", "file"]
    first = detected.groupBy(*keys).agg(F.min("id").alias("match_md5"))
    exact = labels.join(first, keys).groupBy("label_id").agg(F.min("match_md5").alias("match_md5"))
    near = nearest(labels, detected, ["file"], "label_id", "id", [(c, c) for c in ("x0", "y0", "x1", "y1")], ("page", "page"))
    out = labels.join(exact, "label_id", "left").join(near, "label_id", "left")
    close = F.col("match_md5").isNull() & (F.col("distance") <= 4 * pixels) & ~F.col("classification").isin("all_good", "all_good-")
    return out.withColumn("match_id", F.coalesce("match_md5", F.when(close, F.col("match"))))


def recode(c: Column, allowed: list[str], other: str = "unknown") -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(other))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1."""
    n = lambda c: F.count_if(c)
    c = df.agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(truth & ~guess).alias("fn"), n(~truth & ~guess).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    t = df.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("tp"))
    g = df.groupBy(F.col(guess).alias("class")).agg(F.count("*").alias("guessed"))
    out = t.join(g, "class", "full_outer").na.fill(0, ["support", "tp", "guessed"])
    out = out.withColumn("precision", F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def split(df: DataFrame, key: Column, share: float = 0.8, seed: int = 69) -> DataFrame:
    """``df`` with ``part``: train or test, by a hash of the key, so the split is the same everywhere."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(h < int(share * (1 << 32)), F.lit("train")).otherwise(F.lit("test")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows over (classes times rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return n.crossJoin(F.broadcast(t)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
