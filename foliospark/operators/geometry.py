"""Bounding boxes (x0, y0, x1, y1; origin at the lower left): predicates, pair distances, clustering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def inside(box: tuple[float, float, float, float], tol: float = 10, exclude: bool = False) -> Column:
    """Strictly within a box widened by ``tol``, or not."""
    x0, y0, x1, y1 = box
    hit = (F.col("x0") > x0 - tol) & (F.col("y0") > y0 - tol) & (F.col("x1") < x1 + tol) & (F.col("y1") < y1 + tol)
    return ~hit if exclude else hit


def intersects(box: tuple[float, float, float, float], tol: float = 1) -> Column:
    x0, y0, x1, y1 = box
    return (F.col("x0") < x1 + tol) & (F.col("x1") > x0 - tol) & (F.col("y0") < y1 + tol) & (F.col("y1") > y0 - tol)


def contained(a: str = "a", b: str = "b", tol: float = 0) -> Column:
    """Join condition: box a strictly within box b widened by ``tol``."""
    return (_c(a, "x0") > _c(b, "x0") - tol) & (_c(a, "y0") > _c(b, "y0") - tol) & (_c(a, "x1") < _c(b, "x1") + tol) & (_c(a, "y1") < _c(b, "y1") + tol)


def width(s: str = "a") -> Column:
    return _c(s, "x1") - _c(s, "x0")


def height(s: str = "a") -> Column:
    return _c(s, "y1") - _c(s, "y0")


def area(s: str = "a") -> Column:
    return width(s) * height(s)


def extent(axis: int) -> Column:
    """Length of the joint box along an axis."""
    p = "xy"[axis]
    return F.greatest(_c("a", p + "1"), _c("b", p + "1")) - F.least(_c("a", p + "0"), _c("b", p + "0"))


def gap(axis: int) -> Column:
    """Distance along an axis; negative where the boxes overlap on it."""
    one = width if axis == 0 else height
    return extent(axis) - one("a") - one("b")


def area_distance(allow_negative: bool = False) -> Column:
    d = extent(0) * extent(1) - area("a") - area("b")
    return d if allow_negative else F.greatest(d, F.lit(0.0))


def size_similarity() -> Column:
    return F.least(area("a"), area("b")) / F.greatest(area("a"), area("b"))


def overlap_distance() -> Column:
    """Overlap area over the sum of areas, negative where the boxes overlap."""
    sign = F.when((gap(0) < 0) & (gap(1) < 0), F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * gap(0) * gap(1) / (area("a") + area("b"))


def alignment(axis: int, relative: bool = False) -> Column:
    """Joint extent on the other axis less the longer edge (over the longer edge)."""
    other = 1 - axis
    one = width if other == 0 else height
    longest = F.greatest(one("a"), one("b"))
    d = extent(other) - longest
    return d / longest if relative else d


def text_distance(min_alignment: float, max_gap: float) -> Column:
    return F.greatest(F.greatest(alignment(0), F.lit(0.0)) / min_alignment, F.greatest(gap(0), F.lit(0.0)) / max_gap)


def edge_similarity() -> Column:
    """Over both axes the greater of the least distances of edges."""

    def one(p: str) -> Column:
        return F.least(*[F.abs(_c("a", p + i) - _c("b", p + j)) for i in "01" for j in "01"])

    return F.greatest(one("x"), one("y"))


def edge_alignments() -> dict[str, Column]:
    mid = lambda s, p: (_c(s, p + "0") + _c(s, p + "1")) / 2
    return {
        "left": F.abs(_c("a", "x0") - _c("b", "x0")), "center": F.abs(mid("a", "x") - mid("b", "x")), "right": F.abs(_c("a", "x1") - _c("b", "x1")),
        "bottom": F.abs(_c("a", "y0") - _c("b", "y0")), "middle": F.abs(mid("a", "y") - mid("b", "y")), "top": F.abs(_c("a", "y1") - _c("b", "y1")),
    }


def joint_inside(eps: float = 1e-6) -> Column:
    """Box a lies within box b: their joint area is b's."""
    return extent(0) * extent(1) < area("b") + eps


def manhattan() -> Column:
    return sum((F.abs(_c("a", p) - _c("b", p)) for p in BOX[1:]), F.abs(_c("a", "x0") - _c("b", "x0")))


def euclidean() -> Column:
    return F.sqrt(sum((F.pow(_c("a", p) - _c("b", p), 2) for p in BOX[1:]), F.pow(_c("a", "x0") - _c("b", "x0"), 2)))


def pairs(boxes: DataFrame, group: list[str], key: str = "id") -> DataFrame:
    """All pairs a.id < b.id within a group: an equi join with a residual test, so no group meets another."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col(f"a.{key}") < F.col(f"b.{key}")]
    return a.join(b, on)


def cluster_1d(df: DataFrame, value: str, tol: float = 5, group: list[str] | None = None) -> DataFrame:
    """Distinct values with the number of their cluster: a new one begins after a gap above ``tol``."""
    group = group or []
    w = Window.partitionBy(*group).orderBy(value)
    d = df.select(*group, value).distinct()
    d = d.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > tol).cast("int"), F.lit(0)))
    return d.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def merge_boxes(df: DataFrame, by: list[str]) -> DataFrame:
    """Union box and count of each label; rows without a label are left out."""
    keep = df.filter(F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda x: x))
    return keep.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def components_within(boxes: DataFrame, group: list[str], distance: Column, threshold: float, key: str = "id") -> DataFrame:
    """(group, id, cluster): single linkage, i.e. the connected components of distance < threshold.

    Pairs come from a join within the group; the union-find runs over one group's edges at a time."""
    edges = pairs(boxes, group, key).filter(distance < threshold).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col(f"a.{key}").alias("u"), F.col(f"b.{key}").alias("v"))
    loops = boxes.select(*group, F.col(key).alias("u"), F.col(key).alias("v"))
    schema = ", ".join(f"{g} {boxes.schema[g].dataType.simpleString()}" for g in group) + f", {key} {boxes.schema[key].dataType.simpleString()}, cluster {boxes.schema[key].dataType.simpleString()}"

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v in zip(rows["u"].tolist(), rows["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        out = pd.DataFrame({key: list(root)})
        out["cluster"] = [find(x) for x in out[key]]
        for g in reversed(group):
            out.insert(0, g, rows[g].iloc[0])
        return out

    return edges.unionByName(loops).groupBy(*group).applyInPandas(unite, schema)
