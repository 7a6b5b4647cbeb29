"""Tables from page elements: candidate areas, cells, grids, metrics, validity.

A page is one group: its lines and graphics go through one Arrow call, so pages run in parallel and
nothing but pages is ever collected.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Constants of table detection."""

    min_area: float = 2500.0
    min_aspect: float = 1 / 50
    max_aspect: float = 50.0
    page_margin: float = 20.0
    area_ratio: float = 0.4
    min_length: float = 10.0
    threshold: float = 10.0
    cell_tol: float = 7.0
    max_rows: int = 1000


CELLS = "array<struct<row:int,col:int,text:string>>"
CANDIDATE = f"x0 double, y0 double, x1 double, y1 double, n_lines int, n_graphics int, rows int, cols int, cells {CELLS}, empty int, spans int, words_area double"


def useful_graphics(elements: DataFrame, p: Params = Params()) -> DataFrame:
    """Graphics that can be rules of a table: slender or small against the page, long enough, inside the margin."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page = elements.groupBy("doc_id", "p_num").agg(F.max("x1").alias("_px"), F.max("y1").alias("_py"))
    g = elements.filter("type = 'Graphic'").join(page, ["doc_id", "p_num"])
    keep = (w * h / (F.col("_px") * F.col("_py")) < p.area_ratio) & (F.greatest(w, h) >= p.min_length) & (F.col("x0") >= -p.page_margin) & (F.col("y0") >= -p.page_margin) & (F.col("x1") <= F.col("_px") + p.page_margin) & (F.col("y1") <= F.col("_py") + p.page_margin)
    return g.filter(keep).drop("_px", "_py")


def single_linkage(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster of each box: components of Chebyshev box gap below the threshold."""
    n = len(boxes)
    label = np.arange(n)
    if n > 1:
        gx = np.maximum(boxes[:, None, 0], boxes[None, :, 0]) - np.minimum(boxes[:, None, 2], boxes[None, :, 2])
        gy = np.maximum(boxes[:, None, 1], boxes[None, :, 1]) - np.minimum(boxes[:, None, 3], boxes[None, :, 3])
        near = np.maximum(np.maximum(gx, gy), 0) < threshold
        while True:
            new = np.where(near, label[None, :], n).min(1)
            new = np.minimum(new, label)
            if (new == label).all():
                break
            label = new
    return label


def islands(values: np.ndarray, tol: float) -> np.ndarray:
    """Means of the 1-D clusters of values."""
    v = np.unique(values)
    if not len(v):
        return v
    cut = np.concatenate(([0], np.cumsum(np.diff(v) > tol)))
    return np.bincount(cut, v) / np.bincount(cut)


def grid(rules: np.ndarray, texts: list[tuple[float, float, float, float, str]], tol: float) -> dict:
    """Cells of a ruled table: grid lines from the rules' borders, a text in the cell that holds its
    center, reading order inside a cell."""
    xs, ys = islands(rules[:, [0, 2]].ravel(), tol), islands(rules[:, [1, 3]].ravel(), tol)[::-1]
    cells: dict[tuple[int, int], list] = {}
    for x0, y0, x1, y1, t in texts:
        c = int(np.searchsorted(xs, (x0 + x1) / 2)) - 1
        r = int(np.searchsorted(-ys, -(y0 + y1) / 2)) - 1
        if 0 <= c < len(xs) - 1 and 0 <= r < len(ys) - 1:
            cells.setdefault((r, c), []).append((x0 - 40 * y0, t))
    rows, cols = max(len(ys) - 1, 0), max(len(xs) - 1, 0)
    return {"rows": rows, "cols": cols, "cells": [(r, c, " ".join(t for _, t in sorted(v))) for (r, c), v in sorted(cells.items())], "empty": rows * cols - len(cells)}


def text_grid(texts: list[tuple[float, float, float, float, str]]) -> dict:
    """Cells of a table without rules: columns and rows are merged overlapping intervals."""

    def merge(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[list[float]] = []
        for a, b in sorted(pairs):
            if out and a < out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    cols, rows = merge([(t[0], t[2]) for t in texts]), merge([(t[1], t[3]) for t in texts])[::-1]
    cells: dict[tuple[int, int], list] = {}
    for x0, y0, x1, y1, t in texts:
        c = next(k for k, (a, b) in enumerate(cols) if a <= x0 and x1 <= b)
        r = next(k for k, (a, b) in enumerate(rows) if a <= y0 and y1 <= b)
        cells.setdefault((r, c), []).append((x0 - 40 * y0, t))
    return {"rows": len(rows), "cols": len(cols), "cells": [(r, c, " ".join(t for _, t in sorted(v))) for (r, c), v in sorted(cells.items())], "empty": len(rows) * len(cols) - len(cells)}


def candidates(elements: DataFrame, p: Params = Params()) -> DataFrame:
    """Table candidates of each page: (doc_id, p_num, area, counts, cells).

    Graphics are clustered twice (rules into blocks, blocks into areas); areas of fitting size and
    shape that hold text become tables over the grid of their rules."""
    useful = useful_graphics(elements, p)
    lines = elements.filter("type = 'Text'")
    cols = ["doc_id", "p_num", "type", "x0", "y0", "x1", "y1", "text"]
    both = useful.select(*cols).unionByName(lines.select(*cols))

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows[rows["type"] == "Graphic"][["x0", "y0", "x1", "y1"]].to_numpy(float)
        t = rows[rows["type"] == "Text"].sort_values(["y0", "x0"], ascending=[False, True])
        out = []
        level = single_linkage(g, p.threshold) if len(g) else np.zeros(0, int)
        for k in np.unique(level):
            r = g[level == k]
            x0, y0, x1, y1 = r[:, 0].min(), r[:, 1].min(), r[:, 2].max(), r[:, 3].max()
            w, h = x1 - x0, y1 - y0
            if w * h < p.min_area or not w or not p.min_aspect <= h / w <= p.max_aspect:
                continue
            inside = t[(t["x0"] > x0 - 1) & (t["y0"] > y0 - 1) & (t["x1"] < x1 + 1) & (t["y1"] < y1 + 1)]
            if not len(inside):
                continue
            words = list(inside[["x0", "y0", "x1", "y1", "text"]].itertuples(index=False, name=None))
            got = grid(r, words, p.cell_tol)
            if got["rows"] < 1 or got["cols"] < 1 or got["rows"] > p.max_rows:
                got = text_grid(words)
            area = sum((b - a) * (d - c) for a, c, b, d, _ in words)
            out.append((x0, y0, x1, y1, len(inside), len(r), got["rows"], got["cols"], [{"row": a, "col": b, "text": c} for a, b, c in got["cells"]], got["empty"], 0, area))
        res = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "n_lines", "n_graphics", "rows", "cols", "cells", "empty", "spans", "words_area"])
        res.insert(0, "p_num", rows["p_num"].iloc[0])
        res.insert(0, "doc_id", rows["doc_id"].iloc[0])
        return res.sort_values(["y1", "x0"], ascending=[False, True])

    return both.groupBy("doc_id", "p_num").applyInPandas(page, f"doc_id long, p_num int, {CANDIDATE}")


def is_valid(v_lines: Column, cells: Column, spans: Column, words_area: Column, height: Column) -> Column:
    """The two-threshold decision rule for tables."""
    return (v_lines / cells + spans / cells <= 1.2667) & (words_area / height - height / cells > 11.4749)


def metrics(c: DataFrame) -> DataFrame:
    """Candidates with size figures, content md5 and validity."""
    n = F.col("rows") * F.col("cols")
    digest = F.md5(F.regexp_replace(F.array_join(F.transform("cells", lambda x: x["text"]), "|"), r"\s+", " "))
    h = F.col("y1") - F.col("y0")
    return c.withColumns({"n_cells": n, "fill": F.try_divide(n - F.col("empty"), n), "width": F.col("x1") - F.col("x0"), "height": h, "md5": digest, "valid": is_valid(F.lit(0.0), n.cast("double"), F.col("spans").cast("double"), F.col("words_area"), h)})


def as_rows(c: DataFrame) -> DataFrame:
    """One row for each table row, with its cells as an array by column; missing cells are ''."""
    cells = c.select("doc_id", "p_num", "x0", "y0", "cols", F.explode("cells").alias("cell"))
    by = cells.groupBy("doc_id", "p_num", "x0", "y0", "cols", F.col("cell.row").alias("row")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("cell.col", "cell.text")))).alias("m"))
    return by.select("doc_id", "p_num", "x0", "y0", "row", F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("cells"))


def table_md5(rows: list[list[str]]) -> str:
    """md5 of a table's values with white space normalised."""
    return hashlib.md5("|".join(re.sub(r"\s+", " ", x) for r in rows for x in r).encode()).hexdigest()
