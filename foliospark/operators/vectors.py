"""Vectors: nearest neighbours, similarity graphs, PageRank, means, a hashing vectoriser."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..cells import CELL, cells
from ..runtime import BROADCAST_BYTES


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


#: More than single precision and rounding to 6 digits can move a cosine.
_SLACK = np.float32(3e-5)


def _nearest(qi: np.ndarray, qm: np.ndarray, di: np.ndarray, dm: np.ndarray, want: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the ``want`` nearest rows of ``dm`` for each row of ``qm``, all of unit length; ties by id.

    Single precision rules out, for ``block`` queries and four times as many rows at once, all that can't be among the
    nearest so far; distances of the rest are in double precision.
    """
    out: list = []
    n = min(want, len(di))
    d32 = dm.astype(np.float32)
    for lo in range(0, len(qi) if n else 0, block):
        q, q32 = qm[lo : lo + block], qm[lo : lo + block].astype(np.float32)
        bound = np.full(len(q), -np.inf, np.float32)
        r = np.zeros(0, np.int64)
        c, d = r, np.zeros(0)
        for at in range(0, len(di), 4 * block):
            s = q32 @ d32[at : at + 4 * block].T
            if s.shape[1] >= n:
                np.maximum(bound, np.partition(s[:, : 8 * n], -n, 1)[:, -n] - _SLACK, out=bound)
            if at == 0 and s.shape[1] >= n:
                np.maximum(bound, np.partition(s, -n, 1)[:, -n] - _SLACK, out=bound)
            hit = np.flatnonzero(s >= bound[:, None])
            if not len(hit):
                continue
            nr, nc = np.divmod(hit, s.shape[1])
            nc += at
            for k in range(0, len(nr), 1 << 16):
                x, y = nr[k : k + (1 << 16)], nc[k : k + (1 << 16)]
                r, c, d = np.concatenate([r, x]), np.concatenate([c, y]), np.concatenate([d, np.round(1 - np.einsum("ij,ij->i", q[x], dm[y]), 6)])
                order = np.lexsort((di[c], d, r))
                r, c, d = r[order], c[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                kept = place < n
                r, c, d, place = r[kept], c[kept], d[kept], place[kept]
                full = place == n - 1
                bound[r[full]] = np.maximum(bound[r[full]], (1 - d[full]).astype(np.float32) - _SLACK)
        out.append((qi[lo : lo + block][r], di[c], d))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (qi[:0], di[:0], np.zeros(0))


def knn(queries: DataFrame, data: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", group: str | None = None, drop_self: bool = False, block: int = 1024, limit: int = BROADCAST_BYTES // 2, sizes: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """(query, id, distance, rank): the k rows of least cosine distance, exact, ties by id.

    With a ``group`` only rows of the same group are compared. Queries and data are cut into slices of about ``limit``
    bytes; each pair of slices is a cell of one cogroup, multiplied in blocks of ``block`` queries, and only the k best
    of each cell go into the merge: nothing comes to the driver, and a task holds two slices whatever the size of the
    table. ``sizes``: a cheaper table with the groups of both sides, to count instead of them; ``width``: of the vectors,
    where it is known.
    """
    kind = data.schema[key].dataType
    want = k + 1 if drop_self else k
    on = [group] if group else ["_all"]
    side = lambda df: df.select(F.col(group) if group else F.lit(0).alias("_all"), key, vector)
    q, d = side(queries), side(data)
    if width is None:
        first = data.select(F.size(vector)).first()
        width = first[0] if first else 1
    most = max(1, limit // (8 * width + 8))
    if group is None:
        # a cell for each core and more, unless they would have less than 1024 rows
        n, cores = max(queries.count(), data.count()), data.sparkSession.sparkContext.defaultParallelism
        most = min(most, max(1024, -(-n // max(1, round((4 * cores) ** 0.5)))))
    ql, dl = cells(q, d, on, key, key, most, sizes and (sizes, sizes))
    keys = [*on, *CELL]
    if group is None:
        n = 2 * (-(-n // most)) ** 2
        ql, dl = ql.repartition(n, *keys), dl.repartition(n, *keys)
    out = pa.schema([("query", to_arrow_type(kind)), ("id", to_arrow_type(kind)), ("distance", pa.float64())])

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return t.column(key).to_numpy(), _unit(v.reshape(t.num_rows, -1)) if t.num_rows else np.zeros((0, 1))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = _nearest(*rows(a), *rows(b), want, block) if a.num_rows and b.num_rows else [[], [], []]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(got, out)], schema=out)

    both = ql.groupBy(*keys).cogroup(dl.groupBy(*keys)).applyInArrow(run, T.StructType([T.StructField("query", kind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())]))
    if drop_self:
        both = both.filter("query <> id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def similarity_graph(data: DataFrame, k: int = 4, max_distance: float = 0.2, **kw) -> DataFrame:
    """Edges (src, dst, weight) to the k nearest other rows within the distance; weight is 1 - d."""
    near = knn(data, data, k, drop_self=True, **kw).filter(F.col("distance") <= max_distance)
    return near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.round(1 - F.col("distance"), 6).alias("weight"))


def pagerank(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float = 0.85, rounds: int = 100, tol: float | None = 1e-6) -> np.ndarray:
    """Weighted PageRank of one graph by power iteration; dangling mass is spread evenly."""
    n = len(nodes)
    place = {x: k for k, x in enumerate(nodes.tolist())}
    s, d = np.array([place[x] for x in src.tolist()], int), np.array([place[x] for x in dst.tolist()], int)
    out = np.bincount(s, weight, minlength=n) if len(s) else np.zeros(n)
    share = weight / np.where(out[s] > 0, out[s], 1) if len(s) else weight
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = alpha * (np.bincount(d, x[s] * share, minlength=n) + x[out == 0].sum() / n) + (1 - alpha) / n
        done = tol is not None and np.abs(new - x).sum() < n * tol
        x = new
        if done:
            break
    return x


def pagerank_by(nodes: DataFrame, edges: DataFrame, group: str, key: str = "id", rounds: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(group, id, rank value) of many small graphs, each in one task."""
    g, kind = nodes.schema[group].dataType.simpleString(), nodes.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(key)
        v = pagerank(a[key].to_numpy(), b["src"].to_numpy(), b["dst"].to_numpy(), b["weight"].to_numpy(float), rounds=rounds, tol=tol)
        return pd.DataFrame({group: a[group].to_numpy(), key: a[key].to_numpy(), "value": v})

    return nodes.select(group, key).groupBy(group).cogroup(edges.select(group, "src", "dst", "weight").groupBy(group)).applyInPandas(run, f"{group} {g}, {key} {kind}, value double")


def top_keywords(ranked: DataFrame, label: str, group: str, k: int = 5) -> DataFrame:
    """The k best labels of each graph; equal labels are merged after the cut, in order."""
    w = Window.partitionBy(group).orderBy(F.desc("value"), "id")
    top = ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(group).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(label).alias("t")))), lambda x: x["t"])).alias("keywords"))


def mean_vectors(df: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise means of each group, as an array."""
    each = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def hashing_vectors(texts: list, size: int = 64) -> np.ndarray:
    """Unit vectors of signed hashed letter trigrams: the vectoriser where no model is plugged in."""
    import zlib

    out = np.zeros((len(texts), size))
    for r, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        for i in range(len(t) - 2):
            h = zlib.crc32(t[i : i + 3].encode())
            out[r, h % size] += 1 if h >> 31 else -1
    return _unit(out)


def vectorise(df: DataFrame, text: str, name: str = "vector", embed=hashing_vectors) -> DataFrame:
    """``df`` with a vector of each text by ``embed`` (list of texts -> matrix)."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            m = np.asarray(embed(b.column(at).to_pylist()), np.float32)
            width = m.shape[1] if m.ndim == 2 else 0
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, v], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))
