"""Answers for the rows of files: values computed from narrow columns go back to wide rows without a join.

A row of a Parquet table is named by its file and its index there, whatever the splits of a scan. Narrow
columns are shuffled, ranked or summed; the answers are written to the shared folder, in one
folder for each million rows of a file, and the next scan of the wide rows looks them up. Texts aren't moved, nothing
is broadcast, and a repeated task finds the same answers.

Other inputs than files are written first.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import kept_path, save_table, small

FOLDER, ROW, FOLDER_ROWS_BITS = "__f", "__r", 20


def located(df: DataFrame) -> DataFrame:
    """``df`` with the folder of its answers (``FOLDER``) and its index (``ROW``), the same in each scan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation"):
        try:
            return _named(df)
        except AnalysisException:  # a source without row indexes
            pass
    return _named(save_table(df, "located"))


def _named(df: DataFrame) -> DataFrame:
    file = df.metadataColumn("_metadata")
    row = file.getField("row_index")
    out = df.select("*", F.xxhash64(file.getField("file_path"), F.shiftright(row, FOLDER_ROWS_BITS)).alias(FOLDER), row.alias(ROW))
    out.schema  # noqa: B018  resolves the names
    return out


def write(df: DataFrame, value: str) -> str:
    """Write the answers (``FOLDER``, ``ROW``, value: long); their path."""
    path = kept_path(df.sparkSession, "answers", uuid.uuid4().hex)
    df.select(FOLDER, ROW, F.col(value).alias("v")).repartition(FOLDER).sortWithinPartitions(FOLDER, ROW).write.partitionBy(FOLDER).parquet(path)
    return path


@lru_cache(4)
def _folder(path: str, folder: int) -> tuple[np.ndarray, np.ndarray]:
    store, root = fs.FileSystem.from_uri(path)
    files = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{FOLDER}={folder}", allow_not_found=True)) if f.path.endswith(".parquet")]
    got = [pq.read_table(f.path, columns=[ROW, "v"], filesystem=store, partitioning=None) for f in files]
    table = pa.concat_tables(got) if got else pa.table({ROW: pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    row, value = table.column(ROW).to_numpy(), table.column("v").to_numpy()
    order = np.argsort(row, kind="stable")
    row = row[order]
    if len(row) and (row[1:] == row[:-1]).any():
        raise ValueError("two files share a folder of answers")
    return row, value[order]


def lookup(path: str, folder: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The answers of some rows; a row without one is an error."""
    out = np.zeros(len(row), np.int64)
    for f in np.unique(folder).tolist():
        own = np.flatnonzero(folder == f)
        known, value = _folder(path, f)
        at = np.searchsorted(known, row[own])
        if (at >= len(known)).any() or (known[at] != row[own]).any():
            raise ValueError("a row has no answer: the input has changed since")
        out[own] = value[at]
    return out


def answer(path: str) -> Column:
    """``lookup`` as a column; only the two narrow columns go to Python."""

    @F.pandas_udf("long")
    def found(folder: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(lookup(path, folder.to_numpy(), row.to_numpy()))

    return found(F.col(FOLDER), F.col(ROW))


RANGE_ROWS = 1 << 20


def running(rows: DataFrame, order: list, weight: str, group: str | None = None, limit: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(FOLDER, ROW, group, weight, __c): the sum of ``weight`` over the rows before each one, in its group, in the
    order of (group, ``order``, place).

    ``rows`` are range-partitioned and sorted, equal keys too as their places differ, so no group or key is ever in one
    task as a whole. Sums within the ranges are written; then the totals of the ranges, a row
    for each group and range, are summed up and added.
    """
    rows = save_table(rows.withColumn("__g", F.col(group) if group else F.lit("")), "narrow")
    n = rows.count()
    keys = ["__g", *order, FOLDER, ROW]

    def sums(batches):
        last, total, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            g, w = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            c = np.cumsum(w) - w
            c -= np.repeat(c[start], np.diff(np.append(start, len(c))))
            if g[0] == last:
                c[: start[1] if len(start) > 1 else len(c)] += total
            last, total = g[-1], int(c[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.full(len(c), part, np.int32)), pa.array(c)], names=[FOLDER, ROW, "__g", "__w", "__p", "__s"])

    sort = rows.repartitionByRange(1 + n // range_rows, *keys).sortWithinPartitions(*keys).select(FOLDER, ROW, "__g", F.col(weight).cast("long").alias("__w"))
    part = save_table(sort.mapInArrow(sums, f"{FOLDER} long, {ROW} long, __g string, __w long, __p int, __s long"), "sums")
    each = part.groupBy("__g", "__p").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__g", "__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    return part.join(small(each, 64, limit), ["__g", "__p"]).select(FOLDER, ROW, F.col("__g").alias(group or "__g"), F.col("__w").alias(weight), (F.col("__s") + F.col("__o")).alias("__c"))
