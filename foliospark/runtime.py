"""Session helpers: shared folder, written tables, size-checked joins, column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows times the given width stay under this.
BROADCAST_BYTES = 64 << 20


def session(name: str = "foliospark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds or overrides settings."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local, else an
    error, as executors on other machines couldn't read it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        sc.setCheckpointDir(found)
    return found


_written: list[str] = []
#: Shuffle files go as the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    Unlike ``checkpoint()`` this runs the plan once, and its shuffle files are removed once the table is there.
    ``release`` deletes the table.
    """
    path, conf = kept_path(df.sparkSession, name, uuid.uuid4().hex), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, name: str, suffix: str) -> str:
    """A new folder in the shared one, that ``release`` deletes."""
    path = f"{shared_dir(spark)}/foliospark/{name}-{suffix}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what was written to ``kept_path``; DataFrames built on it can't be read after."""
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


#: Sizes of fixed-width values in a broadcast hash table's rows, beside what each row takes itself.
ROW_BYTES = 64


def small(df: DataFrame, width: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, of ``width`` bytes and ``ROW_BYTES`` each, stay under the
    limit, else unchanged.

    Without the hint Spark picks a shuffled join, which holds at any size.
    """
    return F.broadcast(df) if df.count() * (width + ROW_BYTES) <= (BROADCAST_BYTES if limit is None else limit) else df


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """``df`` over all cores if it has fewer than ``least`` bytes for each of them: such a table may be a single row
    group, that one task would read. Larger ones stay as they are; the rows are the same in any case."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    return df.repartition(cores) if size < cores * least else df


def settle(df: DataFrame, own: Iterable[str], new: Iterable[str] = ()) -> DataFrame:
    """Make names unambiguous: columns in ``own`` keep their name; any other column whose name
    collides (in any case) with ``own``, ``new`` or an earlier column gets ``_in`` appended."""
    own, taken, names = list(own), set(), []
    reserved = {c.lower() for c in [*own, *new]}
    for c in df.columns:
        if c in own and c.lower() not in taken:
            name = c
        else:
            name = c
            while name.lower() in reserved or name.lower() in taken:
                name += "_in"
        taken.add(name.lower())
        names.append(name)
    return df if names == df.columns else df.toDF(*names)
