"""Files, database tables and vector tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, web


def paths(spark: SparkSession, root: str, wildcard: str = "*", max_depth: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder, without their content.

    Depth counts the parts of the path below the root; a path with any of ``exclude`` in it is left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wildcard).load(root).select("path", "length", "modificationTime")
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.split_part(F.col("path"), base, F.lit(-1))
    df = df.filter(F.size(F.filter(F.split(rel, "/"), lambda p: p != "")) <= max_depth)
    for x in exclude:
        df = df.filter(~F.col("path").contains(x))
    return df


def decode(content: Column) -> Column:
    """Bytes as UTF-8; invalid ones are replaced."""
    return F.make_valid_utf8(content.cast("string"))


def documents(spark: SparkSession, root: str, **kw) -> DataFrame:
    """(source, raw, fobj, document_type) of files: type by name, then by magic bytes, then by content."""
    keep = paths(spark, root, **kw).select("path")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").join(keep, "path", "left_semi")
    body = decode(F.col("content"))
    kind = F.coalesce(web.type_by_name(F.col("path")), web.type_by_magic(F.col("content")), web.type_of_text(body, text.contains_markdown(body)))
    return raw.select(F.col("path").alias("source"), F.col("content").alias("raw"), body.alias("fobj"), kind.alias("document_type"))


def pages_of(df: DataFrame, page_numbers: list[int] | None = None, max_pages: int | None = None, column: str = "p_num") -> DataFrame:
    """Element rows of some pages; the filters reach the scan."""
    if page_numbers is not None:
        df = df.filter(F.col(column).isin(page_numbers))
    return df if max_pages is None else df.filter(F.col(column) < max_pages)


def database(spark: SparkSession, url: str, table: str | None = None, sql: str | None = None, index: str | None = None, bounds: tuple | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table, or the rows of an SQL text; with an index and its bounds read in parallel ranges."""
    if (table is None) == (sql is None):
        raise ValueError("either a table or an SQL text")
    r = spark.read.format("jdbc").options(url=url, **options).option("dbtable", table if table else f"({sql}) q")
    if index and bounds:
        r = r.options(partitionColumn=index, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return r.load()


def write_vectors(df: DataFrame, path: str, id: str, embedding: str, document: str, metadata: str | None = None) -> None:
    """Vector sink: (id, embedding, document, metadata) as Parquet."""
    meta = F.create_map().cast("map<string,string>") if metadata is None else F.col(metadata)
    df.select(F.col(id).alias("id"), F.col(embedding).alias("embedding"), F.col(document).alias("document"), meta.alias("metadata")).write.mode("overwrite").parquet(path)


def query_vectors(spark: SparkSession, path: str, queries: DataFrame, n_results: int = 5) -> DataFrame:
    """The nearest stored rows for (id, vector) queries, with their documents."""
    from ..operators.vectors import knn

    stored = spark.read.parquet(path)
    near = knn(queries, stored.select("id", F.col("embedding").alias("vector")), n_results)
    return near.join(stored.select("id", "document", "metadata"), "id")


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
