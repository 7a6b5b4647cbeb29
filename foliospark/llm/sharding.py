"""Sharding: a reproducible shuffle by Feistel permutation of global row numbers.

Rows are numbered in the order of a hash of doc_id (then doc_id, then a hash of the row), whatever
the layout of the input. A keyed Feistel network with cycle walking maps the number to a slot;
``shard = slot // shard_rows`` and ``place = slot % shard_rows``. Anyone with the key, the count of
rows and a row number can compute both, and the inverse order. The rows are sent to partitions by
shard and sorted by slot: each partition is one shard. That is the only time they are moved: the numbers are found from
hashes and places of the rows (``places``).

Defined results: a null doc_id counts as 0 in the hash and comes first, and so many of them as there may be are
spread over tasks; nulls, empty and very long texts elsewhere don't matter; repeated rows each get a slot of their own; an empty table gives no rows; a
column of the input named slot, shard or place (in any case) is kept as ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from .ordering import order_hash_sql, permute_sql, row_numbers, slot_of

KEY, SHARD_ROWS = 20240607, 8192


def shard(docs: DataFrame, key: int = KEY, shard_rows: int = SHARD_ROWS, **kw) -> DataFrame:
    """``docs`` with shard, place and slot, one partition for each shard, sorted by slot."""
    docs = settle(docs, ["doc_id"], ["slot", "shard", "place", "__n", "__f", "__r", "_metadata"])
    out, n = row_numbers(docs, "doc_id", "__n", **kw)
    out = out.withColumn("slot", slot_of(F.col("__n"), n, key)).drop("__n")
    out = out.withColumns({"shard": F.floor(F.col("slot") / shard_rows).cast("int"), "place": (F.col("slot") % shard_rows).cast("int")})
    return out.repartitionById(max(1, -(-n // shard_rows)), F.col("shard")).sortWithinPartitions("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


SQL = f"""WITH RECURSIVE numbered AS (
      SELECT *, row_number() OVER (ORDER BY {order_hash_sql("doc_id")}, doc_id NULLS FIRST) - 1 AS x, count(*) OVER () AS n FROM documents),
    {permute_sql("numbered", KEY)}
    SELECT doc_id, text, lang, source, n_chars, slot, (slot // {SHARD_ROWS})::INT AS shard, (slot % {SHARD_ROWS})::INT AS place
    FROM numbered JOIN slots USING (x)"""
