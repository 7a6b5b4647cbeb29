"""Mixing sources to target weights: a time-varying curriculum.

The target share of a source at time t is its weight over the sum of all weights; the default
weight of a source with S tokens is S^a(t), with a(t) going from ``start`` to ``end``: early
training leans to small sources, the end follows the data. The schedule is a step function of
``steps`` steps. Its integral times the budget of tokens is the source's cumulative demand D(t).
A source's documents follow one another in the order of a seeded hash; a document whose source has
given c tokens before it is due when the demand reaches c, so its position is D^-1(c), in tokens of
the whole mix. A source with more demand than tokens starts again (next epoch).

By default the budget is the least one at which each source's demand covers its tokens: every
document is used at least once. With ``total_tokens`` a source may have too much; what isn't due
within the budget is left out. Documents are range-partitioned by position and sorted; that is the only time
they are moved, as the tokens before each one are found from hashes and places of the rows (``places``), over many
tasks for a source of any size.

Tokens are runs of characters other than blank, tab and line break; a document without any counts
as one token. Defined results: null sources form a source of their own; null and empty texts count
as one token; very long texts count whole; a null doc_id hashes as 0 and comes first; equal hashes are ordered by doc_id, then by
a hash of the row; repeated rows each get their place; an empty table gives no rows; other
columns stay, and one named position, epoch or n_tokens is kept as ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import save_table, settle, small
from . import places
from .ordering import order_hash, order_hash_sql

SEED, STEPS, START, END, PART_TOKENS = 11, 100, 0.7, 1.0, 4_000_000
_NONE = "\x00none"
_WORK = ["position", "epoch", "n_tokens", "__s", "__h", "__c", "__supply", "__due", "__d", "__x", "__k", "__p", "__f", "__r", "__key", "_metadata"]


def default_weight(steps: int = STEPS, start: float = START, end: float = END):
    """Column of the weight at step ``__k`` of a source with ``__supply`` tokens."""
    return F.pow(F.col("__supply").cast("double"), F.lit(start) + (F.lit(end) - F.lit(start)) * (F.col("__k") + 0.5) / steps)


def mix(docs: DataFrame, weight=None, total_tokens: int | None = None, steps: int = STEPS, seed: int = SEED, part_tokens: int = PART_TOKENS, limit: int | None = None, **kw) -> DataFrame:
    """``docs`` with n_tokens, epoch and position, sorted by position."""
    docs = places.located(settle(docs, ["doc_id", "text", "source"], _WORK))
    tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0))).cast("long")
    named = F.coalesce("source", F.lit(_NONE)).alias("__s")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (places.FOLDER, places.ROW)]
    narrow = docs.select(places.FOLDER, places.ROW, named, order_hash(F.col("doc_id"), seed).alias("__h"), F.col("doc_id").alias("__key"), F.xxhash64(*own).alias("__x"), tokens.alias("n_tokens"))
    run = places.running(narrow, ["__h", F.col("__key").asc_nulls_first(), "__x"], "n_tokens", "__s", limit, **kw)
    path = places.write(run, "__c")
    each = save_table(run.groupBy("__s").agg(F.sum("n_tokens").alias("__supply")), "supply")
    steps_ = each.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("w", weight if weight is not None else default_weight(steps))
    steps_ = steps_.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("__k")) / steps)
    shares = steps_.groupBy("__s", "__supply").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "share"))), lambda x: x["share"]).alias("share"), F.sum("share").alias("all"))
    if total_tokens is None:
        total_tokens = shares.agg(F.max(F.col("__supply") / F.col("all"))).first()[0] or 0
    total = float(total_tokens)
    due = shares.select("__s", "__supply", F.aggregate("share", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x * total))).alias("__d"))
    due = due.withColumn("__due", F.round(F.element_at("__d", -1)).cast("long"))
    out = docs.withColumns({"n_tokens": tokens, "__s": named, "__c": places.answer(path)}).drop(places.FOLDER, places.ROW)
    out = out.join(small(due, 16 * steps, limit), "__s")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("__due") / F.col("__supply")).cast("int") - 1))))
    out = out.withColumn("__x", F.col("epoch").cast("long") * F.col("__supply") + F.col("__c")).filter("__x < __due")
    out = out.withColumn("__k", F.least(F.size(F.filter("__d", lambda d: d <= F.col("__x"))), F.lit(steps)))
    low, high = F.element_at("__d", F.col("__k")), F.element_at("__d", F.col("__k") + 1)
    out = out.withColumn("position", (F.col("__k") - 1 + F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("__x") - low, high - low)), F.lit(0.0))) * F.lit(total / steps))
    ranges = 1 + int(total // part_tokens)
    out = out.withColumn("__p", F.least(F.lit(ranges - 1), F.floor(F.col("position") / F.lit(max(total, 1.0)) * ranges).cast("int")))
    out = out.repartitionById(ranges, F.col("__p")).sortWithinPartitions("position", "__s", "doc_id")
    return out.select(*own, "n_tokens", "epoch", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order: doc_id, source, n_tokens, epoch, position (tokens, to 3 digits)."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "n_tokens", "epoch", F.round("position", 3).alias("position"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, repeated by epoch; the columns of ``docs``."""
    out = mix(docs)
    return out.select(out.columns[: len(docs.columns)]).toDF(*docs.columns)


SQL = f"""WITH toks AS (SELECT doc_id, coalesce(source, chr(1) || 'none') AS s, source, greatest(1, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0))::BIGINT AS n_tokens, {order_hash_sql("doc_id", SEED)} AS h FROM documents),
    runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - n_tokens AS c, sum(n_tokens) OVER (PARTITION BY s) AS supply FROM toks),
    steps AS (SELECT s, supply, k, pow(supply::DOUBLE, {START} + ({END} - {START}) * (k + 0.5) / {STEPS}) AS w FROM (SELECT DISTINCT s, supply FROM runs), range({STEPS}) t(k)),
    shares AS (SELECT s, supply, k, w / sum(w) OVER (PARTITION BY k) / {STEPS} AS share FROM steps),
    budget AS (SELECT max(supply / a) AS total FROM (SELECT supply, sum(share) AS a FROM shares GROUP BY s, supply)),
    grid AS (SELECT s, k, share * total AS width, total, sum(share * total) OVER (PARTITION BY s ORDER BY k) - share * total AS lo, sum(share * total) OVER (PARTITION BY s) AS whole FROM shares, budget),
    due AS (SELECT s, round(any_value(whole))::BIGINT AS due FROM grid GROUP BY s),
    copies AS (SELECT r.*, e AS epoch, e * supply + c AS x FROM runs r JOIN due USING (s), LATERAL (SELECT unnest(range(greatest(1, ceil(due / supply)::BIGINT))) AS e) WHERE e * supply + c < due)
    SELECT doc_id, source, n_tokens, epoch::INT AS epoch, round((k + least(1.0, (x - lo) / width)) * total / {STEPS}, 3) AS position
    FROM copies c ASOF JOIN grid g ON c.s = g.s AND c.x >= g.lo"""
