"""Small tables with every awkward case."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = "ba ke li mo nu pra sto vi zen dor fal gim".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def prose(r, n):
    return " ".join(word(r) + r.choice(["", "", ",", "."]) for _ in range(n))


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS)


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    long = prose(r, 6000)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, long, "en", "a", 1), (None, prose(r, 80), "en", "b", 1), (3, "x", "en", None, 1), (3, "x", "en", None, 1), (4, "Ünïcode ß — “quotes” ½", "de", "b", 3), (5, prose(r, 60), None, "a", None)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("Text", "SLOT", "shard", "score", "position", "epoch", "h", "rep", "bands", "component", "__b", "keep", *extra):
        df = df.select("*", F.lit("clash").alias(name))
    return df


def bare(df):
    """The five columns of documents of ``awkward``, by position."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select("c0", "c1", "c2", "c3", "c4").toDF(*DOCS.names)


def empty(spark):
    return spark.createDataFrame([], DOCS)
