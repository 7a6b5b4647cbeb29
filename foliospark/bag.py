"""Collections of documents: map, filter, project, apply, explode, take, statistics.

A bag is a DataFrame with ``source``, ``fobj`` (text), ``document_type`` and ``meta``; its properties are
the nodes of a registry. In forgiving mode a failing expression gives null and an ``_error`` column
tells which rows had one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import models, vectors
from .registry import Pipelines


class Bag:
    def __init__(self, df: DataFrame, pipelines: Pipelines, forgiving: bool = False, max_documents: int | None = None):
        self.df = df if max_documents is None else df.limit(max_documents)
        self.pipelines, self.forgiving = pipelines, forgiving

    @classmethod
    def of(cls, df: DataFrame, pipelines: Pipelines, fobj: Column | str, source: Column | str, document_type: Column | None = None, meta: Column | None = None, **kw: Any) -> Bag:
        """A bag over any table; types default to text/plain."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        empty = F.create_map().cast("map<string,string>")
        return cls(df.select(col(source).cast("string").alias("source"), col(fobj).alias("fobj"), (F.lit("text/plain") if document_type is None else document_type).alias("document_type"), (empty if meta is None else meta).alias("meta")), pipelines, **kw)

    @classmethod
    def of_rows(cls, df: DataFrame, pipelines: Pipelines, index: str, **kw: Any) -> Bag:
        """Each row of a table as a document: its columns as JSON, its index as source."""
        return cls.of(df, pipelines, F.to_json(F.struct("*")), index, F.lit("<class 'dict'>"), **kw)

    def _with(self, df: DataFrame) -> Bag:
        return Bag(df, self.pipelines, self.forgiving)

    def _columns(self, names: tuple[str, ...], kw: dict[str, str]) -> list[Column]:
        wanted = [*names, *kw.values()]
        cols = dict(zip(wanted, self.pipelines.plan(self.df, wanted)))
        return [cols[n].alias(n) for n in names] + [cols[v].alias(k) for k, v in kw.items()]

    def get_dicts(self, *names: str, **renamed: str) -> DataFrame:
        """Properties as columns; ``new='property'`` renames."""
        out = self.df.select(*self._columns(names, renamed))
        return out.withColumn("_error", F.forall(F.array(*[F.col(c).isNull() for c in out.columns]), lambda x: x)) if self.forgiving else out

    d = get_dicts

    def with_properties(self, *names: str, **renamed: str) -> DataFrame:
        return self.df.select("*", *self._columns(names, renamed))

    def map(self, expr: str | Column | Callable[[DataFrame], DataFrame], name: str = "result") -> DataFrame:
        """A property, a column, or a function of the whole DataFrame."""
        if callable(expr) and not isinstance(expr, Column):
            return expr(self.df)
        return self.get_dicts(expr) if isinstance(expr, str) else self.df.select(expr.alias(name))

    bag_apply = map

    def filter(self, condition: str | Column) -> Bag:
        """Documents for which a property or column is true."""
        cond = self._columns((condition,), {})[0] if isinstance(condition, str) and condition not in self.df.columns else condition
        return self._with(self.df.filter(cond))

    def apply(self, new_document: str | Column, meta: dict[str, str | Column] | None = None, document_type: Column | None = None) -> Bag:
        """New documents from a property; source stays, ``meta`` collects other properties."""
        col = lambda c: self._columns((c,), {})[0] if isinstance(c, str) else c
        pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), col(v).cast("string"))]
        fobj = col(new_document)
        kind = document_type if document_type is not None else F.lit("text/plain")
        return self._with(self.df.select("source", fobj.alias("fobj"), kind.alias("document_type"), (F.create_map(*pairs) if pairs else F.col("meta")).alias("meta")))

    @property
    def exploded(self) -> Bag:
        """One string document for each item of list documents, the others unchanged; one level."""
        kind = self.df.schema["fobj"].dataType
        if not isinstance(kind, T.ArrayType):
            return self
        df = self.df.select("source", F.posexplode("fobj").alias("pos", "fobj"), "document_type", "meta")
        return self._with(df.select("source", F.col("fobj").cast("string") if not isinstance(kind.elementType, T.StringType) else F.col("fobj"), "document_type", F.map_concat("meta", F.create_map(F.lit("pos"), F.col("pos").cast("string"))).alias("meta")))

    e = exploded

    def take(self, n: int) -> DataFrame:
        return self.df.limit(n)

    def compute(self) -> list:
        return self.df.collect()

    def stats(self, *numeric: str) -> DataFrame:
        """Sums of numeric properties over all documents, with the count."""
        return self.get_dicts(*numeric).agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in numeric])

    def to_json(self, *names: str) -> DataFrame:
        return self.df.select("source", F.to_json(F.struct(*self._columns(names, {}))).alias("json"))

    # parameterised properties: what would be a function of a document is a method of the bag

    def answers(self, questions: list[str], prop: str = "full_text", **kw: Any) -> DataFrame:
        """(source, answers): for each question (answer, score) pairs, best first."""
        return models.answers(self.get_dicts("source", text=prop), questions, **kw).select("source", "answers")

    def chat_answers(self, tasks: str | list[str], client: Callable[[str], str], *props: str, **kw: Any) -> DataFrame:
        """(source, task, prompt, key, answer) over properties as JSON (a single one as it is)."""
        props = props or ("full_text",)
        df = self.get_dicts("source", *props)
        data = F.col(props[0]) if len(props) == 1 else F.to_json(F.struct(*props))
        return models.chat(df, tasks, data, client, **kw).drop(*props)

    def page_classifier(self, labels: list[str], **kw: Any) -> DataFrame:
        """(source, page, scores) for each page template and label."""
        pages = self.get_dicts("source", "page_templates").select("source", F.explode("page_templates").alias("page", "text"))
        return pages.select("source", "page", models.zero_shot("text", labels, **kw).alias("scores"))

    def item_vectors(self, items: str = "text_segments", embed: Callable = vectors.hashing_vectors) -> DataFrame:
        """(source, pos, id, item, vector) of the segments (or sentences, noun chunks, tokens) of each document."""
        rows = self.get_dicts("source", t=items).select("source", F.posexplode("t").alias("pos", "item"))
        rows = rows.withColumn("id", F.concat("source", F.lit(":"), F.lpad(F.col("pos").cast("string"), 9, "0")))
        return vectors.vectorise(rows, "item", embed=embed)

    def nearest(self, queries: DataFrame, items: str = "text_segments", k: int = 5, embed: Callable = vectors.hashing_vectors) -> DataFrame:
        """(query, source, pos, item, distance, rank): the k nearest items of the whole bag for rows (query, text)."""
        rows = self.item_vectors(items, embed)
        q = vectors.vectorise(queries.select(F.col("query").cast("string").alias("id"), "text"), "text", embed=embed)
        near = vectors.knn(q, rows.select("id", "vector"), k)
        return near.join(rows.select("id", "source", "pos", "item"), "id").select("query", "source", "pos", "item", "distance", "rank")

    def similarity_graph(self, items: str = "spacy_noun_chunks", k: int = 4, max_distance: float = 0.2, embed: Callable = vectors.hashing_vectors) -> DataFrame:
        """(source, src, dst, weight) between the items of each document."""
        e = vectors.similarity_graph(self.item_vectors(items, embed).select("source", "id", "vector"), k, max_distance, group="source")
        return e.select(F.regexp_extract("src", "^(.*):", 1).alias("source"), "src", "dst", "weight")
