import pytest
from pyspark.sql import functions as F

from foliospark.bag import Bag
from foliospark.plans.documents import DOCUMENTS
from foliospark.registry import ConfigurationError, Pipelines, alias, configuration, constant, node


def make(spark, rows, **kw):
    df = spark.createDataFrame(rows, "source string, fobj string, document_type string, meta map<string,string>")
    return Bag(df, DOCUMENTS, **kw)


def test_merge_order_and_aliases(spark):
    p = Pipelines({"*": [node("x", lambda of: F.lit("any")), *alias(y="x"), *constant(c=3)], "p": [node("x", lambda of: F.lit("parent"))], "q": [node("x", lambda of: F.lit("q")), node("z", lambda of: F.lit("z"))], "t": [node("z", lambda of: F.lit("own"))]}, {"t": ("p", "q")})
    df = spark.createDataFrame([("t",), ("other",), ("q",)], "document_type string")
    rows = df.select("document_type", *p.plan(df, ["x", "y", "z", "c"])).collect()
    assert [tuple(r) for r in rows] == [("t", "parent", "parent", "own", 3), ("other", "any", "any", None, 3), ("q", "q", "q", "z", 3)]


def test_configuration_precedence_and_errors(spark):
    p = Pipelines({"*": [*configuration(k=1), node("v", lambda of: of("k") + 1)]})
    df = spark.createDataFrame([("a",)], "document_type string")
    assert df.select(*p.plan(df, ["v"])).first()[0] == 2
    assert df.select(*p.with_config(k=5).plan(df, ["v"])).first()[0] == 6
    with pytest.raises(ConfigurationError):
        p.with_config(nothing=1)
    with pytest.raises(ConfigurationError):
        p.plan(df, ["missing"])
    with pytest.raises(ConfigurationError):
        Pipelines({})
    with pytest.raises(ConfigurationError):
        Pipelines({"*": [node("a", lambda of: of("b")), node("b", lambda of: of("a"))]}).column("a", "*")
    derived = p.extend({"*": [node("v", lambda of: F.lit(9))]})
    assert df.select(*derived.plan(df, ["v"])).first()[0] == 9


def test_every_node_of_every_type_runs(spark):
    html = "<!DOCTYPE html><html><head><title>T - x</title></head><body><article><p>Hello World. You</p></article><ul><li>one</li><li><a href='x'>link</a></li></ul></body></html>"
    rows = [("a", "Plain text here.\n\nAlan Turing was.", "text/plain", {"k": "v"}), ("b", html, "text/html", None), ("c", '{"a": "1", "b": {"c": 2}}', "<class 'dict'>", {}), ("d", '["x y", "z"]', "<class 'list'>", {}), ("e", "# Title\n\ntext *b*", "text/markdown", {}), ("f", None, "text/plain", None)]
    bag = make(spark, rows)
    names = sorted({n for t in DOCUMENTS.types() for n in DOCUMENTS.nodes(t)})
    out = {r.source: r for r in bag.with_properties(*[n for n in names if n not in ("source", "meta")]).collect()}
    assert out["a"].keywords == ["Plain", "Alan", "Turing"] and out["a"].num_words == 6 and len(out["a"].elements) == 2
    assert out["b"].title == "T - x" and out["b"].short_title == "T" and out["b"].full_text == "Hello World. You"
    assert out["c"].keys == ["a", "b"] and out["c"].flat == {"a": "1", "b.c": "2"}
    assert out["d"].full_text == "x y\n\nz" and out["e"].clean_text == "Title\n\ntext b" and out["f"].full_text is None


def test_bag_algebra(spark):
    bag = make(spark, [("a", "one two\n\nthree", "text/plain", {"k": "v"}), ("b", "four", "text/plain", {})])
    assert [tuple(r) for r in bag.get_dicts("source", n="num_words").orderBy("source").collect()] == [("a", 3), ("b", 1)]
    new = bag.apply("text_segments", {"words": "num_words"})
    rows = new.exploded.df.orderBy("source").collect()
    assert [(r.source, r.fobj, r.meta["words"], r.meta["pos"]) for r in rows] == [("a", "one two\n\nthree", "3", "0"), ("b", "four", "1", "0")]
    parts = bag.apply(F.split("fobj", "\n\n")).e
    assert parts.df.count() == 3 and parts.e.df.count() == 3
    assert bag.filter(F.length("fobj") > 5).df.count() == 1 and bag.take(1).count() == 1
    assert bag.stats("num_words").first().asDict() == {"documents": 2, "num_words": 4}
    assert Bag(bag.df, DOCUMENTS, max_documents=1).df.count() == 1
    assert bag.to_json("num_words").first().json == '{"num_words":3}'
    forgiving = Bag(bag.df, DOCUMENTS, forgiving=True).get_dicts("title")
    assert [r._error for r in forgiving.collect()] == [True, True]


def test_catalogue_and_dot(spark):
    rows = DOCUMENTS.catalogue(spark)
    assert rows.filter("document_type = 'image/png' and node = 'num_pages'").count() == 1
    assert '"full_text" -> "num_words"' not in DOCUMENTS.dot("*") and '"clean_text" -> "num_words"' in DOCUMENTS.dot("*")


def test_parameterised_properties(spark):
    bag = make(spark, [("a", "The tower stands near Paris today.", "text/plain", {}), ("b", "Solar Panel and Solar Panels.", "text/plain", {})])
    assert {r.source: len(r.answers) for r in bag.answers(["Where is the tower?"]).collect()} == {"a": 1, "b": 1}
    rows = bag.chat_answers("Count.", lambda p: str(len(p)), "full_text", "num_words").collect()
    assert {r.source for r in rows} == {"a", "b"} and all(r.answer.isdigit() for r in rows)
    assert bag.page_classifier(["solar", "tower"]).filter("source = 'b'").first().scores["solar"] == 1.0
    near = bag.nearest(spark.createDataFrame([("q", "solar panels")], "query string, text string"), k=1).first()
    assert near.source == "b" and near.rank == 1
    assert bag.nearest(spark.createDataFrame([("q", "solar")], "query string, text string"), "spacy_noun_chunks", 2).count() == 2
    assert {r.source for r in bag.similarity_graph(max_distance=0.9).collect()} == {"b"}
