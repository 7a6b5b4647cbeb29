import difflib  # noqa: F401
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import structs, text, web
from foliospark.operators import components, elements, geometry, knowledge, models, synth, tables, vectors
from foliospark.plans import relational
from foliospark.schema import ELEMENT
from foliospark.sources import files, markup
from foliospark.streaming import streams


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


def pieces(full, lo=256, hi=512, overlap=0.3, most=100):
    out, now = [], ""
    for part in full.split("\n\n"):
        if len(now) < lo:
            now += part + "\n\n"
        else:
            now += part
            out += [now[i : i + hi].strip() for i in range(0, len(now), int((1 - overlap) * hi))] if len(now) > hi else [now.strip()]
            now = ""
            if len(out) > most:
                break
    return out + ([now.strip()] if now.strip() else [])


@pytest.mark.parametrize("seed", range(4))
def test_segments(spark, seed):
    r = random.Random(seed)
    full = "\n\n".join("x" * r.choice([0, 3, 90, 300, 900]) + " y" for _ in range(r.choice([1, 5, 400])))
    assert one(spark, full, text.segments) == pieces(full)


def test_element_has_26_fields():
    assert len(ELEMENT) == 26


@pytest.mark.parametrize("line,yes", [("- item", True), ("• item", True), ("-20 °C", False), ("  * x", True), ("-20 apples", True), ("text", False)])
def test_list_lines(spark, line, yes):
    assert one(spark, line, text.is_list_line) is yes


@pytest.mark.parametrize("body,kind", [("<!DOCTYPE html><p>", "text/html"), ("<?xml version='1'?><a/>", "application/xml"), ('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" x>', "mediawiki"), ("{\\rtf1 x}", "text/rtf"), ("# T\n\n- a\n\n[l](u) `c`", "text/markdown"), ("plain", "text/plain"), ("<html><p>no doctype", "application/xml"), (None, "UNKNOWN")])
def test_types(spark, body, kind):
    assert one(spark, body, lambda c: web.type_of_text(c, text.contains_markdown(c))) == kind


def test_urls(spark):
    u = "https://x.example.com/a//b/Doc.PDF?q=1"
    assert one(spark, u, web.pdf_file_name).endswith(".pdf") and one(spark, "https://x/y.html", web.pdf_file_name) is None
    assert one(spark, "http://x//a//b", web.collapse_slashes) == "http://x/a/b"
    assert one(spark, u, lambda c: web.absolute_path(c, F.lit("p"))) == "https://x.example.com/p?q=1"
    assert one(spark, "no url", web.is_url) is False and one(spark, u, web.is_url) is True


def test_page_parser():
    p = web.parse_page('<html lang="de-DE"><head><title>A | B</title><meta name="keywords" content="x, y,x"><script type="application/ld+json">{"b":1,"a":2}</script></head><body><ul><li>one</li><li> <a href="d.PDF">only link</a></li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table><article>Main <b>text</b></article><script>bad</script></body></html>')
    assert (p["title"], p["short_title"], p["lang"], p["keywords"], p["pdf_links"], p["lists"], p["tables"], p["main_content"], p["schema"]) == ("A | B", "A", "de", ["x", "y"], ["d.PDF"], [["one"]], [[["h"], ["1"]]], "Main text", ['{"a": 2, "b": 1}'])
    assert web.parse_page(None)["title"] == "" and web.parse_page("<p")["urls"] == []


def test_structs(spark):
    assert structs.flat_items({"a": {"b": 1, "c": {}}, "d": [1]}) == {"a.b": 1, "d": [1]}
    assert structs.normal({"a": b"x", "s": {2, 1}, "n": 1.5}) == {"a": "x", "s": [1, 2], "n": 1.5}
    df = spark.createDataFrame([([["a", None], None, [" ", "b", "a"]],)], "x array<array<string>>")
    assert df.select(structs.flatten_unique(F.col("x"))).first()[0] == ["a", "b"]
    m = spark.createDataFrame([({"a": ["1"]}, {"a": ["2"], "b": ["3"]})], "x map<string,array<string>>, y map<string,array<string>>")
    assert m.select(structs.merge_lists(F.col("x"), F.col("y"))).first()[0] == {"a": ["1", "2"], "b": ["3"]}
    assert 0 <= one(spark, "abc", structs.unit_float) < 1


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(None, 3), (k := 100, 101), (101, 102), (102, k)]
    edges += [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {(x.node, x.component) for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [1 << 26, 2000])
def test_knn(spark, limit):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    rows = vectors.knn(df, df, 3, drop_self=True, limit=limit, block=7).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 6)
    for q in range(60):
        want = sorted((d[q, k], k) for k in range(60) if k != q)[:3]
        assert [(x.distance, x.id) for x in sorted((x for x in rows if x.query == q), key=lambda x: x.rank)] == [(pytest.approx(a), k) for a, k in want]


def test_pagerank_and_vectors():
    x = vectors.pagerank(np.arange(3), np.array([0, 1]), np.array([1, 2]), np.array([1.0, 1.0]))
    assert x.sum() == pytest.approx(1) and x[2] > x[1] > x[0]
    a = vectors.hashing_vectors(["solar panel", "solar panels", "xyz"])
    assert a[0] @ a[1] > 0.7 > abs(a[0] @ a[2])


def test_geometry(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 5.0, 5.0, 20.0, 20.0), (3, 0, 100.0, 0.0, 110.0, 10.0)], "id long, p_num long, x0 double, y0 double, x1 double, y1 double")
    rows = {(r.a, r.b): r for r in geometry.pairs(df, ["p_num"]).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), geometry.gap(0).alias("g"), geometry.overlap_distance().alias("o"), geometry.area_distance().alias("d")).collect()}
    assert rows[1, 2].g == -5 and rows[1, 2].o == pytest.approx(-25 / 325) and rows[1, 3].g == 90 and rows[1, 2].d == 75
    c = geometry.components_within(df, ["p_num"], F.greatest(geometry.gap(0), geometry.gap(1)), 1.0).collect()
    assert {(r.id, r.cluster) for r in c} == {(1, 1), (2, 1), (3, 3)}


def test_page_template_labels(spark):
    rows = [(0, 1, "TextBox", "one", 5.0, 1.0, ["address"]), (0, 2, "Table", "t", 9.0, 1.0, ["unknown"]), (0, 3, "TextBox", "x", 1.0, 1.0, None), (0, 4, "Image", None, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "p_num int, id int, type string, text string, y0 double, x0 double, labels array<string>").withColumn("mean_char_orientation", F.lit(0.0))
    assert elements.page_template(df, ("Table", "Image")).first().template == "{Table_2}\n\none\n\n{Image_4}"
    assert elements.page_template(df, ("Image",), include=True, labels=True).first().template == "{Table_2}\n\n{TextBox_1:address}\n\n{Image_4}"


def test_tables():
    assert tables.islands(np.array([1.0, 2, 50, 51, 52]), 7).tolist() == [1.5, 51.0]
    g = tables.text_grid([(0, 10, 20, 20, "a"), (30, 10, 50, 20, "b"), (0, 0, 20, 8, "c")])
    assert (g["rows"], g["cols"], g["cells"], g["empty"]) == (2, 2, [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], 1)
    assert tables.table_md5([["a  b"], ["c"]]) == tables.table_md5([["a b"], ["c"]])


def test_markdown_blocks():
    b = markup.blocks("# H\n\npara one\ntwo\n\n- a\n- b\n  more\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```\ncode # x\n```\n## S\nend")
    assert [(x["type"], x["section"]) for x in b] == [("Header", "H"), ("Text", "H"), ("List", "H"), ("Table", "H"), ("Text", "H"), ("Header", "S"), ("Text", "S")]
    assert b[3]["cells"] == [["x", "y"], ["1", "2"]] and b[2]["text"] == "a\nb more" and markup.blocks(None) == []


def test_relations(spark):
    df = spark.createDataFrame([(1, "Ada builds engines. The engine is a machine of brass.")], "doc_id long, text string")
    tok = knowledge.token_rows(knowledge.annotate(df))
    words = {r.i: r.text for r in tok.collect()}
    got = {(words[r.n1], words[r.n2], r.type, r.label) for r in knowledge.relations(tok).collect()}
    assert {("Ada", "engines", "SVO", "builds"), ("engine", "machine", "Attribute", "is"), ("is", "brass", "Prepositional", "related")} <= got
    v, e = knowledge.document_graph(tok, knowledge.relations(tok))
    assert v.count() == 1 + len({x for r in knowledge.relations(tok).collect() for x in (r.n1, r.n2)}) and e.filter("label = 'is parent'").count() == v.count() - 1
    assert knowledge.dot([("a", "k", "l")], [("a", "b", "r")]).startswith("digraph")


def test_models():
    assert models.guess_language("the cat is in the house and it was") == "en" and models.guess_language("") == "unknown"
    assert models.guess_block("Max Muster\nMain Street 5\n12345 Berlin") == "address" and models.guess_block("hello") == "unknown"
    got = models.extract_answers("Where is the tower?", "The tower stands near Paris today")
    assert got and all(len(a.split()) <= 5 for a, _ in got) and models.extract_answers("x", None) == []


def test_chat_asks_each_prompt_once_and_reads_the_cache(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    first = models.chat(df, "T", F.col("text"), lambda p: "new")
    cache = first.filter("id = 3").select("key", F.lit("old").alias("answer"))
    rows = {r.id: r.answer for r in models.chat(df, ["T"], F.col("text"), lambda p: "new", cache).collect()}
    assert rows == {1: "new", 2: "new", 3: "old"}


def test_generators_do_not_depend_on_partitions(spark):
    a = synth.generate(spark, 40, 7).collect()
    b = synth.generate(spark, 40, 7).repartition(3).orderBy("id").collect()
    assert sorted(a) == b and {r.kind for r in a} <= set(synth.KINDS)
    chunks = one(spark, "z" * 333, synth.random_chunks)
    assert "".join(chunks) == "z" * 333 and all(20 <= len(c) <= 80 for c in chunks[:-1])


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {(r.k, r.v) for r in relational.keep_last(df, ["k"], [F.col("t")]).collect()} == {("a", "y"), ("b", "z")}
    r = relational.report(df.withColumn("g", F.lit("x")), "v", "g").filter("class = 'x'").first()
    assert (r.precision, r.recall) == (pytest.approx(1 / 3), 1.0)
    n = relational.split(spark.range(2000), F.col("id")).filter("part = 'train'").count()
    assert abs(n - 1600) < 80


def test_files_and_vectors(spark, tmp_path):
    (tmp_path / "in" / "sub" / "deep").mkdir(parents=True)
    for p, b in (("a.md", b"# T"), ("sub/b.bin", b"%PDF-1.4"), ("sub/deep/c.txt", b"caf\xe9"), ("sub/skip.txt", b"x")):
        (tmp_path / "in" / p).write_bytes(b)
    rows = {r.source.rsplit("/", 1)[1]: r for r in files.documents(spark, f"{tmp_path}/in", exclude=("skip",)).collect()}
    assert {k: r.document_type for k, r in rows.items()} == {"a.md": "text/markdown", "b.bin": "application/pdf", "c.txt": "text/plain"}
    assert rows["c.txt"].fobj.startswith("caf")
    assert files.paths(spark, f"{tmp_path}/in", "*.txt", max_depth=2).count() == 1
    with pytest.raises(ValueError):
        files.database(spark, "jdbc:x")
    df = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 1.0], "two")], "k long, v array<double>, t string")
    files.write_vectors(df, f"{tmp_path}/store", "k", "v", "t")
    q = spark.createDataFrame([(9, [0.9, 0.1])], "id long, vector array<double>")
    assert files.query_vectors(spark, f"{tmp_path}/store", q, 1).first().document == "one"


def test_streams(spark, sf, tmp_path):
    s = streams.table_stream(spark, f"{sf}/events.parquet")
    streams.run_once(streams.windowed_counts(s, "ts", ["event_type"], "1 hour"), f"{tmp_path}/w")
    streams.run_once(streams.session_counts(s, "ts", ["user_id"]), f"{tmp_path}/s")
    streams.run_once(streams.deduplicated(s, "ts", ["event_id"]), f"{tmp_path}/d")
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < spark.read.parquet(f"{tmp_path}/w").agg(F.sum("n")).first()[0] <= n
    assert spark.read.parquet(f"{tmp_path}/d").count() == n
