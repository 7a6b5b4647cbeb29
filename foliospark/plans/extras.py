"""Queries of the registry, bags, parsers, tables, knowledge, models, generators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bag import Bag
from ..functions import structs, text
from ..operators import elements, knowledge, models, synth, tables, vectors
from ..runtime import save_table, shared_dir
from ..sources import files, markup
from ..streaming import streams
from . import relational
from .catalog import RATIO, WORDS, boxes, paragraphs, query, r6
from .documents import DOCUMENTS


def bag(t) -> Bag:
    return Bag.of(t("documents"), DOCUMENTS, "text", "doc_id", meta=F.create_map(F.lit("lang"), F.col("lang")))


@query(f"SELECT doc_id::VARCHAR AS source, 1 + length(text) // 1000 AS num_pages, {WORDS} AS words, round({RATIO}, 6) AS a_d_ratio FROM documents")
def bag_get_dicts(t):
    return bag(t).get_dicts("source", "num_pages", "a_d_ratio", words="num_words").withColumn("a_d_ratio", r6(F.col("a_d_ratio")))


@query("SELECT count(*) AS documents, sum(1 + length(text) // 1000)::BIGINT AS num_pages, sum(" + WORDS + ")::BIGINT AS num_words FROM documents")
def bag_column_stats(t):
    return bag(t).stats("num_pages", "num_words")


@query("""SELECT source, pos, fobj, lang FROM (SELECT doc_id::VARCHAR AS source, (i - 1)::VARCHAR AS pos, s AS fobj, lang FROM (SELECT doc_id, lang, unnest(p) AS s, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, lang, string_split(replace(text, e'\\n', e'\\n\\n'), e'\\n\\n') AS p FROM documents))) WHERE length(fobj) > 1000""")
def bag_apply_explode(t):
    b = Bag.of(paragraphs(t).join(t("documents").select("doc_id", "lang"), "doc_id"), DOCUMENTS, "body", "doc_id", meta=F.create_map(F.lit("lang"), F.col("lang")))
    e = b.apply(F.split("fobj", "\n\n")).exploded.filter(F.length("fobj") > 1000)
    return e.df.select("source", F.col("meta")["pos"].alias("pos"), "fobj", F.col("meta")["lang"].alias("lang"))


@query("SELECT n_nationkey::VARCHAR AS source, ['n_nationkey', 'n_name', 'n_regionkey'] AS keys, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR] AS values, '<class ''dict''>' AS document_type FROM nation")
def row_documents(t):
    return Bag.of_rows(t("nation"), DOCUMENTS, "n_nationkey").get_dicts("source", "keys", "values", "document_type")


@query()
def node_catalogue(t):
    return DOCUMENTS.catalogue(t("nation").sparkSession)


@query("SELECT doc_id::VARCHAR AS source, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS num_words, [0] AS page_set, 'md' AS spacy_model_size FROM documents")
def document_nodes(t):
    return bag(t).get_dicts("source", "num_words", "page_set", "spacy_model_size")


@query()
def markdown_blocks(t):
    d = t("documents").select("doc_id", F.concat(F.lit("# "), "lang", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n- "))).alias("text"))
    return markup.markdown(d).select("doc_id", F.inline("blocks")).select("doc_id", "boxnum", "type", "level", "section", "text")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def yaml_round_trip(t):
    y = markup.yaml_data(markup.to_yaml(t("nation"), ["n_nationkey", "n_name", "n_regionkey"]), "yaml")
    return y.select(F.from_json("data", "n_nationkey int, n_name string, n_regionkey int").alias("x")).select("x.*")


@query("SELECT event_id, map_from_entries([('event_type', event_type), ('props.k', json_extract_string(props, '$.k'))])::VARCHAR AS flat FROM events")
def flatten_dict(t):
    j = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"none":{}}'))
    m = t("events").select("event_id", structs.flatten_json(j).alias("m"))
    return m.select("event_id", F.concat(F.lit("{event_type="), F.col("m")["event_type"], F.lit(", props.k="), F.col("m")["props.k"], F.lit("}")).alias("flat"))


# ---- tables: each part page of catalog.boxes becomes a ruled 4 x 10 table with the part names as cells


def table_elements(t) -> DataFrame:
    k = F.col("p_partkey")
    pos = (k % 40).cast("int")
    row, col = F.floor(pos / 4).cast("int"), pos % 4
    base = t("part").select(k.alias("id"), F.floor(k / 40).cast("int").alias("p_num"), row.alias("r"), col.alias("c"), F.col("p_name").alias("text"))
    d = lambda c: c.cast("double")
    cell = base.select(F.lit(0).cast("long").alias("doc_id"), "p_num", F.lit("Text").alias("type"), d(F.col("c") * 100 + 60).alias("x0"), d(700 - F.col("r") * 30 - 22).alias("y0"), d(F.col("c") * 100 + 140).alias("x1"), d(700 - F.col("r") * 30 - 8).alias("y1"), "text")
    rule = base.select(F.lit(0).cast("long"), "p_num", F.lit("Graphic"), d(F.col("c") * 100 + 50), d(700 - F.col("r") * 30 - 30), d(F.col("c") * 100 + 150), d(700 - F.col("r") * 30), F.lit(None).cast("string"))
    page = base.select("p_num").distinct().select(F.lit(0).cast("long"), "p_num", F.lit("Image"), F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(800.0), F.lit(None).cast("string"))
    return cell.unionAll(rule).unionAll(page)


@query("SELECT p_num, row, list(p_name ORDER BY p_partkey) AS cells FROM (SELECT (p_partkey // 40)::INT AS p_num, ((p_partkey % 40) // 4)::INT AS row, p_partkey, p_name, count(*) OVER (PARTITION BY p_partkey // 40) AS n FROM part) WHERE n = 40 GROUP BY p_num, row")
def table_extraction(t):
    c = tables.candidates(table_elements(t))
    return tables.as_rows(c.filter("rows = 10 and cols = 4")).select("p_num", "row", "cells")


@query("SELECT p_num, 10 AS rows, 4 AS cols, 40 AS n_cells, 1.0::DOUBLE AS fill, md5(string_agg(p_name, '|' ORDER BY p_partkey)) AS md5 FROM (SELECT *, (p_partkey // 40)::INT AS p_num FROM part) GROUP BY p_num HAVING count(*) = 40")
def table_metrics(t):
    m = tables.metrics(tables.candidates(table_elements(t)))
    return m.filter("n_cells = 40").select("p_num", "rows", "cols", "n_cells", "fill", "md5")


# ---- label matching


@query("""WITH d AS (SELECT p_partkey AS id, p_brand AS file, p_size AS page, md5(p_name) AS md5, (p_partkey * 7 % 400)::DOUBLE AS x0, (p_partkey * 11 % 300)::DOUBLE AS y0 FROM part),
  l AS (SELECT id AS label_id, file, page, CASE WHEN id % 3 = 0 THEN md5 ELSE 'none' END AS md5, x0 + id % 5 AS x0, y0, CASE id % 4 WHEN 0 THEN 'all_good' ELSE 'table' END AS classification FROM d),
  e AS (SELECT label_id, min(id) AS match_md5 FROM l JOIN d USING (md5, page, file) GROUP BY 1),
  n AS (SELECT label_id, min({'distance': abs(l.x0 - d.x0) * 2 + abs(l.y0 - d.y0) * 2 + abs(l.page - d.page) * 1e7, 'match': d.id}) AS m FROM l JOIN d USING (file) GROUP BY 1)
  SELECT label_id, match_md5, m.match AS match, m.distance AS distance, coalesce(match_md5, CASE WHEN m.distance <= 12 AND classification NOT IN ('all_good', 'all_good-') THEN m.match END) AS match_id FROM l LEFT JOIN e USING (label_id) LEFT JOIN n USING (label_id)""")
def label_matching(t):
    k = F.col("p_partkey")
    d = t("part").select(k.alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("page"), F.md5("p_name").alias("md5"), (k * 7 % 400).cast("double").alias("x0"), (k * 11 % 300).cast("double").alias("y0"))
    d = d.withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    i = F.col("id")
    lab = d.select(i.alias("label_id"), "file", "page", F.when(i % 3 == 0, F.col("md5")).otherwise("none").alias("md5"), (F.col("x0") + i % 5).alias("x0"), "y0", (F.col("x1") + i % 5).alias("x1"), "y1", F.when(i % 4 == 0, "all_good").otherwise("table").alias("classification"))
    return relational.match_labels(lab, d).select("label_id", "match_md5", "match", "distance", "match_id")


# ---- knowledge, models, generators


def tokens(t) -> DataFrame:
    """Tokens of whole conversations: each turn is annotated by itself, then positions and sentences run on
    through the turns in order."""
    c = knowledge.annotate(t("conversations").select("conv_id", "turn", "text"), "text")
    before = lambda x: F.coalesce(F.sum(x).over(Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    c = c.select("conv_id", "tokens", before(F.size("tokens")).alias("at"), before(F.coalesce(F.array_max("tokens.sent") + 1, F.lit(0))).alias("sents"))
    shift = lambda x: x.withField("i", x["i"] + F.col("at")).withField("head", x["head"] + F.col("at")).withField("sent", x["sent"] + F.col("sents"))
    return knowledge.token_rows(c.withColumn("tokens", F.transform("tokens", shift)), "conv_id")


@query()
def semantic_relations(t):
    return knowledge.relations(save_table(tokens(t), "tokens"), "conv_id")


@query()
def noun_chunks(t):
    return knowledge.noun_chunks(tokens(t), "conv_id")


@query()
def entities_by_label(t):
    e = knowledge.entities(tokens(t), "conv_id")
    return e.select("conv_id", F.map_keys("entities").alias("labels"), F.transform(F.map_values("entities"), lambda x: F.size(x)).alias("counts"))


def conversation_graph(t) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges; every turn is annotated once, and relations are joined once."""
    tok = save_table(tokens(t), "tokens")
    return knowledge.document_graph(tok, save_table(knowledge.relations(tok, "conv_id"), "relations"), key="conv_id")


@query()
def document_graph_edges(t):
    return conversation_graph(t)[1]


@query()
def document_graph_vertices(t):
    return conversation_graph(t)[0]


@query("SELECT doc_id, lang, CASE WHEN lang IN ('en', 'zh') THEN lang || '_core_web_md' ELSE lang || '_core_news_md' END AS model FROM documents")
def language_model_id(t):
    return t("documents").select("doc_id", "lang", knowledge.model_id(F.col("lang")).alias("model"))


@query()
def language_detect(t):
    return t("documents").select("doc_id", "lang", models.language("text").alias("detected"))


@query()
def zero_shot_scores(t):
    return t("documents").select("doc_id", models.zero_shot("text", ["the", "der", "que"]).alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in ("the", "der", "que")])


@query()
def question_answers(t):
    d = t("conversations").select("conv_id", "turn", "text")
    return models.answers(d, ["what is the?", "Wo ist der?"]).select("conv_id", "turn", F.transform("answers", lambda a: F.size(a)).alias("found"))


@query("SELECT conv_id, turn, task, sha256('{}' || task || '{}' || text || '{}') AS key, upper(task) AS answer FROM conversations, (VALUES ('Summarise.'), ('Translate.')) v(task)".format(*models.PROMPT))
def chat_tasks(t):
    c = models.chat(t("conversations").select("conv_id", "turn", "text"), ["Summarise.", "Translate."], F.col("text"), lambda p: p.split("## Prompt:\n\n")[1].split("\n")[0].upper())
    return c.select("conv_id", "turn", "task", "key", "answer")


@query()
def summaries(t):
    return t("documents").select("doc_id", text.extractive_summary(F.col("text")).alias("summary"))


@query()
def block_labels(t):
    e = paragraphs(t).select("doc_id", F.inline(text.elements(F.col("body"))))
    return models.label_blocks(e).select("doc_id", "boxnum", "labels")


@query()
def block_classifier(t):
    d = t("documents").select("doc_id", "lang", *[c.alias(k) for k, c in text.block_features(F.col("text")).items()])
    w = relational.class_weights(d, "lang").select("lang", "weight")
    d = d.join(F.broadcast(w), "lang")
    return models.train_block_classifier(d, ["newlines", "spaces", "digits", "size"], "lang", "weight").transform(d).select("doc_id", "lang", "prediction")


@query()
def synthetic_blocks(t):
    return synth.generate(t("nation").sparkSession, 500, seed=3)


@query("SELECT doc_id, text AS joined FROM documents")
def random_chunks(t):
    return t("documents").select("doc_id", F.array_join(synth.random_chunks(F.col("text")), "").alias("joined"))


@query()
def title_lines(t):
    lines = boxes(t).select("p_num", "id", "text", (F.lit(10) + F.when(F.col("id") % 40 == 0, 14).otherwise(F.col("id") % 2)).cast("double").alias("font_size"))
    return elements.titles(lines, ["p_num"]).select("p_num", "id", "text", "kind")


@query()
def keywords_textrank(t):
    c = save_table(knowledge.noun_chunks(tokens(t), "conv_id").select("conv_id", (F.shiftleft("conv_id", 32) + F.col("start")).alias("id"), "chunk"), "chunks")
    v = vectors.vectorise(c, "chunk")
    e = vectors.similarity_graph(v.select("conv_id", "id", "vector"), 4, 0.2, group="conv_id", sizes=c, width=64).withColumn("conv_id", F.shiftright("src", 32))
    return vectors.top_keywords(vectors.pagerank_by(c, e, "conv_id").join(c.select("id", "chunk"), "id"), "chunk", "conv_id")


@query()
def segment_vectors(t):
    s = paragraphs(t).select("doc_id", F.posexplode(text.segments(F.col("body"), most=None)).alias("pos", "segment"))
    return vectors.vectorise(s, "segment").select("doc_id", "pos", F.size("vector").alias("size"))


@query()
def vector_store(t):
    spark = t("nation").sparkSession
    e = t("embeddings").select("vec_id", "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("document"))
    path = f"{shared_dir(spark)}/foliospark/vectors-{uuid.uuid4().hex}"
    files.write_vectors(e, path, "vec_id", "embedding", "document")
    q = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return files.query_vectors(spark, path, q, 3).select("query", "rank", "id", "document", "distance")


# ---- streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    """Tumbling windows over a stream that is read to its end."""
    spark = t("nation").sparkSession
    out = f"{shared_dir(spark)}/foliospark/stream-{uuid.uuid4().hex}"
    src = streams.table_stream(spark, t.path("events"))
    e = src.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "1 hour")
    counts = e.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
    streams.run_complete(counts, out)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("SELECT doc_id, 1 + length(text) // 1000 AS num_pages FROM documents")
def stream_columns(t):
    spark = t("nation").sparkSession
    out = f"{shared_dir(spark)}/foliospark/stream-{uuid.uuid4().hex}"
    s = streams.table_stream(spark, t.path("documents"))
    streams.run_once(s.select("doc_id", text.num_pages(F.col("text")).alias("num_pages")), out)
    return spark.read.parquet(out)
