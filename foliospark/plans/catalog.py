"""Every registered query of the document operators and its SQL twin.

A query takes (spark, sf_dir) and runs over whole tables; floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structs, text, web
from ..operators import components, elements, geometry, vectors
from . import relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (reader of tables, which has their ``path`` too) -> DataFrame under its name, with its SQL."""

    def add(f):
        name = f.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(t: str) -> DataFrame:
                return spark.read.parquet(read.path(t))

            read.path = lambda t: f"{sf_dir}/{t}.parquet"
            return f(read)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- scalar columns over documents and pages

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
RATIO = r"""CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) + length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) > 0
  THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / (length(regexp_replace(text, '[^\p{L}]', '', 'g')) + length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))) ELSE 0.5 END"""


@query(f"SELECT doc_id, source, lang AS language, 1 + length(text) // 1000 AS num_pages, {WORDS} AS num_words, round({RATIO}, 6) AS a_d_ratio FROM documents")
def file_meta(t):
    d, x = t("documents"), F.col("text")
    return d.select("doc_id", "source", F.col("lang").alias("language"), text.num_pages(x).alias("num_pages"), text.num_words(x).alias("num_words"), r6(text.letter_ratio(x)).alias("a_d_ratio"))


@query("SELECT doc_id, " + " + ".join(f"regexp_matches(text, '(?m){p}')::INT" for p in text.MARKDOWN.values()) + " AS signs, signs >= 3 AS markdown FROM documents")
def contains_markdown(t):
    return t("documents").select("doc_id", text.markdown_signs(F.col("text")).alias("signs"), text.contains_markdown(F.col("text")).alias("markdown"))


_MD = "(" + " + ".join(f"regexp_matches(body, '(?m){p}')::INT" for p in text.MARKDOWN.values()) + ") >= 3"


@query(f"""SELECT kind, id, CASE WHEN regexp_matches(body, '(?is)<!DOCTYPE html.*?>') THEN 'text/html'
  WHEN regexp_matches(body, '(?is)<\\?xml.*?\\?>') OR regexp_matches(body, '(?is)^\\s*<(?:\\?xml|[a-z][^>]*>)') THEN CASE WHEN regexp_matches(body, '(?is)<mediawiki xmlns="http://www.mediawiki.org/xml/export-.*?"') THEN 'mediawiki' ELSE 'application/xml' END
  WHEN starts_with(body, '{{\\rtf') THEN 'text/rtf' WHEN {_MD} THEN 'text/markdown' ELSE 'text/plain' END AS document_type
  FROM (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)""")
def detect_type(t):
    both = t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")).unionAll(t("documents").select(F.lit("document"), "doc_id", "text"))
    return both.select("kind", "id", web.type_of_text(F.col("body"), text.contains_markdown(F.col("body"))).alias("document_type"))


@query(r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+') AS is_url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_parts(t):
    return t("pages").select("page_id", web.is_url(F.col("url")).alias("is_url"), *[c.alias(k) for k, c in web.url_parts(F.col("url")).items()])


@query("SELECT page_id, regexp_replace(regexp_extract(u, '([^/]*)$', 1), 'pdf$', '') || right(md5(u), 2) || '.pdf' AS file FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '/f.pdf' AS u FROM pages)")
def pdf_file_name(t):
    u = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/f.pdf"))
    return t("pages").select("page_id", web.pdf_file_name(u).alias("file"))


@query("""SELECT page_id, substr(u, 1, 7) || replace(substr(u, 8), '//', '/') AS joined, regexp_replace(url, '^([a-z]+://[^/?#]*)[^?#]*', '\\1/index.html') AS moved FROM (SELECT page_id, url, url || '//x//y' AS u FROM pages)""")
def url_join(t):
    return t("pages").select("page_id", web.collapse_slashes(F.concat("url", F.lit("//x//y"))).alias("joined"), web.absolute_path(F.col("url"), F.lit("/index.html")).alias("moved"))


@query(r"""SELECT page_id, len(l) AS links, list_filter(l, lambda h: ends_with(lower(h), '.pdf')) AS pdf_links, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title
  FROM (SELECT page_id, html, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS l FROM pages)""")
def page_links(t):
    h = F.col("html")
    return t("pages").select("page_id", F.size(web.links(h)).alias("links"), web.pdf_links(h).alias("pdf_links"), web.title(h).alias("title"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_STRIP} AS plain, round(length({_STRIP}) / length(html), 6) AS density, length(regexp_replace(html, '(?i)\\s(?:class|id|name|style)=\"[^\"]*\"', '', 'g')) AS clean_length FROM pages")
def strip_html(t):
    h = F.col("html")
    return t("pages").select("page_id", web.strip_html(h).alias("plain"), r6(web.text_density(h)).alias("density"), F.length(web.clean_attributes(h)).alias("clean_length"))


@query(f"SELECT page_id, length(url) AS url_length, len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) AS path_parts, length(regexp_extract(url, '\\?([^#]*)', 1)) AS query_length, length(html) AS html_length, length({_STRIP}) AS text_length FROM pages")
def page_meta_info(t):
    p = web.url_parts(F.col("url"))
    return t("pages").select("page_id", F.length("url").alias("url_length"), F.size(F.split(p["path"], "/")).alias("path_parts"), F.length(p["query"]).alias("query_length"), F.length("html").alias("html_length"), F.length(web.strip_html(F.col("html"))).alias("text_length"))


@query()
def html_extract(t):
    return t("pages").select("page_id", "url", web.page("html").alias("p")).select("page_id", "url", "p.*")


# ---- text structure


def paragraphs(t) -> DataFrame:
    return t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))


@query("""SELECT doc_id, (i - 1)::INT AS pos, s AS segment FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, CASE WHEN trim(r.open, e' \\t\\n\\r\\x0b\\x0c') <> '' THEN list_append(r.done, trim(r.open, e' \\t\\n\\r\\x0b\\x0c')) ELSE r.done END AS p FROM (
    SELECT doc_id, list_reduce(list_transform(string_split(replace(text, e'\\n', e'\\n\\n'), e'\\n\\n'), lambda x: {'open': x, 'done': []::VARCHAR[]}),
      lambda a, x: CASE WHEN length(a.open) < 256 THEN {'open': a.open || x.open || e'\\n\\n', 'done': a.done}
        ELSE {'open': '', 'done': list_concat(a.done, CASE WHEN length(a.open || x.open) > 512 THEN list_transform(range(0, length(a.open || x.open), 358), lambda k: trim(substr(a.open || x.open, k + 1, 512), e' \\t\\n\\r\\x0b\\x0c')) ELSE [trim(a.open || x.open, e' \\t\\n\\r\\x0b\\x0c')] END)} END,
      {'open': '', 'done': []::VARCHAR[]}) AS r FROM documents)))""")
def text_segments(t):
    s = text.segments(F.col("body"), most=None)
    return paragraphs(t).select("doc_id", F.posexplode(s).alias("pos", "segment"))


@query(r"""SELECT doc_id, k::INT AS page, list_aggregate(list_slice(w, k * 500 + 1, k * 500 + 500), 'string_agg', ' ') AS words FROM (SELECT doc_id, w, unnest(range(ceil(len(w) / 500)::BIGINT)) AS k
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents))""")
def text_pages_500w(t):
    return t("documents").select("doc_id", F.posexplode(text.word_pages(F.col("text"))).alias("page", "words"))


@query("SELECT doc_id, (i - 1)::INT AS boxnum, s AS text, 0 AS p_num, 1 AS level FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(replace(text, e'\\n', e'\\n\\n'), e'\\n\\n') AS p FROM documents))")
def text_elements(t):
    return paragraphs(t).select("doc_id", F.inline(text.elements(F.col("body"))))


@query(r"""SELECT doc_id, trim(s) AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, e'\n')) AS s FROM documents)
  WHERE regexp_matches(trim(s), '^[-*∙•]') AND NOT regexp_matches(trim(s), '^[-*∙•][\d-]+\s?(?:[°˚][CKF]?|[℃℉])') GROUP BY ALL""")
def list_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.filter(text.is_list_line(F.col("s"))).groupBy("doc_id", F.trim("s").alias("line")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT doc_id, substr(low, i, 2) AS g FROM (SELECT doc_id, lower(text) AS low, unnest(range(1, length(text))) AS i FROM documents)),
  c AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id, g), r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r FROM c),
  top AS (SELECT doc_id, list(c ORDER BY c) AS l FROM r WHERE r <= 5 GROUP BY doc_id)
  SELECT doc_id, list_concat(list_resize([]::INT[], 5 - len(coalesce(l, [])), 0), coalesce(l, []))::INT[] AS counts FROM documents LEFT JOIN top USING (doc_id)""")
def topk_bigrams(t):
    return t("documents").select("doc_id", text.bigram_features(F.col("text")).alias("counts"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word")
def word_frequency(t):
    return t("documents").select(F.explode(text.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round((length(text) - length(replace(text, e'\\n', ''))) / (length(text) + 1e-4), 6) AS newlines, round((length(text) - length(replace(text, ' ', ''))) / (length(text) + 1e-4), 6) AS spaces,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / (length(text) + 1e-4), 6) AS digits, round(length(text) / 2000.0, 6) AS size FROM documents""")
def text_block_features(t):
    return t("documents").select("doc_id", *[r6(c).alias(k) for k, c in text.block_features(F.col("text")).items()])


@query("SELECT doc_id, length(text) // 2 AS at, substr(text, greatest(length(text) // 2 - 100, 0) + 1, least(length(text) // 2, 100)) AS before, substr(text, length(text) // 2 + 1, 5) AS token, substr(text, length(text) // 2 + 6, 100) AS after FROM documents")
def token_context(t):
    at = F.floor(F.length("text") / 2).cast("int")
    return t("documents").select("doc_id", at.cast("long").alias("at"), text.context(F.col("text"), at, at + 5).alias("c")).select("doc_id", "at", "c.*")


@query(r"""SELECT doc_id, CASE WHEN trim(s) = '' THEN '<empty>' ELSE s END AS label FROM (SELECT doc_id, substr(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
  e'\n', '<br/>'), '\', '\\'), e'\t', '\t'), e'\r', '\r'), e'\f', '\f'), '{', '\{'), '}', '\}'), '|', '\|'), '"', '&quot;'), '[', '\['), ']', '\]'), '[^ -~]+', '', 'g'), 1, 1000) AS s FROM documents)""")
def graph_label(t):
    return t("documents").select("doc_id", text.graph_label(F.col("text")).alias("label"))


@query(r"""SELECT doc_id, regexp_extract_all(text, 'https?://[^\s<>"]+|www\.[^\s<>"]+') AS urls, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS emails FROM documents""")
def url_email_extract(t):
    return t("documents").select("doc_id", F.regexp_extract_all("text", F.lit(r'https?://[^\s<>"]+|www\.[^\s<>"]+'), 0).alias("urls"), F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0).alias("emails"))


# ---- structures and bags


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso FROM events")
def select_json(t):
    s = structs.select(F.col("props"), "k", "missing")
    return t("events").select("event_id", "event_type", s.alias("s"), structs.iso_time(F.col("ts")).alias("ts_iso")).select("event_id", "event_type", "s.*", "ts_iso")


@query("SELECT event_type, list_sort(list_distinct(list(json_extract_string(props, '$.k')))) AS keys, count(*) AS n FROM events GROUP BY event_type")
def flatten_unique(t):
    k = F.array(F.array(F.get_json_object("props", "$.k"), F.lit(None).cast("string")), F.array(F.lit(" ")))
    e = t("events").select("event_type", structs.flatten_unique(k).alias("l"))
    return e.groupBy("event_type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("keys"), F.count("*").alias("n"))


@query("SELECT conv_id, (i - 1)::INT AS pos, s AS fobj FROM (SELECT conv_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id))")
def bag_explode(t):
    c = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    return c.select("conv_id", F.posexplode("l").alias("pos", "fobj"))


@query("SELECT conv_id, sum(n)::BIGINT AS chars, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns FROM (SELECT conv_id, role, length(text) AS n FROM conversations) GROUP BY conv_id")
def bag_stats(t):
    return t("conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))


_PROMPT = ("# Instruction: below is a question, a task or a conversation; write a fitting answer.\n\n## Prompt:\n\n", "\n\n## Input:\n\n", "\n\n## Result:\n\n")


@query("SELECT conv_id, turn, sha256(prompt) AS key, prompt FROM (SELECT conv_id, turn, '{}Summarise.{}' || text || '{}' AS prompt FROM conversations WHERE role = 'user')".format(*_PROMPT))
def chat_prompt(t):
    p = F.concat(F.lit(_PROMPT[0] + "Summarise." + _PROMPT[1]), "text", F.lit(_PROMPT[2]))
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", F.sha2(p, 256).alias("key"), p.alias("prompt"))


# ---- relational idioms


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last_dedup(t):
    return relational.keep_last(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("""SELECT coalesce(c.k, s.k) AS k, c.customers, s.suppliers, CASE WHEN c.k IS NULL THEN 'right_only' WHEN s.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge
  FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s USING (k)""")
def indicator_full_outer(t):
    c = t("customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = t("supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return relational.merged(c, s, ["k"])


@query("""SELECT p_partkey, m.s AS match, round(m.d, 6) AS distance FROM (SELECT p_partkey, min({'d': round(abs(p_retailprice - s_acctbal), 6), 's': s_suppkey}) AS m
  FROM part JOIN supplier ON p_size % 25 = s_nationkey GROUP BY p_partkey)""")
def nearest_match(t):
    p = t("part").withColumn("k", F.col("p_size") % 25)
    s = t("supplier").withColumn("k", F.col("s_nationkey"))
    return relational.nearest(p, s, ["k"], "p_partkey", "s_suppkey", [("p_retailprice", "s_acctbal")], digits=6)


@query("""SELECT 'with' AS side, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)
  UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def semi_anti(t):
    o, c = t("orders").filter("o_totalprice > 200000"), t("customer")
    on = F.col("o_custkey") == F.col("c_custkey")
    return c.join(o, on, "left_semi").select(F.lit("with").alias("side"), "c_custkey").unionByName(c.join(o, on, "left_anti").select(F.lit("without").alias("side"), "c_custkey"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS finished FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def count_if_left_join(t):
    n = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("finished"))


@query("""SELECT c_nationkey AS row, """ + ", ".join(f"""coalesce(min(CASE WHEN c_mktsegment = '{s}' THEN c_name END), '') AS "{s}\"""" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY c_nationkey")
def pivot_first(t):
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return t("customer").groupBy(F.col("c_nationkey").alias("row")).pivot("c_mktsegment", kinds).agg(F.min("c_name")).na.fill("")


@query("""SELECT v, sum(n) OVER (ORDER BY v)::INT AS cluster FROM (SELECT v, CASE WHEN v - lag(v) OVER (ORDER BY v) > 0.5 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT p_retailprice AS v FROM part))""")
def cluster1d(t):
    return geometry.cluster_1d(t("part").select(F.col("p_retailprice").alias("v")), "v", 0.5)


@query("SELECT l_returnflag, l_linestatus, q75, count(*) AS above FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus) WHERE l_quantity >= q75 GROUP BY ALL")
def q75_filter(t):
    keys = ["l_returnflag", "l_linestatus"]
    q = t("lineitem").groupBy(*keys).agg(F.percentile("l_quantity", 0.75).alias("q75"))
    return t("lineitem").join(F.broadcast(q), keys).filter("l_quantity >= q75").groupBy(*keys, "q75").agg(F.count("*").alias("above"))


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
  SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'union_all', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)
  UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(t):
    a = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return tag("union", a.union(b).distinct()).union(tag("union_all", a.unionAll(b))).union(tag("intersect", a.intersect(b))).union(tag("except", a.subtract(b)))


@query("SELECT lang AS class, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'unknown' END AS recoded, count(*) AS n, round(total / (classes * count(*)), 6) AS weight FROM documents, (SELECT count(*) AS total, count(DISTINCT lang) AS classes FROM documents) GROUP BY lang, total, classes")
def recode_labels(t):
    w = relational.class_weights(t("documents"), "lang")
    return w.select(F.col("lang").alias("class"), relational.recode(F.col("lang"), ["en", "de"]).alias("recoded"), "n", r6(F.col("weight")).alias("weight"))


@query("""SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp,
  count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM (SELECT toxic = 1 AS truth, regexp_matches(text, '(?i)idiot|moron|stupid|loser') AS guess FROM labels JOIN documents USING (doc_id)))""")
def confusion_stats(t):
    d = t("labels").join(t("documents"), "doc_id")
    c = relational.confusion(d, F.col("toxic") == 1, F.col("text").rlike("(?i)idiot|moron|stupid|loser"))
    return c.select("tp", "fp", "fn", "tn", *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("""WITH p AS (SELECT lang AS truth, CASE WHEN regexp_matches(text, '(^|\\s)the(\\s|$)') THEN 'en' WHEN regexp_matches(text, '(^|\\s)und(\\s|$)') THEN 'de' WHEN regexp_matches(text, '(^|\\s)des(\\s|$)') THEN 'fr' ELSE 'es' END AS guess FROM documents),
  t AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = guess) AS tp FROM p GROUP BY 1), g AS (SELECT guess AS class, count(*) AS guessed FROM p GROUP BY 1)
  SELECT class, coalesce(support, 0) AS support, coalesce(guessed, 0) AS guessed, coalesce(tp, 0) AS tp, round(coalesce(tp / guessed, 0), 6) AS precision, round(coalesce(tp / support, 0), 6) AS recall, round(coalesce(2.0 * tp / (support + guessed), 0), 6) AS f1 FROM t FULL JOIN g USING (class)""")
def classification_report(t):
    x = F.col("text")
    guess = F.when(x.rlike(r"(^|\s)the(\s|$)"), "en").when(x.rlike(r"(^|\s)und(\s|$)"), "de").when(x.rlike(r"(^|\s)des(\s|$)"), "fr").otherwise("es")
    r = relational.report(t("documents").select(F.col("lang").alias("truth"), guess.alias("guess")), "truth", "guess")
    return r.select("class", "support", "guessed", "tp", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || ':69'), 1, 8))::BIGINT < 3435973836 THEN 'train' ELSE 'test' END AS part FROM documents")
def split_ratio(t):
    return relational.split(t("documents").select("doc_id"), F.col("doc_id"))


@query("SELECT user_id, day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS running, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS diff, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS pos FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)")
def running_diffs(t):
    w = Window.partitionBy("user_id").orderBy("day")
    d = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select("user_id", "day", "n", F.sum("n").over(w).alias("running"), (F.col("n") - F.lag("n").over(w)).alias("diff"), (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("SELECT p_brand AS street, count(*) AS n, list_sort(list_distinct(list(p_type))) AS types FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type FROM part) GROUP BY p_brand")
def distinct_lists(t):
    p = t("part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("street"), "p_type")
    return p.groupBy("street").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_type")).alias("types"))


# ---- boxes and elements (derived from part: 40 boxes a page)

BOXES = """SELECT p_partkey AS id, (p_partkey // 40)::BIGINT AS p_num, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0, (p_partkey * 37 % 500 + 10 + p_size)::DOUBLE AS x1, (p_partkey * 53 % 700 + 5 + p_partkey % 20)::DOUBLE AS y1, p_name AS text,
  CASE p_partkey % 5 WHEN 0 THEN 'Image' WHEN 1 THEN 'Table' ELSE 'TextBox' END AS type FROM part"""


def boxes(t) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 37 % 500, k * 53 % 700
    d = lambda c: c.cast("double")
    kind = F.when(k % 5 == 0, "Image").when(k % 5 == 1, "Table").otherwise("TextBox")
    return t("part").select(k.alias("id"), F.floor(k / 40).alias("p_num"), d(x).alias("x0"), d(y).alias("y0"), d(x + 10 + F.col("p_size")).alias("x1"), d(y + 5 + k % 20).alias("y1"), F.col("p_name").alias("text"), kind.alias("type"))


@query(f"SELECT id, x0 > 90 AND y0 > 90 AND x1 < 310 AND y1 < 410 AS inside, x0 < 301 AND x1 > 99 AND y0 < 401 AND y1 > 99 AS touches FROM ({BOXES})")
def bbox_queries(t):
    b = (100, 100, 300, 400)
    return boxes(t).select("id", geometry.inside(b).alias("inside"), geometry.intersects(b).alias("touches"))


_EX, _EY = "(greatest(a.x1, b.x1) - least(a.x0, b.x0))", "(greatest(a.y1, b.y1) - least(a.y0, b.y0))"
_AA, _AB = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
_GX, _GY = f"({_EX} - (a.x1 - a.x0) - (b.x1 - b.x0))", f"({_EY} - (a.y1 - a.y0) - (b.y1 - b.y0))"
_AL = f"({_EY} - greatest(a.y1 - a.y0, b.y1 - b.y0))"


@query(f"""WITH b AS ({BOXES}) SELECT a.id AS a, b.id AS b, greatest({_EX} * {_EY} - {_AA} - {_AB}, 0) AS area_distance, {_GX} AS gap_x, {_GY} AS gap_y, least({_AA}, {_AB}) / greatest({_AA}, {_AB}) AS size_similarity,
  round(CASE WHEN {_GX} < 0 AND {_GY} < 0 THEN -1 ELSE 1 END * {_GX} * {_GY} / ({_AA} + {_AB}), 6) AS overlap, {_AL} AS alignment, round(greatest(greatest({_AL}, 0) / 3.0, greatest({_GX}, 0) / 10.0), 6) AS text_distance,
  abs(a.x0 - b.x0) + abs(a.y0 - b.y0) + abs(a.x1 - b.x1) + abs(a.y1 - b.y1) AS manhattan, round(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2 + (a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), 6) AS euclidean, {_EX} * {_EY} < {_AB} + 1e-6 AS inside,
  greatest(least(abs(a.x0 - b.x0), abs(a.x0 - b.x1), abs(a.x1 - b.x0), abs(a.x1 - b.x1)), least(abs(a.y0 - b.y0), abs(a.y0 - b.y1), abs(a.y1 - b.y0), abs(a.y1 - b.y1))) AS edges, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS center
  FROM b a JOIN b b ON a.p_num = b.p_num AND a.id < b.id""")
def pair_distances(t):
    g = geometry
    cols = {
        "area_distance": g.area_distance(), "gap_x": g.gap(0), "gap_y": g.gap(1), "size_similarity": g.size_similarity(), "overlap": r6(g.overlap_distance()), "alignment": g.alignment(0),
        "text_distance": r6(g.text_distance(3.0, 10.0)), "manhattan": g.manhattan(), "euclidean": r6(g.euclidean()), "inside": g.joint_inside(), "edges": g.edge_similarity(), "center": g.edge_alignments()["center"],
    }
    return g.pairs(boxes(t), ["p_num"]).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *[c.alias(k) for k, c in cols.items()])


@query(f"""WITH RECURSIVE b AS ({BOXES}), e AS (SELECT a.p_num, a.id AS u, b.id AS v FROM b a JOIN b b ON a.p_num = b.p_num AND a.id <> b.id WHERE greatest(greatest({_AL}, 0) / 20.0, greatest({_GX}, 0) / 30.0) < 1),
  walk AS (SELECT id, id AS root FROM b UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.id), m AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id)
  SELECT p_num, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b JOIN m USING (id) GROUP BY p_num, cluster""")
def distance_clusters(t):
    c = geometry.components_within(boxes(t), ["p_num"], geometry.text_distance(20.0, 30.0), 1.0)
    return geometry.merge_boxes(boxes(t).join(c, ["p_num", "id"]), ["p_num", "cluster"])


@query(f"SELECT p_num, (id // 4)::BIGINT AS boxnum, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, trim(string_agg(text || e'\\n', '' ORDER BY id), e' \\n\\t\\r') AS text FROM ({BOXES}) GROUP BY ALL")
def group_boxes(t):
    b = boxes(t).select("p_num", F.floor(F.col("id") / 4).alias("boxnum"), "id", F.concat("text", F.lit("\n")).alias("rawtext"), *geometry.BOX)
    return elements.group_boxes(b, order="id")


@query(f"SELECT section, string_agg(text, '' ORDER BY id) AS text, min(id) AS first FROM (SELECT *, unnest(['S' || p_num, type]) AS section FROM ({BOXES})) GROUP BY section")
def text_sections(t):
    b = boxes(t).select(F.col("id").alias("boxnum"), F.col("text").alias("rawtext"), F.array(F.concat(F.lit("S"), F.col("p_num").cast("string")), F.col("type")).alias("sections"))
    return elements.sections(b)


@query(f"SELECT p_num, string_agg(CASE WHEN type IN ('Table', 'Image') THEN '{{' || type || '_' || id || '}}' ELSE text END, e'\\n\\n' ORDER BY y0 DESC, x0, id) AS template FROM ({BOXES}) GROUP BY p_num")
def page_template(t):
    b = boxes(t).withColumn("mean_char_orientation", F.lit(0.0)).withColumn("labels", F.array().cast("array<string>"))
    return elements.page_template(b, ("Table", "Image"))


@query(f"""WITH b AS ({BOXES}) SELECT t.p_num, t.id AS area, string_agg(e.text, e'\\n' ORDER BY e.y0 DESC, e.x0, e.id) AS context FROM b t JOIN b e ON e.p_num = t.p_num AND t.type = 'Table' AND e.type = 'TextBox'
  AND e.x0 > t.x0 - 60 AND e.y0 > t.y0 - 60 AND e.x1 < t.x1 + 60 AND e.y1 < t.y1 + 60 AND NOT (e.x0 > t.x0 AND e.y0 > t.y0 AND e.x1 < t.x1 AND e.y1 < t.y1) GROUP BY t.p_num, t.id""")
def table_context(t):
    b = boxes(t)
    return elements.area_context(b.filter("type = 'TextBox'"), b.filter("type = 'Table'"), ["p_num"], 60)


@query(f"""WITH b AS ({BOXES}), o AS (SELECT p_num, x0, y0, type, text FROM b e WHERE type <> 'Table' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.type = 'Table' AND t.p_num = e.p_num AND e.x0 > t.x0 - 10 AND e.y0 > t.y0 - 10 AND e.x1 < t.x1 + 10 AND e.y1 < t.y1 + 10)
  UNION ALL SELECT p_num, x0, y0, type, text FROM b WHERE type = 'Table') SELECT p_num, x0, y0, type, text, (row_number() OVER (PARTITION BY p_num ORDER BY y0 DESC, x0, type, text) - 1)::INT AS id FROM o""")
def document_objects(t):
    b = boxes(t)
    return elements.document_objects(b.filter("type = 'Image'"), b.filter("type = 'TextBox'"), b.filter("type = 'Table'"), ["p_num"]).select("p_num", "x0", "y0", "type", "text", "id")


# ---- vectors and graphs

_COS = "round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query(f"SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS}, b.vec_id)::INT AS rank FROM embeddings a, embeddings b QUALIFY rank <= 5")
def knn_top5(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.knn(e, e, 5)


_EDGES = f"(SELECT src, dst, round(1 - d, 6) AS weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS}, b.vec_id) <= 4) WHERE d <= 0.75)"


def graph(t) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.similarity_graph(e, 4, 0.75)


@query(f"SELECT * FROM {_EDGES}")
def similarity_graph(t):
    return graph(t)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS u, dst AS v FROM {_EDGES}), sym AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
  walk AS (SELECT DISTINCT u AS node, u AS root FROM sym UNION SELECT sym.v, walk.root FROM walk JOIN sym ON sym.u = walk.node)
  SELECT node, min(root) AS component FROM walk GROUP BY node""")
def connected_components(t):
    return components.connected_components(graph(t), "src", "dst")


_GE = f"(SELECT label, src, dst, round(1 - d, 6) AS weight FROM (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, {_COS} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS}, b.vec_id) <= 4) WHERE d <= 0.9)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT label, src, dst, weight / sum(weight) OVER (PARTITION BY label, src) AS share FROM {_GE}), n AS MATERIALIZED (SELECT label, vec_id AS id, count(*) OVER (PARTITION BY label) AS size FROM embeddings),
  inn AS MATERIALIZED (SELECT n.label, n.id, n.size, list(struct_pack(s := e.src, w := e.share)) FILTER (e.src IS NOT NULL) AS froms, NOT EXISTS (SELECT 1 FROM e x WHERE x.src = n.id) AS dangling FROM n LEFT JOIN e ON e.dst = n.id GROUP BY ALL),
  it AS (SELECT label, id, 0 AS k, 1.0::DOUBLE / size AS x FROM n
    UNION ALL SELECT i.label, i.id, c.k + 1, 0.85 * (coalesce(list_sum(list_transform(i.froms, lambda f: f.w * element_at(c.m, f.s)[1])), 0) + c.d / i.size) + 0.15 / i.size
    FROM inn i JOIN (SELECT it.label, it.k, map_from_entries(list((it.id, it.x))) AS m, coalesce(sum(it.x) FILTER (inn.dangling), 0) AS d FROM it JOIN inn USING (id) WHERE it.k < 25 GROUP BY it.label, it.k) c ON c.label = i.label)
  SELECT label, id, round(x, 6) AS value FROM it WHERE k = 25""")
def pagerank(t):
    e = t("embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    edges = vectors.similarity_graph(e, 4, 0.9, group="label")
    edges = edges.join(e.select("label", F.col("id").alias("src")), "src")
    return vectors.pagerank_by(e, edges, "label", rounds=25, tol=None).withColumn("value", r6(F.col("value")))


@query("SELECT label, list(m ORDER BY pos) AS mean FROM (SELECT label, pos, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label")
def mean_vector(t):
    m = vectors.mean_vectors(t("embeddings").select("label", F.col("embedding").alias("vector")), ["label"])
    return m.select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))
