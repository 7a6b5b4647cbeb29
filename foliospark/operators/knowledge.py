"""Tokens, relations, entities and the document graph; a rule-based annotator as default."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import mapped
from ..runtime import save_table

TOKEN = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("dep", T.StringType()), T.StructField("head", T.IntegerType()), T.StructField("sent", T.IntegerType()), T.StructField("ent", T.StringType())]))
_DET = {"the", "a", "an", "this", "that", "der", "die", "das", "le", "la", "les", "un", "une", "el", "los", "las"}
_PREP = {"of", "in", "on", "at", "to", "for", "with", "by", "from", "von", "zu", "mit", "de", "du", "en", "por", "para"}
_COP = {"is", "are", "was", "were", "be", "ist", "sind", "est", "sont", "es", "son"}
_PRON = {"it", "he", "she", "they", "you", "we", "i"}


def rule_tokens(text: str | None) -> list[dict]:
    """Tokens with part of speech and dependencies by simple rules: a copula or else the second
    content word is the verb, what precedes it the subject, what follows the object."""
    out, sent, start = [], 0, 0
    words = re.findall(r"\w+|[^\w\s]", text or "")

    def close(end: int) -> None:
        own = out[start:end]
        content = [t for t in own if t["pos"] == "NOUN"]
        verb = next((t for t in own if t["pos"] == "AUX"), None) or (content[1] if len(content) > 2 else None)
        if verb is None:
            return
        verb["dep"], verb["head"] = "ROOT", verb["i"]
        if verb["pos"] == "NOUN":
            verb["pos"] = "VERB"
        subject, prep, direct = False, None, False
        for t in own:
            if t is verb:
                continue
            if t["pos"] == "ADP":
                prep = t
                t["dep"], t["head"] = "prep", verb["i"]
            elif t["pos"] == "NOUN":
                if prep is not None:
                    t["dep"], t["head"], prep = "pobj", prep["i"], None
                elif t["i"] < verb["i"] and not subject:
                    t["dep"], t["head"], subject = "nsubj", verb["i"], True
                elif t["i"] > verb["i"] and not direct:
                    t["dep"], t["head"], direct = ("attr" if verb["pos"] == "AUX" else "dobj"), verb["i"], True

    for k, w in enumerate(words):
        low = w.lower()
        pos = "PUNCT" if not w[0].isalnum() else "NUM" if w.isdigit() else "DET" if low in _DET else "ADP" if low in _PREP else "AUX" if low in _COP else "PRON" if low in _PRON else "NOUN"
        out.append({"i": k, "text": w, "pos": pos, "dep": "dep", "head": k, "sent": sent, "ent": "NUMBER" if pos == "NUM" else "NAME" if pos == "NOUN" and w[0].isupper() else None})
        if w in ".!?":
            close(k + 1)
            sent, start = sent + 1, k + 1
    close(len(out))
    return out


def annotate(df: DataFrame, text: str = "text", annotator: Callable[[str | None], list[dict]] = rule_tokens) -> DataFrame:
    """``df`` with ``tokens`` by a pluggable annotator."""
    return df.withColumn("tokens", tokens_of(text, annotator))


def tokens_of(text, annotator: Callable[[str | None], list[dict]] = rule_tokens):
    """Column of the annotated tokens of a text."""
    return mapped(annotator, TOKEN, text)


def entities_of(text, annotator: Callable[[str | None], list[dict]] = rule_tokens):
    """Column of the entities of a text: lists by label."""

    def one(t: str | None) -> dict:
        out: dict = {}
        for x in annotator(t):
            if x["ent"]:
                out.setdefault(x["ent"], []).append(x["text"].strip())
        return out

    return mapped(one, T.MapType(T.StringType(), T.ArrayType(T.StringType())), text)


def token_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.inline("tokens"))


def noun_chunks(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of nouns, adjectives and numbers; determiners, pronouns and white space never belong."""
    w = Window.partitionBy(key).orderBy("i")
    kept = tokens.filter("pos in ('NOUN', 'ADJ', 'NUM')").withColumn("g", F.col("i") - F.row_number().over(w))
    return kept.groupBy(key, "sent", "g").agg(F.min("i").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("chunk")).drop("g")


def relations(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(n1, n2, type, label): subject-verb-object, attribute, prepositional, possessive, adjective."""
    t = lambda a, cond: tokens.filter(cond).select(key, *[F.col(c).alias(f"{a}_{c}") for c in ("i", "text", "dep", "head", "pos")])
    row = lambda n1, n2, kind, label: [key, F.col(n1).alias("n1"), F.col(n2).alias("n2"), F.lit(kind).alias("type"), label.alias("label")]
    s, o, h, p = t("s", "dep in ('nsubj', 'nsubjpass')"), t("o", "dep in ('dobj', 'pobj')"), t("h", "true"), t("p", "dep = 'prep'")
    at = lambda a, b: [F.col(f"{a}_head") == F.col(f"{b}_head")]
    svo = s.join(o.withColumnRenamed(key, "k2"), [F.col(key) == F.col("k2"), *at("s", "o")]).join(h.withColumnRenamed(key, "k3"), [F.col(key) == F.col("k3"), F.col("s_head") == F.col("h_i")]).select(*row("s_i", "o_i", "SVO", F.col("h_text")))
    a = t("a", "dep = 'attr'")
    left = a.join(s.withColumnRenamed(key, "k2"), [F.col(key) == F.col("k2"), *at("a", "s")]).groupBy(key, "a_i").agg(F.min("s_i").alias("s_i"))
    attr = left.select(*row("s_i", "a_i", "Attribute", F.lit("is")))
    po = t("o", "dep = 'pobj'")
    prep = po.join(p.withColumnRenamed(key, "k2"), [F.col(key) == F.col("k2"), F.col("o_head") == F.col("p_i")]).select(*row("p_head", "o_i", "Prepositional", F.lit("related")))
    poss = t("x", "dep = 'poss'").select(*row("x_i", "x_head", "Possessive", F.lit("has")))
    amod = t("x", "dep = 'amod'").select(*row("x_head", "x_i", "Adjective", F.lit("is")))
    return svo.unionByName(attr).unionByName(prep).unionByName(poss).unionByName(amod)


def entities(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entity texts by label as a map of lists in order."""
    e = tokens.filter("ent is not null").groupBy(key, "ent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("text").alias("t")))), lambda x: x["t"]).alias("l"))
    return e.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ent", "l")))).alias("entities"))


def document_graph(tokens: DataFrame, rel: DataFrame, coreferences: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): a vertex for the document and for each group of tokens that relations use; a group
    is a coreference cluster (``key``, i, group) or a single token, its label the most frequent text."""
    used = rel.select(key, F.col("n1").alias("i")).unionByName(rel.select(key, F.col("n2").alias("i"))).distinct()
    named = used.join(tokens.select(key, "i", "text"), [key, "i"])
    if coreferences is not None:
        named = named.join(coreferences.select(key, "i", "group"), [key, "i"], "left").withColumn("group", F.coalesce("group", "i"))
    else:
        named = named.withColumn("group", F.col("i"))
    named = save_table(named, "named")
    node = lambda c: F.concat(F.col(key).cast("string"), F.lit(":t"), c.cast("string"))
    groups = named.groupBy(key, "group").agg(F.mode("text", deterministic=True).alias("label"))
    docs = tokens.select(key).distinct()
    vertices = docs.select(F.concat(F.col(key).cast("string"), F.lit(":d")).alias("id"), F.lit("document").alias("kind"), F.col(key).cast("string").alias("label")).unionByName(groups.select(node(F.col("group")).alias("id"), F.lit("token").alias("kind"), "label"))
    g = named.select(key, "i", "group")
    edges = rel.join(g.withColumnsRenamed({"i": "n1", "group": "g1"}), [key, "n1"]).join(g.withColumnsRenamed({"i": "n2", "group": "g2"}), [key, "n2"]).select(node(F.col("g1")).alias("src"), node(F.col("g2")).alias("dst"), "label").distinct()
    parent = groups.select(F.concat(F.col(key).cast("string"), F.lit(":d")).alias("src"), node(F.col("group")).alias("dst"), F.lit("is parent").alias("label"))
    return vertices, edges.unionByName(parent)


def dot(vertices: list, edges: list) -> str:
    """A graph as DOT text."""
    quote = lambda s: '"' + str(s).replace('"', "'") + '"'
    return "\n".join(["digraph {", *(f"  {quote(v[0])} [label={quote(v[2])}];" for v in vertices), *(f"  {quote(e[0])} -> {quote(e[1])} [label={quote(e[2])}];" for e in edges), "}"])


def model_id(language, size: str = "md"):
    """Column: name of the language model for a language, the multi-language one if unknown."""
    web, news = ("en", "zh"), ("ca", "da", "de", "el", "es", "fi", "fr", "hr", "it", "ja", "ko", "lt", "mk", "nb", "nl", "pl", "pt", "ro", "ru", "sl", "sv", "uk")
    name = lambda kind: F.concat(language, F.lit(f"_core_{kind}_{size}"))
    return F.when(language.isin(*web), name("web")).when(language.isin(*news), name("news")).otherwise(F.lit("xx_sent_ud_sm"))
