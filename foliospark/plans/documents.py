"""The document types and their nodes, as columns over (source, fobj, document_type, meta)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import structs, text, web
from ..operators import knowledge, models
from ..registry import Pipelines, alias, configuration, constant, node

PANDOC = ("pandoc",)
DOCX, ODT = web.EXTENSIONS["docx"], web.EXTENSIONS["odt"]



def _empty(kind: str) -> Column:
    return F.array().cast(kind)



GENERIC = [
    *alias(data="raw_content", clean_text="full_text", keywords="textrank_keywords", do="document_objects", url="source", sents="spacy_sents", noun_chunks="spacy_noun_chunks", tables="tables_dict", DG="document_graph_key"),
    node("raw_content", lambda of: F.col("fobj"), doc="content as text"),
    node("full_text", lambda of: of("raw_content"), inputs=("raw_content",), doc="text of the document", memo=True),
    node("page_set", lambda of: F.array(F.lit(0)), "array<int>"),
    node("source", lambda of: F.col("source")),
    node("uuid", lambda of: F.xxhash64("source", "fobj"), "bigint", "identity by source and content"),
    node("elements", lambda of: text.elements(of("full_text")), "array<struct>", "text boxes between blank lines", ("full_text",), memo=True),
    node("document_objects", lambda of: of("elements"), "array<struct>", inputs=("elements",)),
    node("text_box_elements", lambda of: of("elements"), "array<struct>", inputs=("elements",)),
    node("headers", lambda of: F.filter(F.split(of("full_text"), "\n"), lambda x: x.rlike(r"^#{1,6}\s")), "array<string>", inputs=("full_text",)),
    node("lists", lambda of: F.filter(F.split(of("full_text"), "\n"), text.is_list_line), "array<string>", inputs=("full_text",)),
    node("line_elements", lambda of: F.filter(F.split(of("full_text"), "\n"), lambda x: F.trim(x) != ""), "array<string>", inputs=("full_text",)),
    node("graphic_elements", lambda of: _empty("array<string>"), "array<string>"),
    node("image_elements", lambda of: _empty("array<string>"), "array<string>"),
    node("tables_df", lambda of: _empty("array<array<array<string>>>"), "array<array<array<string>>>"),
    node("tables_dict", lambda of: F.transform(of("tables_df"), lambda t: F.transform(t, lambda r, i: F.struct(i.alias("row"), r.alias("cells")))), "array<array<struct>>", inputs=("tables_df",)),
    node("page_templates", lambda of: F.create_map(F.lit(0), of("full_text")), "map<int,string>", inputs=("full_text",)),
    node("page_templates_str", lambda of: F.array_join(F.map_values(of("page_templates")), "\n\n"), inputs=("page_templates",)),
    node("page_templates_str_minimal", lambda of: F.array_join(F.map_values(of("page_templates")), "\n\n"), inputs=("page_templates",)),
    node("titles", lambda of: F.slice(F.filter(F.split(of("full_text"), "\n"), lambda x: F.trim(x) != ""), 1, 1), "array<string>", inputs=("full_text",)),
    node("side_titles", lambda of: _empty("array<string>"), "array<string>"),
    # meta data
    node("embedded_meta", lambda of: F.create_map().cast("map<string,string>"), "map<string,string>"),
    node("meta", lambda of: F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>"))), lambda e: ~F.array_contains(F.map_keys(of("embedded_meta")), e["key"])), F.map_entries(of("embedded_meta")))), "map<string,string>", inputs=("embedded_meta",)),
    node("num_pages", lambda of: text.num_pages(of("full_text")), "bigint", inputs=("full_text",)),
    node("num_words", lambda of: text.num_words(of("clean_text")), "int", inputs=("clean_text",)),
    node("num_sents", lambda of: F.size(of("spacy_sents")), "int", inputs=("spacy_sents",)),
    node("a_d_ratio", lambda of: text.letter_ratio(of("full_text")), "double", inputs=("full_text",)),
    node("language", lambda of: models.language(of("full_text")), inputs=("full_text",), default="unknown"),
    node("file_meta", lambda of: F.struct(of("source").alias("source"), F.col("document_type").alias("type"), of("num_pages").alias("num_pages"), of("num_words").alias("num_words"), of("a_d_ratio").alias("a_d_ratio")), "struct", inputs=("num_pages", "num_words", "a_d_ratio")),
    # tokens, sentences, vectors
    *configuration(spacy_model_size="md", spacy_model="auto", use_clean_text_for_spacy=True, coreference_method="fast", graph_debug_context_size=0),
    *configuration(vectorizer_model="hashing", vectorizer_only_tokenizer=False, vectorizer_overlap_ratio=0.1, min_size_text_segment=256, max_size_text_segment=512, text_segment_overlap=0.3, max_text_segment_num=100),
    *configuration(top_k_text_rank_keywords=5, top_k_text_rank_sentences=5, summarizer_model="extractive", summarizer_token_overlap=50, summarizer_max_text_len=200, qam_model_id="overlap", chat_model_id="none", image_dpi=216, ocr_lang="auto", ocr_on=True, full_text_format="markdown"),
    *constant(clean_format="plain"),
    node("clean_spacy_text", lambda of: F.when(of("use_clean_text_for_spacy"), of("page_templates_str")).otherwise(of("full_text")), inputs=("use_clean_text_for_spacy", "page_templates_str", "full_text")),
    node("spacy_sents", lambda of: F.filter(F.split(of("clean_spacy_text"), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != ""), "array<string>", inputs=("clean_spacy_text",)),
    node("spacy_noun_chunks", lambda of: F.filter(F.split(of("clean_spacy_text"), r"\W+"), lambda w: w.rlike("^[A-ZÄÖÜÉ]")), "array<string>", inputs=("clean_spacy_text",)),
    node("sent_ids", lambda of: F.transform(of("spacy_sents"), lambda x, i: i), "array<int>", inputs=("spacy_sents",)),
    node("noun_ids", lambda of: F.transform(of("spacy_noun_chunks"), lambda x, i: i), "array<int>", inputs=("spacy_noun_chunks",)),
    node("tokens", lambda of: text.words(of("full_text")), "array<string>", inputs=("full_text",)),
    node("text_segments", lambda of: text.segments(of("full_text")), "array<string>", "pieces for an index", ("full_text",), memo=True),
    node("text_segment_ids", lambda of: F.transform(of("text_segments"), lambda x, i: i), "array<int>", inputs=("text_segments",)),
    node("textrank_keywords", lambda of: F.slice(F.array_distinct(of("spacy_noun_chunks")), 1, 5), "array<string>", "default: the first distinct noun chunks", ("spacy_noun_chunks",)),
    node("textrank_sents", lambda of: F.slice(of("spacy_sents"), 1, 5), "array<string>", inputs=("spacy_sents",)),
    node("slow_summary", lambda of: text.extractive_summary(of("clean_text")), inputs=("clean_text",)),
    node("document_graph_key", lambda of: of("uuid"), "bigint", inputs=("uuid",)),
    # annotation, labels, vectors
    *alias(embedding="vector", emb="vector", pil_image="raw_content", pandoc_document="raw_content", ocr_pdf_file="raw_content", convert_to="full_text"),
    node("spacy_doc", lambda of: knowledge.tokens_of(of("clean_spacy_text")), "array<struct>", "annotated tokens", ("clean_spacy_text",), memo=True),
    node("entities", lambda of: knowledge.entities_of(of("clean_spacy_text")), "map<string,array<string>>", inputs=("clean_spacy_text",)),
    node("coreferences", lambda of: _empty("array<array<struct<s:int,e:int>>>"), "array", "no clusters without a resolver"),
    node("labeled_text_boxes", lambda of: F.zip_with(F.transform(of("text_box_elements"), lambda e: e["text"]), models.labels_of(F.transform(of("text_box_elements"), lambda e: e["text"])), lambda t, x: F.struct(t.alias("text"), F.array(x).alias("labels"))), "array<struct>", inputs=("text_box_elements",)),
    node("addresses", lambda of: F.transform(F.filter(of("labeled_text_boxes"), lambda b: F.array_contains(b["labels"], "address")), lambda b: b["text"]), "array<string>", inputs=("labeled_text_boxes",)),
    node("vector", lambda of: models.vector_of(of("full_text")), "array<float>", "vector of the text", ("full_text",), memo=True),
    # without page geometry there are no images, boxes or ruled tables; operators.tables has them for element rows
    *[node(n, lambda of: _empty("array<string>"), "array<string>") for n in ("table_candidates", "valid_tables", "table_areas", "table_context", "table_box_levels", "images")],
    *[node(n, lambda of: F.create_map().cast("map<string,string>"), "map<string,string>") for n in ("meta_pdf", "meta_pandoc", "pages_bbox")],
    node("table_df0", lambda of: of("tables_df"), "array<array<array<string>>>", inputs=("tables_df",)),
    node("urls", lambda of: F.regexp_extract_all(of("full_text"), F.lit(r"https?://[^\s<>\"]+"), 0), "array<string>", inputs=("full_text",)),
]

HTML = [
    node("page", lambda of: web.page(of("raw_content")), "struct", "all outputs of the parser at once", ("raw_content",), memo=True),
    node("full_text", lambda of: of("page")["main_content"], inputs=("page",)),
    *[node(n, lambda of, n=n: of("page")[n], k, inputs=("page",)) for n, k in (("title", "string"), ("short_title", "string"), ("main_content", "string"), ("urls", "array<string>"), ("pdf_links", "array<string>"), ("main_image", "string"))],
    node("schemadata", lambda of: of("page")["schema"], "array<string>", inputs=("page",)),
    node("language", lambda of: of("page")["lang"], inputs=("page",)),
    node("tables_df", lambda of: of("page")["tables"], "array<array<array<string>>>", inputs=("page",)),
    node("summary", lambda of: of("page")["description"], inputs=("page",)),
    node("final_urls", lambda of: F.array("source"), "array<string>"),
    node("titles", lambda of: F.array(of("title"), of("short_title")), "array<string>", inputs=("title", "short_title")),
    node("html_keywords", lambda of: of("page")["keywords"], "array<string>", inputs=("page",)),
    node("html_keywords_str", lambda of: F.array_join(of("html_keywords"), ","), inputs=("html_keywords",)),
    node("keywords", lambda of: F.filter(F.array_union(of("html_keywords"), of("textrank_keywords")), lambda x: F.trim(x) != ""), "array<string>", inputs=("html_keywords", "textrank_keywords")),
    node("goose_article", lambda of: of("page"), "struct", inputs=("page",)),
    node("main_content_clean_html", lambda of: web.clean_attributes(of("raw_content")), inputs=("raw_content",)),
]

DICT = [
    node("full_text", lambda of: of("raw_content"), inputs=("raw_content",)),
    node("items", lambda of: F.map_entries(F.from_json(of("raw_content"), "map<string,string>")), "array<struct>", inputs=("raw_content",)),
    node("keys", lambda of: F.map_keys(F.from_json(of("raw_content"), "map<string,string>")), "array<string>", inputs=("raw_content",)),
    node("values", lambda of: F.map_values(F.from_json(of("raw_content"), "map<string,string>")), "array<string>", inputs=("raw_content",)),
    node("flat", lambda of: structs.flatten_json(of("raw_content")), "map<string,string>", inputs=("raw_content",)),
]

LIST = [
    node("full_text", lambda of: F.array_join(F.from_json(of("raw_content"), "array<string>"), "\n\n"), inputs=("raw_content",)),
    node("items", lambda of: F.transform(F.from_json(of("raw_content"), "array<string>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))), "array<struct>", inputs=("raw_content",)),
]

#: PDF, image and word-processor documents need a converter that fills fobj with text or Markdown first.
PDF = [node("num_pages", lambda of: F.size(F.split(of("full_text"), "\f")).cast("bigint"), "bigint", inputs=("full_text",)), node("page_set", lambda of: F.sequence(F.lit(0), F.size(F.split(of("full_text"), "\f")) - 1), "array<int>", inputs=("full_text",))]
MARKDOWN = [node("sections", lambda of: F.filter(F.split(of("full_text"), r"(?m)^(?=#{1,6}\s)"), lambda s: F.trim(s) != ""), "array<string>", inputs=("full_text",)), node("clean_text", lambda of: F.regexp_replace(of("full_text"), r"(?m)^#{1,6}\s+|[*_`]{1,3}", ""), inputs=("full_text",))]

DOCUMENTS = Pipelines(
    {"*": GENERIC, "text/html": HTML, "<class 'dict'>": DICT, "<class 'list'>": LIST, "application/pdf": PDF, "pandoc": MARKDOWN, "image": [], "application/x-yaml": []},
    {
        "text/markdown": PANDOC, "text/rtf": PANDOC, "mediawiki": PANDOC, "application/epub+zip": PANDOC, DOCX: PANDOC, ODT: PANDOC, "application/x-yaml": ("<class 'dict'>",), "image": ("application/pdf",),
        "PIL.Image.Image": ("image", "application/pdf"), "image/png": ("image", "application/pdf"), "image/jpeg": ("image", "application/pdf"), "image/tiff": ("image", "application/pdf"),
    },
)
