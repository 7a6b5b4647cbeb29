"""URLs, HTML and document types as native columns; a parser where structure is needed."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_url(u: Column) -> Column:
    """Scheme and host are both there."""
    return u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")


def url_parts(u: Column) -> dict[str, Column]:
    return {
        "scheme": F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1),
        "host": F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
        "path": F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(u, r"\?([^#]*)", 1),
        "fragment": F.regexp_extract(u, r"#(.*)$", 1),
    }


def pdf_file_name(u: Column) -> Column:
    """File name of a URL ending in pdf, with the last two digits of the URL's md5; else null."""
    path = url_parts(u)["path"]
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.lower(F.right(path, F.lit(3))) == "pdf", F.concat(F.substring(name, F.lit(1), F.length(name) - 3), F.right(F.md5(u), F.lit(2)), F.lit(".pdf")))


def collapse_slashes(u: Column) -> Column:
    """Without double slashes; those of the scheme stay."""
    head = F.when(F.left(u, F.lit(4)) == "http", F.substring(u, 1, 7)).otherwise(F.lit(""))
    return F.concat(head, F.replace(F.substring(u, F.length(head) + 1, F.length(u)), F.lit("//"), F.lit("/")))


def absolute_path(u: Column, path: Column) -> Column:
    """The path, if it is a URL itself; else the URL with its path replaced."""
    p = url_parts(u)
    tail = F.concat(F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")), F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")))
    return F.when(path.startswith("http"), path).otherwise(F.concat(p["scheme"], F.lit("://"), p["host"], F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), tail))


def links(html: Column) -> Column:
    """href values of the anchors."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)


def pdf_links(html: Column) -> Column:
    return F.filter(links(html), lambda h: F.lower(h).endswith(".pdf"))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def strip_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space runs become one blank."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_attributes(html: Column) -> Column:
    """Without class, id, name and style attributes."""
    return F.regexp_replace(html, r'(?i)\s(?:class|id|name|style)="[^"]*"', "")


def text_density(html: Column) -> Column:
    return F.length(strip_html(html)) / F.length(html)


def markup_type(text: Column) -> Column:
    """text/html by doctype, application/xml by declaration, else unknown."""
    return F.when(text.rlike(r"(?is)<!DOCTYPE html.*?>"), F.lit("text/html")).when(text.rlike(r"(?is)<\?xml.*?\?>"), F.lit("application/xml")).otherwise(F.lit("unknown"))


def xml_type(text: Column) -> Column:
    return F.when(text.rlike(r'(?is)<mediawiki xmlns="http://www.mediawiki.org/xml/export-.*?"'), F.lit("mediawiki")).otherwise(F.lit("application/xml"))


EXTENSIONS = {
    "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "rtf": "text/rtf", "json": "application/json", "xml": "application/xml",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text", "epub": "application/epub+zip",
    "yaml": "application/x-yaml", "yml": "application/x-yaml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff",
}
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "7B5C727466": "text/rtf", "504B0304": "application/zip"}


def type_by_name(path: Column) -> Column:
    """Type by the file's extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def type_by_magic(content: Column) -> Column:
    """Type by the first bytes, null if unknown."""
    head, out = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for sign, kind in MAGIC.items():
        out = F.coalesce(out, F.when(head.startswith(sign), F.lit(kind)))
    return out


def type_of_text(text: Column, markdown: Column) -> Column:
    """Type of a string by its content: HTML by doctype, then mediawiki or XML for any other
    markup, RTF, Markdown, plain text; null is UNKNOWN."""
    tagged = text.rlike(r"(?is)^\s*<(?:\?xml|[a-z][^>]*>)")
    return (
        F.when(text.isNull(), F.lit("UNKNOWN"))
        .when(markup_type(text) == "text/html", F.lit("text/html"))
        .when((markup_type(text) == "application/xml") | tagged, xml_type(text))
        .when(text.startswith("{\\rtf"), F.lit("text/rtf"))
        .when(markdown, F.lit("text/markdown"))
        .otherwise(F.lit("text/plain"))
    )


class _Page(HTMLParser):
    """Collects title, text blocks, lists, tables, links, images, meta tags and ld+json."""

    SKIP, BLOCK = {"script", "style", "noscript", "template"}, {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "table", "tr", "br", "title", "nav", "header", "footer"}
    #: A list item is a mere link if its first text child is blank and it holds one of these.
    FORBIDDEN = {"a", "button", "svg", "form", "input"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.in_title, self.blocks, self.now = 0, "", False, [], []
        self.urls, self.images, self.meta, self.schema, self.tables, self.lists = [], [], {}, [], [], []
        self.items, self.row, self.lang, self.ld = [], None, "", None
        self.article, self.main = 0, []

    def flush(self):
        t = " ".join("".join(self.now).split())
        if t:
            self.blocks.append(t)
            if self.article:
                self.main.append(t)
        self.now = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
            if tag == "script" and a.get("type") == "application/ld+json":
                self.ld = []
        if tag in self.BLOCK:
            self.flush()
        if tag == "html":
            self.lang = a.get("lang") or ""
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href"):
            self.urls.append(a["href"])
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"])
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.meta[(a.get("name") or a["property"]).lower()] = a.get("content") or ""
        elif tag in ("article", "main"):
            self.article += 1
        elif tag == "ul":
            self.lists.append([])
        elif tag == "li":
            self.items.append({"text": [], "first": None, "linked": False})
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.row = []
        if self.items and tag in self.FORBIDDEN:
            self.items[-1]["linked"] = True
            if self.items[-1]["first"] is None:
                self.items[-1]["first"] = ""

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
            if tag == "script" and self.ld is not None:
                self.schema.append("".join(self.ld))
                self.ld = None
        if tag in self.BLOCK:
            self.flush()
        if tag == "title":
            self.in_title = False
        elif tag in ("article", "main") and self.article:
            self.article -= 1
        elif tag == "li" and self.items:
            item = self.items.pop()
            text = " ".join("".join(item["text"]).split())
            if text and self.lists and not (item["linked"] and not (item["first"] or "").strip()):
                self.lists[-1].append(text)
        elif tag in ("td", "th") and self.row is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(" ".join("".join(self.row).split()))
            self.row = None

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        if self.skip:
            return
        if self.in_title:
            self.title += data
            return
        self.now.append(data)
        if self.row is not None:
            self.row.append(data)
        if self.items:
            if self.items[-1]["first"] is None:
                self.items[-1]["first"] = data
            self.items[-1]["text"].append(data)


_S, _L = T.StringType(), T.ArrayType(T.StringType())
PAGE = T.StructType(
    [T.StructField(n, k) for n, k in (("title", _S), ("short_title", _S), ("main_content", _S), ("text_blocks", _L), ("urls", _L), ("pdf_links", _L), ("main_image", _S), ("keywords", _L), ("description", _S), ("lang", _S), ("schema", _L), ("lists", T.ArrayType(_L)), ("tables", T.ArrayType(T.ArrayType(_L))))]
)


def parse_page(html: str | None) -> dict:
    """All outputs of a page at once; a page that can't be parsed has empty ones."""
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
        p.flush()
    except Exception:  # noqa: BLE001  malformed input is a result, not an error
        p = _Page()
    whole = " ".join(p.title.split())
    keys = [k.strip() for k in p.meta.get("keywords", "").split(",") if k.strip()]
    schema = []
    for s in p.schema:
        try:
            schema.append(json.dumps(json.loads(s), sort_keys=True))
        except ValueError:
            pass
    return {
        "title": whole, "short_title": whole.split(" | ")[0].split(" - ")[0], "main_content": "\n\n".join(p.main or p.blocks), "text_blocks": p.blocks, "urls": p.urls,
        "pdf_links": [u for u in p.urls if u.lower().endswith(".pdf")], "main_image": p.meta.get("og:image") or (p.images[0] if p.images else None), "keywords": list(dict.fromkeys(keys)),
        "description": p.meta.get("description"), "lang": p.lang[:2].lower(), "schema": schema, "lists": [x for x in p.lists if x], "tables": [[r for r in t if r] for t in p.tables],
    }


@F.pandas_udf(PAGE)
def page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h) for h in html], columns=list(parse_page("")))
