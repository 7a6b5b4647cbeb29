"""Text columns: ratios, words, pages, segments, Markdown and list tests, n-gram features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ten signs of Markdown; a text with three of them counts as Markdown.
MARKDOWN = {
    "emphasis": r"\*{1,2}[^*]+\*{1,2}",
    "heading": r"#{1,6}\s",
    "link": r"\[.*\]\(.*\)",
    "image": r"!\[.*\]\(.*\)",
    "code": r"`[^`]+`",
    "quote": r"^\s{0,3}>\s",
    "bullet": r"^\s{0,3}[-*+]\s",
    "number": r"^\s{0,3}\d+\.\s",
    "fence": r"^\s{0,3}(```|~~~)",
    "rule": r"\*\*\*|---|___",
}


def letter_ratio(text: Column) -> Column:
    """Letters over letters and digits; 0.5 without either."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return F.when(letters + digits > 0, letters / (letters + digits)).otherwise(F.lit(0.5))


def words(text: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def num_words(text: Column) -> Column:
    return F.size(words(text))


def num_pages(text: Column) -> Column:
    """One page for each begun thousand characters."""
    return F.lit(1) + F.floor(F.length(text) / 1000)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside lambdas a plain column is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_pages(text: Column, size: int = 500) -> Column:
    """Array of pages of ``size`` words."""

    def cut(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(w, k * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return once(words(text), cut)


def markdown_signs(text: Column) -> Column:
    """How many of the ten signs the text has."""
    out = F.lit(0)
    for p in MARKDOWN.values():
        out = out + text.rlike("(?m)" + p).cast("int")
    return out


def contains_markdown(text: Column) -> Column:
    return markdown_signs(text) >= 3


def is_list_line(line: Column) -> Column:
    """A bullet line, unless it is a temperature such as "-20 °C"."""
    return F.trim(line).rlike(r"^[-*∙•](?![\d-]+\s?(?:[°˚][CKF]?|[℃℉]))")


def elements(text: Column) -> Column:
    """Text boxes: the parts between blank lines, empty ones too."""
    return F.transform(F.split(text, "\n\n"), lambda t, i: F.struct(i.cast("int").alias("boxnum"), t.alias("text"), F.lit(0).alias("p_num"), F.lit(1).alias("level")))


def segments(text: Column, min_size: int = 256, max_size: int = 512, overlap: float = 0.3, most: int | None = 100) -> Column:
    """Pieces of text for an index, as one native fold over the paragraphs.

    Paragraphs are gathered until a segment has ``min_size`` characters; the next one is added still,
    and what exceeds ``max_size`` is cut into overlapping windows. The fold stops once there are
    more than ``most`` pieces (None: never); the rest of an open segment is a piece of its own, uncut.
    """
    step = int((1 - overlap) * max_size)
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"), F.lit(False).alias("stop"))

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda k: F.btrim(F.substring(s, k + 1, F.lit(max_size)), F.lit(" \t\n\r\x0b\x0c")))

    def fold(acc: Column, part: Column) -> Column:
        full = F.concat(acc["open"], part)
        pieces = F.when(F.length(full) > max_size, cut(full)).otherwise(F.array(F.btrim(full, F.lit(" \t\n\r\x0b\x0c"))))
        done = F.concat(acc["done"], pieces)
        grown = F.struct(F.concat(acc["open"], part, F.lit("\n\n")).alias("open"), acc["done"].alias("done"), F.lit(False).alias("stop"))
        closed = F.struct(F.lit("").alias("open"), done.alias("done"), (F.lit(False) if most is None else F.size(done) > most).alias("stop"))
        return F.when(acc["stop"], acc).when(F.length(acc["open"]) < min_size, grown).otherwise(closed)

    def end(acc: Column) -> Column:
        rest = F.btrim(acc["open"], F.lit(" \t\n\r\x0b\x0c"))
        return F.when(rest != "", F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(F.split(text, "\n\n"), zero, fold, end)


def bigram_features(text: Column, k: int = 5) -> Column:
    """The ``k`` highest counts of character pairs, ascending, padded with 0 (null for null).

    Pairs are sorted, and counts are the distances between the places where runs of equal pairs begin.
    """

    def pairs(chars: Column) -> Column:
        n = F.size(F.filter(chars, lambda c: c != ""))
        return F.when(n > 1, F.sort_array(F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.concat(a, b)))).otherwise(F.array().cast("array<string>"))

    def counts(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(F.array().cast("array<int>"))
        return once(F.filter(places, lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))), lambda heads: F.zip_with(heads, F.concat(F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), F.when(F.size(heads) > 0, F.array(F.size(ordered) + 1)).otherwise(F.array().cast("array<int>"))), lambda a, b: b - a))

    runs = once(F.split(F.lower(text), ""), lambda chars: once(pairs(chars), counts))
    return F.sort_array(F.slice(F.sort_array(F.concat(runs, F.array_repeat(F.lit(0), k)), asc=False), 1, k))


def block_features(text: Column) -> dict[str, Column]:
    """Hand-made features of a text block: counts by length, and length itself."""
    n = F.length(text) + F.lit(1e-4)
    count = lambda p: F.length(F.regexp_replace(text, p, "")) / n
    return {"newlines": count("[^\n]"), "spaces": count("[^ ]"), "digits": count("[^0-9]"), "size": F.length(text) / F.lit(2000.0)}


def context(text: Column, start: Column, end: Column, size: int = 100) -> Column:
    """(before, token, after) around a character span."""
    return F.struct(
        F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size))).alias("before"),
        F.substring(text, start + 1, end - start).alias("token"),
        F.substring(text, end + 1, F.lit(size)).alias("after"),
    )


def graph_label(text: Column, size: int = 1000) -> Column:
    """Text made safe as a graph label: escaped, ASCII only, cut, never empty."""
    out = F.replace(text, F.lit("\n"), F.lit("<br/>"))
    for sign, put in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\f", "\\f"), ("{", "\\{"), ("}", "\\}"), ("|", "\\|"), ('"', "&quot;"), ("[", "\\["), ("]", "\\]")):
        out = F.replace(out, F.lit(sign), F.lit(put))
    out = F.substring(F.regexp_replace(out, "[^ -~]+", ""), 1, size)
    return F.when(F.trim(out) == "", F.lit("<empty>")).otherwise(out)


def strip_fences(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\n", ""), r"\n?```\s*$", "")


def extractive_summary(text: Column, sentences: int = 3) -> Column:
    """The first sentences: the default where no summariser is plugged in."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.array_join(F.slice(parts, 1, sentences), " ")
