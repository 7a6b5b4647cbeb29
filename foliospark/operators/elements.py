"""Document elements: boxes from lines, sections, templates, contexts, lists, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ELEMENT_TYPES
from .geometry import contained


def ordered_text(order: list[Column], text: Column, sep: str = "") -> Column:
    """Aggregate: texts joined in an explicit order."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["t"]), sep)


def group_boxes(lines: DataFrame, keys: tuple[str, ...] = ("p_num", "boxnum"), order: str = "linenum", text: str = "rawtext") -> DataFrame:
    """Text boxes from lines: union box and joined text; blank ones are dropped."""
    out = lines.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.btrim(ordered_text([F.col(order)], F.col(text)), F.lit(" \n\t\r")).alias("text"))
    return out.filter("text <> ''")


def sections(elements: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Text of each section, in the order of its first box."""
    e = elements.withColumn("section", F.explode("sections"))
    return e.groupBy(*keys, "section").agg(ordered_text([F.col("boxnum")], F.col("rawtext")).alias("text"), F.min("boxnum").alias("first"))


def of_type(elements: DataFrame, *types: str) -> DataFrame:
    return elements.filter(F.col("type").isin(*types))


def known_types(names: Column) -> Column:
    """Names that are element types; others are dropped."""
    return F.array_intersect(names, F.array(*[F.lit(t) for t in ELEMENT_TYPES]))


def placeholder(labels: bool = False) -> Column:
    base = F.concat_ws("_", F.col("type"), F.col("id").cast("string"))
    if labels:
        known = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x != "unknown")
        base = F.concat(base, F.when(F.size(known) > 0, F.concat(F.lit(":"), F.array_join(known, ","))).otherwise(F.lit("")))
    return F.concat(F.lit("{"), base, F.lit("}"))


def page_template(objects: DataFrame, listed: tuple[str, ...] = (), include: bool = False, labels: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Text of each page with placeholders for the element types that aren't allowed.

    ``listed`` are the allowed types with ``include``, else the ones left out. Upright text boxes of one
    letter and vertical elements are dropped; the order is down the page, then from left to right."""
    allowed = set(listed) if include else set(ELEMENT_TYPES) - set(listed)
    kept = objects.filter("coalesce(mean_char_orientation, 0) <> 90 and (length(coalesce(text, '')) > 1 or type <> 'TextBox')")
    shown = F.when(F.col("type").isin(*allowed) & (F.coalesce("text", F.lit("")) != ""), F.col("text")).otherwise(placeholder(labels))
    return kept.groupBy(*keys, "p_num").agg(ordered_text([F.col("p_num"), -F.col("y0"), F.col("x0"), F.col("id")], shown, "\n\n").alias("template"))


def area_context(elements: DataFrame, areas: DataFrame, group: list[str], margin: float = 20) -> DataFrame:
    """Text around each area: elements within the margin but not in the area itself, in page order."""
    a, b = elements.alias("a"), areas.alias("b")
    near = a.join(b, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [contained(tol=margin) & ~contained(tol=0)])
    return near.groupBy(*[F.col(f"b.{g}").alias(g) for g in group], F.col("b.id").alias("area")).agg(ordered_text([-F.col("a.y0"), F.col("a.x0"), F.col("a.id")], F.col("a.text"), "\n").alias("context"))


def document_objects(elements: DataFrame, boxes: DataFrame, tables: DataFrame, group: list[str]) -> DataFrame:
    """Elements that aren't text or graphics, text boxes and tables; what lies in a table is left out.

    ``id`` is the position within the group."""
    both = elements.filter("type not in ('Text', 'Graphic')").unionByName(boxes, allowMissingColumns=True)
    a, b = both.alias("a"), tables.alias("b")
    free = a.join(b, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [contained(tol=10)], "left_anti")
    out = free.unionByName(tables.withColumn("type", F.lit("Table")), allowMissingColumns=True)
    w = Window.partitionBy(*[g for g in group if g != "p_num"]).orderBy("p_num", F.col("y0").desc(), "x0", "type", "text") if [g for g in group if g != "p_num"] else Window.partitionBy("p_num").orderBy(F.col("y0").desc(), "x0", "type", "text")
    return out.withColumn("id", (F.row_number().over(w) - 1).cast("int"))


def titles(lines: DataFrame, keys: list[str], size: str = "font_size", text: str = "text") -> DataFrame:
    """Title lines: short lines whose font is an outlier. The rule is deterministic: a size above the
    median by two mean deviations, fewer than ten words, and at least the 75 % quantile of such lines."""
    stat = lines.groupBy(*keys).agg(F.percentile(size, 0.5).alias("_m"), F.percentile(size, 0.75).alias("_q"))
    dev = lines.join(stat, keys).withColumn("_d", F.abs(F.col(size) - F.col("_m")))
    spread = dev.groupBy(*keys).agg(F.avg("_d").alias("_s"))
    far = dev.join(spread, keys).filter((F.col(size) > F.col("_m") + 2 * F.col("_s")) & (F.size(F.split(F.trim(text), r"\s+")) < 10))
    top = far.groupBy(*keys).agg(F.percentile(size, 0.75).alias("_t"))
    return far.join(top, keys).withColumn("kind", F.when(F.col(size) >= F.col("_t"), F.lit("title")).when(F.col(size) > F.col("_q"), F.lit("side_title"))).filter("kind is not null").drop("_m", "_q", "_d", "_s", "_t")
