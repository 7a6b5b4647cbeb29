"""Markdown, YAML and JSON sources."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import mapped
from ..functions.structs import normal

BLOCKS = T.ArrayType(T.StructType([T.StructField("boxnum", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("section", T.StringType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))]))
_HEAD, _ITEM, _RULE = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^\s{0,3}(?:[-*+]|\d+[.)])\s+(.*)$"), re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def blocks(text: str | None) -> list[dict]:
    """Headers, tables, lists and paragraphs of a Markdown text, with the running section title."""
    out: list[dict] = []
    section, lines, k = None, (text or "").splitlines(), 0

    def add(kind: str, body: str, level: int = 1, cells=None) -> None:
        out.append({"boxnum": len(out), "type": kind, "level": level, "text": body, "section": section, "cells": cells})

    row = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif line.lstrip().startswith(("```", "~~~")):
            fence, body = line.lstrip()[:3], []
            k += 1
            while k < len(lines) and not lines[k].lstrip().startswith(fence):
                body.append(lines[k])
                k += 1
            k += 1
            add("Text", "\n".join(body))
        elif m := _HEAD.match(line):
            section = m[2]
            add("Header", m[2], len(m[1]))
            k += 1
        elif "|" in line and k + 1 < len(lines) and _RULE.match(lines[k + 1]) and "|" in lines[k + 1]:
            cells = [row(line)]
            k += 2
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                cells.append(row(lines[k]))
                k += 1
            add("Table", "\n".join(" | ".join(r) for r in cells), cells=cells)
        elif _ITEM.match(line):
            items = []
            while k < len(lines) and lines[k].strip() and (_ITEM.match(lines[k]) or lines[k].startswith(" ")):
                m = _ITEM.match(lines[k])
                if m:
                    items.append(m[1])
                else:
                    items[-1] += " " + lines[k].strip()
                k += 1
            add("List", "\n".join(items))
        else:
            body = []
            while k < len(lines) and lines[k].strip() and not _HEAD.match(lines[k]) and not _ITEM.match(lines[k]):
                body.append(lines[k].strip())
                k += 1
            add("Text", " ".join(body))
    return out


def markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``blocks`` of its Markdown."""
    return df.withColumn("blocks", mapped(blocks, BLOCKS, text))


def yaml_data(df: DataFrame, text: str, name: str = "data") -> DataFrame:
    """``df`` with the YAML (or fenced YAML, or JSON) of a column as JSON text; null if it can't be read."""

    def one(s: str | None) -> str | None:
        import yaml

        if s is None:
            return None
        s = re.sub(r"^\s*```[a-zA-Z]*\n|\n?```\s*$", "", s)
        try:
            return json.dumps(normal(yaml.safe_load(s)), ensure_ascii=False)
        except Exception:  # noqa: BLE001  what can't be read is null
            return None

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return df.withColumn(name, run(text))


def to_yaml(df: DataFrame, columns: list[str], name: str = "yaml") -> DataFrame:
    """``df`` with some columns as one YAML text."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        import yaml

        return s.map(lambda x: yaml.safe_dump(json.loads(x), allow_unicode=True, sort_keys=False))

    return df.withColumn(name, run(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
