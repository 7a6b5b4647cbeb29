"""Lists, maps and JSON: flattening, selectors, normalising."""

from __future__ import annotations

import datetime
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_list(c: Column, is_array: bool = False) -> Column:
    """A scalar becomes a list of one, null an empty list."""
    return F.coalesce(c, F.array()) if is_array else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def flatten(c: Column, drop_blank: bool = True) -> Column:
    """One level of nesting less; nulls and blank strings dropped."""
    out = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return F.filter(out, lambda x: x.isNotNull() & (F.trim(x) != "")) if drop_blank else out


def flatten_unique(c: Column) -> Column:
    return F.array_distinct(flatten(c))


def unwrap(c: Column) -> Column:
    """The only item of a list of one, else null."""
    return F.when(F.size(c) == 1, F.element_at(c, 1))


def select(data: Column, *keys: str, **renamed: str) -> Column:
    """Values of a JSON object as a struct; missing ones are null."""
    return F.struct(*[F.get_json_object(data, f"$.{k}").alias(k) for k in keys], *[F.get_json_object(data, f"$.{old}").alias(new) for new, old in renamed.items()])


def merge_lists(a: Column, b: Column) -> Column:
    """Maps of lists: values of equal keys are appended."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def flat_items(data: Any, sep: str = ".", prefix: str = "") -> dict[str, Any]:
    """Nested maps as dotted keys; empty maps vanish, lists stay values."""
    if isinstance(data, dict):
        out: dict[str, Any] = {}
        for k, v in data.items():
            out |= flat_items(v, sep, f"{prefix}{sep}{k}" if prefix else str(k))
        return out
    return {prefix: data}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(data: pd.Series) -> pd.Series:
    def one(s: str | None) -> dict | None:
        try:
            return {k: v if isinstance(v, str) else json.dumps(v) for k, v in flat_items(json.loads(s)).items()} if s else None
        except ValueError:
            return None

    return data.map(one)


def normal(x: Any) -> Any:
    """Plain values for export: bytes decoded, times as ISO seconds, numbers kept, sets as lists."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, (datetime.datetime, datetime.time)):
        return x.isoformat(timespec="seconds")
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, pd.DataFrame):
        return [normal(r) for r in x.to_dict("records")]
    if isinstance(x, dict):
        return {str(k): normal(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return normal(x.asDict())
    if isinstance(x, (list, tuple)):
        return [normal(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((normal(v) for v in x), key=str)
    if hasattr(x, "__dataclass_fields__"):
        return {k: normal(getattr(x, k)) for k in x.__dataclass_fields__}
    return str(x)


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def unit_float(c: Column) -> Column:
    """A string's place in [0, 1) by its md5 (of 48 bits)."""
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
