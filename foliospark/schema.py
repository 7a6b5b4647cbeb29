"""Row types of documents, elements and fonts."""

from __future__ import annotations

from pyspark.sql import types as T

ELEMENT_TYPES = ("Graphic", "Text", "Image", "Table", "TextBox", "List", "Header", "Figure")

FONT = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("color", T.StringType())])


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "ad": T.ArrayType(T.DoubleType()), "f": T.ArrayType(FONT)}
    return [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())]


#: The 26 fields of an element.
ELEMENT = T.StructType(
    _fields(
        "type:s labels:as p_num:i x0:d y0:d x1:d y1:d i0:i i1:i rawtext:s text:s sections:as char_orientations:ad mean_char_orientation:d "
        "font_infos:f linenum:i linewidth:d boxnum:i obj:s non_stroking_color:s stroking_color:s stroke:b fill:b evenodd:i level:i id:i"
    )
)

DOCUMENT = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("fobj", T.StringType()), T.StructField("document_type", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
)
