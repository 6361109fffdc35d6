"""Nested JSON cells rewritten at every depth by one projection: no shuffle, no Python worker.

A cell is put into the form that VARIANT gives, without spaces and with its keys in order of code points; rules then replace
what they find between its strings, in one pass of a pattern over the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deeper cells raise an error; patterns find the end of objects of so many levels.
DEEPEST = 40

#: Makes a JSON text of another, which has no spaces between its parts; null stays null.
Rule = Callable[[Column], Column]

#: A string from behind its first quotation mark. Patterns repeat possessively: Java then loops instead of calling itself,
#: so that long cells need no deep stack, and each character is passed once.
_STRING = r'(?:[^"\\]++|\\.)*+"'


def _object(levels: int) -> str:
    """Pattern of an object that holds others, so many levels in all."""
    inner = f"|{_object(levels - 1)}" if levels > 1 else ""
    return rf'\{{(?:[^{{}}"]++|"{_STRING}{inner})*+\}}'


#: A pattern goes on where its last match ended, and takes what stays as it is as its first group.
_EMPTY = rf'\G((?:[^"{{]++|\{{(?!\}})|"{_STRING})*+)\{{\}}'
_SINGLE = rf'\G((?:[^"]++|"(?!depends_on":[^\[]){_STRING})*+)"depends_on":(?:null|([^"\[{{][^,}}\]]*+|"{_STRING}|{_object(DEEPEST)}))'


def nesting(cell: Column) -> Column:
    """How many brackets are open at once, at most, in a JSON text; those in strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(cell, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    step = lambda acc, c: F.struct(
        (acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), zero, step, lambda acc: acc["most"])


def empty_as_null(text: Column) -> Column:
    """Empty objects become null."""
    return F.regexp_replace(text, _EMPTY, "$1null")


def depends_as_list(text: Column) -> Column:
    """``depends_on`` becomes a list: of nothing for null, of the value if it is none."""
    # A single value is taken as it is, also where it is an object; for null the second group is empty.
    return F.regexp_replace(text, _SINGLE, '$1"depends_on":[$2]')


def rewritten(df: DataFrame, cell: str, *rules: Rule) -> DataFrame:
    """``df`` with the JSON texts of a column rewritten by rules, one after the other; what does not parse stays.

    One pass looks for cells that are too deep; only those with more brackets than levels are looked into."""
    opened = F.length(cell) - F.length(F.replace(F.replace(F.col(cell), F.lit("[")), F.lit("{")))
    deep = F.when(opened > DEEPEST, F.when(F.try_parse_json(cell).isNotNull(), nesting(F.col(cell))))
    depth = df.agg(F.max(deep)).first()[0] or 0
    if depth > DEEPEST:
        raise ValueError(f"cells of {depth} levels; at most {DEEPEST} are rewritten")
    for rule in rules:
        df = df.withColumn(cell, F.coalesce(rule(F.to_json(F.try_parse_json(cell))), F.col(cell)))
    return df


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A column in which JSON has a form for everything, at any depth of its type.

    Keys of maps become strings, numbers that are not finite null, bytes hexadecimal digits, and what JSON has
    no form for (dates, times, intervals) its text."""
    if isinstance(kind, T.StructType):
        fields = [json_safe(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(json_safe(e["key"], kind.keyType).cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DecimalType, T.VariantType, T.NullType)):
        return value
    return value.cast("string")


def json_text(df: DataFrame, column: str) -> Column:
    """JSON text of a column of any type, at any depth."""
    kind = df.schema[column].dataType
    safe = json_safe(F.col(column), kind)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(safe, {"ignoreNullFields": "false"})
    listed = F.to_json(F.array(safe))
    return F.when(F.col(column).isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))
