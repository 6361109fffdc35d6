"""Loosely typed JSON cells, as Column expressions. A cell is JSON text or a VARIANT.

What Spark does not parse (bad JSON, NaN, duplicate keys) counts as unparsable."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(cell: Column) -> Column:
    """VARIANT of JSON text; null where it does not parse."""
    return F.try_parse_json(cell)


def kind(cell: Column) -> Column:
    """object, array, string, number, boolean, null or invalid, of JSON text."""
    shape = F.schema_of_variant(parsed(cell))
    return (
        F.when(shape.isNull(), F.lit("invalid"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .when(shape.startswith("STRING"), F.lit("string"))
        .when(shape.startswith("BOOLEAN"), F.lit("boolean"))
        .when(shape.startswith("VOID"), F.lit("null"))
        .otherwise(F.lit("number"))
    )


def ensure_object(cell: Column) -> Column:
    """The cell where it is a JSON object, else ``{}``."""
    return F.when(kind(cell) == "object", cell).otherwise(F.lit("{}"))


def ensure_array(cell: Column) -> Column:
    """Items, as JSON texts, of a JSON list; empty for anything else."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(kind(cell) == "array", F.from_json(cell, "array<string>")), empty)


def coerced(cell: Column) -> Column:
    """JSON where it parses, blank and bad text as it is."""
    return F.coalesce(F.to_json(parsed(cell)), cell)


def openai_tools(cell: Column) -> Column:
    """Tools in the OpenAI form as JSON texts: kept where they have it, wrapped where they have a name, else dropped."""

    def one(item: Column) -> Column:
        name = F.get_json_object(item, "$.name")
        wrapped = F.to_json(
            F.struct(
                F.lit("function").alias("type"),
                F.struct(
                    name.alias("name"),
                    F.coalesce(F.get_json_object(item, "$.description"), F.lit("")).alias("description"),
                    F.coalesce(F.try_parse_json(F.get_json_object(item, "$.parameters")), F.parse_json(F.lit("{}"))).alias("parameters"),
                ).alias("function"),
            )
        )
        openai = (F.get_json_object(item, "$.type") == "function") & F.get_json_object(item, "$.function").startswith("{")
        return F.when(openai, item).when(name.isNotNull(), wrapped)

    return F.filter(F.transform(tool_items(cell), one), lambda t: t.isNotNull())


def tool_items(cell: Column) -> Column:
    """A list's items, an object alone, nothing else; as JSON texts."""
    return F.when(kind(cell) == "object", F.array(cell)).otherwise(ensure_array(cell))


def tool_list(cell: Column) -> Column:
    """Tools as texts: nothing for null, a list's items, anything else alone."""
    empty = F.array().cast("array<string>")
    return F.when(cell.isNull(), empty).when(kind(cell) == "array", ensure_array(cell)).otherwise(F.array(cell))


@F.pandas_udf(T.ArrayType(T.StringType()))
def dumped_items(cells: pd.Series) -> pd.Series:
    """Items of each JSON list: strings as they are, others with the usual separators and ASCII escapes."""
    one = lambda cell: [t if isinstance(t, str) else json.dumps(t) for t in json.loads(cell)] if cell else []
    return cells.map(one)


def tool_texts(cell: Column) -> Column:
    """``tool_list`` with a list's items as the prompt shows them."""
    items = F.when(kind(cell) == "array", cell)
    return F.when(items.isNotNull(), dumped_items(items)).otherwise(tool_list(cell))


def tool_prompt(tools: Column) -> Column:
    """Tools between quotes of blanks, with a blank line between."""
    return F.array_join(F.transform(tools, lambda t: F.concat(F.lit('" '), t, F.lit(' "'))), "\n\n")


def tool_names(cell: Column) -> Column:
    """Sorted distinct names of tools in either form."""
    name = lambda t: F.trim(F.coalesce(F.get_json_object(t, "$.function.name"), F.get_json_object(t, "$.name"), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tool_items(cell), name), lambda n: n != "")))


def flat_tool_names(tools: Column) -> Column:
    """Top-level names alone, as the alignment score reads them: the OpenAI form has an empty one."""
    good = F.filter(tools, lambda t: kind(t) == "object")
    return F.array_distinct(F.transform(good, lambda t: F.trim(F.coalesce(F.get_json_object(t, "$.name"), F.lit("")))))


def coalesce_tools(first: Column, second: Column) -> Column:
    """The first tool list unless it is empty."""
    return F.when(F.size(ensure_array(first)) > 0, first).otherwise(second)


def coalesce_messages(extra: Column, nested: Column, plain: Column, prompt: Column) -> Column:
    """The first message list that is not empty."""
    pick = lambda c: F.when(F.size(ensure_array(c)) > 0, c)
    return F.coalesce(pick(extra), pick(nested), pick(plain), pick(prompt))


def checklists(extra: Column) -> Column:
    return ensure_array(F.get_json_object(extra, "$.interaction_kwargs.checklist_list"))


#: Reward fields that a row without reward leaves out.
REWARD_FIELDS = (
    "when2call_annotations",
    "use_uq_reward",
    "uq_target_type",
    "uq_target_action",
    "uq_target_letter",
    "gt_letter",
    "chosen_response",
    "rejected_response",
)


def without_keys(cell: Column, keys: tuple[str, ...] = REWARD_FIELDS) -> Column:
    """An object's JSON text without some keys; anything else, and an empty object, as it is."""
    fields = F.from_json(F.to_json(parsed(cell)), "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*keys))
    return F.when((kind(cell) == "object") & (F.size(fields) > 0), F.to_json(kept)).otherwise(cell)


def normalized_depends(value: Column) -> Column:
    """A list from null, one value, or a list, in JSON text."""
    empty = F.array().cast("array<string>")
    shape = kind(value)
    return F.when(value.isNull() | (shape == "null"), empty).when(shape == "array", ensure_array(value)).otherwise(F.array(value))


@F.pandas_udf(T.StringType())
def without_empty_objects(cells: pd.Series) -> pd.Series:
    """JSON text with empty objects as null at any depth, and ``depends_on`` as a list at any depth."""

    def walk(x, key=None):
        if key == "depends_on":
            x = [] if x is None else x if isinstance(x, list) else [x]
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()} or None
        return [walk(v) for v in x] if isinstance(x, list) else x

    def one(cell):
        try:
            return json.dumps(walk(json.loads(cell)), ensure_ascii=False)
        except (TypeError, ValueError):
            return cell

    return cells.map(one)


@F.pandas_udf(T.StringType())
def rendered_tool_calls(texts: pd.Series) -> pd.Series:
    """All tool calls of each text as blocks with sorted keys and the usual separators; empty without any."""
    import re

    block = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S | re.I)

    def load(s):
        try:
            return json.loads(s)
        except ValueError:
            return None

    def call(item):
        if not isinstance(item, dict):
            return None
        fn = item["function"] if isinstance(item.get("function"), dict) else item
        args = fn.get("arguments", {})
        args = load(args) if isinstance(args, str) else args
        name = str(fn.get("name") or "").strip()
        return {"name": name, "arguments": args if isinstance(args, dict) else {}} if name else None

    def one(text):
        found = [load(b) for b in block.findall(text or "")]
        calls = [call(x) for f in found for x in (f if isinstance(f, list) else [f])]
        return "\n".join(f"<tool_call>\n{json.dumps(c, ensure_ascii=False, sort_keys=True)}\n</tool_call>" for c in calls if c)

    return texts.map(one)


@F.pandas_udf(T.StringType())
def tool_surface(texts: pd.Series) -> pd.Series:
    """Calls of the text's blocks, else of the text itself as JSON, as blocks; the stripped text without calls."""

    def one(text):
        text = text or ""
        raw = text if "<tool_call>" in text.lower() else f"<tool_call>{text}</tool_call>"
        return rendered_tool_calls.func(pd.Series([raw]))[0] or text.strip()

    return texts.map(one)


@F.pandas_udf(T.StringType())
def object_in_text(texts: pd.Series) -> pd.Series:
    """The JSON object in a model's reply: the whole text, else a fenced block (last first), else the last braces that are one.

    Braces are tried from the right, so that of an object inside another the inner one counts. When a brace is tried, none to
    its right was an object; one with another brace in it is therefore none, either, and each try ends at the next
    brace outside a string: the work is linear in the text."""
    import re

    fence = re.compile(r"```(?:\s*json)?\s*(.*?)\s*```", re.S | re.I)
    flat = re.compile(r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*+")*+\}', re.S)

    def as_object(s):
        try:
            v = json.loads(s)
        except (ValueError, RecursionError):
            return None
        if isinstance(v, list):
            v = next((x for x in reversed(v) if isinstance(x, dict)), None)
        return v if isinstance(v, dict) else None

    def tries(text):
        yield text
        yield from (t.strip() for t in reversed(fence.findall(text)))
        at = text.rfind("{")
        while at >= 0:
            if m := flat.match(text, at):
                yield m[0]
            at = text.rfind("{", 0, at)

    def one(text):
        found = next((v for t in tries((text or "").strip()) if (v := as_object(t)) is not None), None)
        return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)

    return texts.map(one)
