"""Nested cells against plain Python."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwright.functions import nested
from turnwright.functions import uncertainty as uq


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, 3, -1.5, "", 'a"\\\n{', "{}", [], {}, "é"])
    if kind < 0.6:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: tree(rng, depth - 1) for k in rng.sample(["a", "b", "depends_on", 'q"', "z z"], rng.randrange(1, 4))}


def without_empty(x):
    if isinstance(x, dict):
        return {k: without_empty(v) for k, v in x.items()} if x else None
    return [without_empty(v) for v in x] if isinstance(x, list) else x


def with_lists(x):
    if isinstance(x, dict):
        one = lambda v: [] if v is None else [with_lists(y) for y in v] if isinstance(v, list) else [v]
        return {k: one(v) if k == "depends_on" else with_lists(v) for k, v in x.items()}
    return [with_lists(v) for v in x] if isinstance(x, list) else x


def test_cells_are_rewritten_at_every_depth(spark):
    rng = random.Random(7)
    trees = [tree(rng, 6) for _ in range(150)] + [{"depends_on": {"depends_on": None, "e": {}}}, {"a": {"b": {"c": {"d": {"e": {"f": {"depends_on": {}}}}}}}}]
    texts = [json.dumps(t, ensure_ascii=False) for t in trees] + ["broken {", "", '{"a":1,"a":2}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cell string")
    out = nested.rewritten(df, "cell", nested.depends_as_list, nested.empty_as_null)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = [r.cell for r in out.orderBy("i").collect()]
    assert [json.loads(g) for g in got[: len(trees)]] == [without_empty(with_lists(t)) for t in trees]
    assert got[len(trees) :] == ["broken {", "", '{"a":1,"a":2}', None]
    depth = [r.n for r in df.select("i", nested.nesting(F.col("cell")).alias("n")).orderBy("i").collect()][: len(trees)]
    deep = lambda x: 1 + max([deep(v) for v in (x.values() if isinstance(x, dict) else x)], default=0) if isinstance(x, (dict, list)) else 0
    assert depth == [deep(t) for t in trees] and max(depth) >= 6
    with pytest.raises(ValueError, match="levels"):
        nested.rewritten(spark.createDataFrame([("[" * 60 + "]" * 60,)], "cell string"), "cell", nested.empty_as_null)
    assert nested.rewritten(df.where("false"), "cell", nested.empty_as_null).count() == 0


def test_cells_are_rewritten_by_compiled_code(spark):
    """One parse a rule and no lambda functions, which Spark interprets; what looks like a rule's place in a string stays."""
    look = {"a": "depends_on", "b": '"depends_on":null{}', 'x"depends_on': None, "depends_on ": {}, "c": '\\"' * 100_000}
    deep = {"e": {}}
    for _ in range(nested.DEEPEST - 3):
        deep = {"k": deep}
    trees = [look, {"depends_on": deep}, [{"depends_on": [{"depends_on": "x"}, None, {}]}] * 2000, {"depends_on": "é{}"}, "depends_on", {}]
    texts = [json.dumps(t) for t in trees] + [r'{"depends\u005fon" : 1}', " 1e5 ", '{"depends_on":NaN}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cell string")
    out = nested.rewritten(df, "cell", nested.depends_as_list, nested.empty_as_null)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan and plan.count("try_parse_json") == 2
    got = [r.cell for r in out.orderBy("i").collect()]
    assert [json.loads(g) for g in got[: len(trees)]] == [without_empty(with_lists(t)) for t in trees]
    assert got[len(trees) :] == ['{"depends_on":[1]}', "100000", '{"depends_on":NaN}']


def test_json_safe(spark):
    schema = "m map<int,struct<x:double,d:date,deep:array<map<boolean,binary>>>>, t timestamp, n void, s string, f float"
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc)
    row = ({1: (float("nan"), datetime.date(2024, 1, 2), [{True: bytearray(b"\xff\x00")}, None]), 2: None}, when, None, "é\n", float("inf"))
    df = spark.createDataFrame([row, (None,) * 5], schema)
    got = [[None if v is None else json.loads(v) for v in r] for r in df.select(*[nested.json_text(df, c).alias(c) for c in df.columns]).collect()]
    one = {"1": {"x": None, "d": "2024-01-02", "deep": [{"true": "ff00"}, None]}, "2": None}
    assert got == [[one, "2024-01-02 03:04:05", None, "é\n", None], [None] * 5]


def test_token_ids_parse_a_cell_once(spark):
    """The steps into nested lists are bound: the cell is parsed at one place of the plan, whatever it holds."""
    cells = ["[1, 2.9]", "[[[4], [5]]]", '{"input_ids": [[6, " 7 "]]}', '[1, null, "x"]', "{}", "[]", "broken [", None]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    out = df.select("i", uq.token_ids(F.col("cell")).alias("ids"))
    assert out._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 1
    assert [r.ids for r in out.orderBy("i").collect()] == [[1, 2], [4], [6, 7], [], [], [], [], []]
