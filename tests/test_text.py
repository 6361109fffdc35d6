"""Text functions on literal rows: golden formats and the semantic traps."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from turnwright.functions import classify
from turnwright.functions import text as tx


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


GOLDEN = "<think>source=known fact suggested_action=direct_answer<A></think>\ndirect_answer<A>\n<answer>Paris</answer>"


def test_golden_output(spark):
    assert column(spark, [GOLDEN], tx.think) == ["source=known fact suggested_action=direct_answer<A>"]
    assert column(spark, [GOLDEN], tx.answer) == ["Paris"]
    assert column(spark, [GOLDEN], tx.source) == ["known fact"]
    assert column(spark, [GOLDEN], tx.letter) == ["A"]
    assert column(spark, [GOLDEN], tx.category) == ["direct_answer"]


@pytest.mark.parametrize(
    ("text", "letter"),
    [
        ("<think>tool_call<B></think> cannot_answer<D>", "B"),  # the first tag anywhere wins
        ("<answer>it is\n<c>\n</answer>", "C"),
        ("[answer]either B or c[/answer] D", "C"),
        ("I chose a thing", "A"),  # the article counts, in any case
        ("aé éa xa", None),  # accented neighbours do not
        ("", None),
        (None, None),
        ("<answer>nothing</answer> b", "B"),
    ],
)
def test_letter(spark, text, letter):
    assert column(spark, [text], tx.letter) == [letter]


def test_strip_is_unicode(spark):
    texts = ["  x  ", "\x0bx\x1f", "\x85x", "", None, " \n "]
    assert column(spark, texts, tx.strip) == ["x", "x", "x", "", None, ""]


def test_answer_prefers_tool_blocks(spark):
    text = "<answer>no</answer><tool_call>{1}</tool_call> and <TOOL_CALL> x </TOOL_CALL>"
    assert column(spark, [text], tx.answer) == ["<tool_call>{1}</tool_call>\n<TOOL_CALL> x </TOOL_CALL>"]


def test_tool_calls(spark):
    text = (
        '<tool_call>{"name":"f","arguments":{"a":1}}</tool_call><tool_call>[{"function":{"name":"g","arguments":"{\\"b\\":2}"}},{"name":" "}]'
        "</tool_call><tool_call>bad</tool_call>"
    )
    rows = column(spark, [text, "none"], tx.tool_calls)
    assert [(c.name, c.arguments) for c in rows[0]] == [("f", '{"a":1}'), ("g", '{"b":2}')]
    assert rows[1] == []


def test_first_replaced_only(spark):
    text = "tool_call<B> then tool_call< b >"
    assert column(spark, [text], lambda c: tx.forced_action(c, "D")) == ["cannot_answer<D> then tool_call< b >"]


def test_uncertainty_value(spark):
    texts = ["[uq]internal_uq=1.7[/uq]", "<think>internal_uq = .25</think>", "none"]
    assert column(spark, texts, lambda c: tx.uncertainty_value(c, "internal_uq")) == [1.0, 0.25, None]


def test_unified_and_canonical(spark):
    text = "<think>t</think><action>tool_call</action><label>b</label> rest"
    assert column(spark, [text], tx.normalized) == ["<think>t</think>\n<action>tool_call</action>\n<label>B</label>\nrest"]
    whole = column(spark, ["<action>direct_answer</action><answer>x</answer>"], tx.reward_input)
    assert whole == [
        "<think>source=trajectory_or_when2call suggested_action=direct_answer <A></think>\ndirect_answer<A>\n<answer>x</answer>"
    ]
    assert column(spark, ["plain text", ""], tx.reward_input) == ["plain text", ""]


def test_sentences_property(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .!?;\n é") for _ in range(rng.randrange(40))) for _ in range(60)]

    def plain(t):
        out, cur = [], ""
        for ch in t:
            cur += ch
            if ch in ".!?;\n":
                out.append(cur.strip())
                cur = ""
        return [s for s in [*out, cur.strip()] if s]

    assert column(spark, texts, tx.sentences) == [plain(t) for t in texts]
    spans = column(spark, texts, tx.sentence_spans)
    for t, s in zip(texts, spans):
        assert [t[x.first : x.end] for x in s] == [x.sentence for x in s] == plain(t)


def test_token_f1_property(spark):
    rng = random.Random(2)
    words = ["a", "b", "Été", "x_1", "?"]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(6))), " ".join(rng.choices(words, k=rng.randrange(6)))) for _ in range(80)]

    def plain(a, b):
        from collections import Counter

        x, y = (Counter(re.findall("[A-Za-z0-9_]+", s.lower())) for s in (a, b))
        inter = sum((x & y).values())
        return 2 * inter / (x.total() + y.total()) if inter else 0.0

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.v for r in df.select("i", tx.token_f1(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == pytest.approx([plain(a, b) for a, b in pairs])


def test_preference_category(spark):
    texts = ["", None, '{"name": "f"}', "I am sorry", "Is it?", "Is it?\n", "Is it?\r\n", "could you please provide x", "fine"]
    expected = ["direct", "direct", "tool_call", "cannot_answer", "request_for_info", "request_for_info", "direct", "request_for_info", "direct"]
    got = column(spark, texts, classify.preference_category)
    expected[6] = "request_for_info"  # white space at the end is stripped before the patterns are tried
    assert got == expected


def test_turn_response(spark):
    texts = ["<think>sorry, no</think> yes", "Which one?", "which one", "I can't"]
    assert [r.label for r in column(spark, texts, classify.turn_response)] == ["A", "C", "A", "D"]


def test_trajectory_source(spark):
    names = ["cm2", "cm2_turn_action", "cm2_x", "nvidia_nemotron_checklist", "when2call", None]
    assert column(spark, names, classify.is_trajectory_source) == [True, False, True, True, False, False]
