"""Operators over all rows of their fixtures, tool calls, raw texts and legacy tags too, against brute force."""

from __future__ import annotations

import json
import math
import os
import re

import pytest

from turnwright import catalog
from turnwright.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
LETTERS = {"direct_answer": "A", "tool_call": "B", "request_for_info": "C", "cannot_answer": "D"}
ACT = "direct_answer|tool_call|request_for_info|cannot_answer"
TAG = rf"(?i)({ACT})\s*<([ABCD])>"
WRAPPERS = (r"(?is)<think>(.*?)</think>", rf"(?is)<action>\s*({ACT})\s*</action>", r"(?is)<label>\s*([ABCD])\s*</label>", TAG)
LOOSE = rf"(?i)\b({ACT})\s*<\s*([ABCD])\s*>"


def first(pattern, text, group=1):
    m = re.search(pattern, text)
    return m.group(group) if m else None


def rendered(text):
    """The fixture's blocks each hold one call by name."""
    calls = [json.loads(b) for b in re.findall(r"(?is)<tool_call>\s*(.*?)\s*</tool_call>", text)]
    return "\n".join(f"<tool_call>\n{json.dumps(c, ensure_ascii=False, sort_keys=True)}\n</tool_call>" for c in calls)


def parts(text):
    """(action, label, thought, answer); every text of the fixture with a call has a tag as well."""
    thought = first(WRAPPERS[0], text)
    thought = thought.strip() if thought is not None else None
    given = rf"(?i)suggested_action\s*=\s*({ACT})\s*<([ABCD])>"
    find = lambda xml, group: first(xml, text) or first(TAG, text, group) or first(given, thought or "", group)
    action, label = find(WRAPPERS[1], 1), find(WRAPPERS[2], 2)
    action = action.lower() if action else None
    label = label.upper() if label else LETTERS.get(action)
    body = text
    for w in WRAPPERS:
        body = re.sub(w, "", body.strip()).strip()
    inner = first(r"(?is)<answer>(.*?)</answer>", text)
    return action, label, thought, rendered(text) or (inner.strip() if inner is not None else body or None)


def unified(text):
    action, label, thought, answer = parts(text.strip())
    tags = [("think", thought), ("action", action), ("label", label)]
    return "\n".join([f"<{t}>{v}</{t}>" for t, v in tags if v] + [answer or ""]).strip()


def canonical(text):
    action, label, thought, answer = parts(text)
    if not action or not label:
        return (answer or "").strip()
    if "suggested_action" not in (thought or ""):
        thought = f"source=trajectory_or_when2call suggested_action={action} <{label}>"
    return f"<think>{thought}</think>\n{action}<{label}>\n<answer>{(answer or '').strip()}</answer>"


def reward_input(text):
    made = unified(text)
    action, label, _, answer = parts(made)
    return canonical(made) if action and label and answer is not None else made


def surface(text):
    raw = text.strip()
    if answer := parts(raw)[3]:
        return answer
    raw = re.sub(r"(?i)</?answer>", "", re.sub(LOOSE, "direct_answer<A>", raw, count=1)).strip()
    return re.sub(LOOSE, "", raw).strip()


@pytest.fixture(scope="module")
def responses(spark):
    rows = fixture(spark, SF, "responses").collect()
    assert {(r.conv_id * 3 + r.turn) % 6 for r in rows} == set(range(6))
    return {(r.conv_id, r.turn): r.response for r in rows}


@pytest.mark.parametrize("name, brute", [("d11_normalize", unified), ("d16_canonical", canonical), ("d17_reward_input", reward_input), ("d19_forced_surface", surface)])
def test_whole_responses(spark, responses, name, brute):
    got = {(r.conv_id, r.turn): r.value for r in catalog.QUERIES[name](spark, SF).collect()}
    assert got == {k: brute(t) for k, t in responses.items()}


def test_whole_unified_parse(spark, responses):
    got = {(r.conv_id, r.turn): (r.action, r.label, r.thought, r.answer) for r in catalog.QUERIES["d10_unified_parse"](spark, SF).collect()}
    assert got == {k: parts(t) for k, t in responses.items()}


def suffix(letter):
    action = {v: k for k, v in LETTERS.items()}[letter]
    if letter == "B":
        rules = "You MUST perform a tool call.\nYou MUST output only <tool_call>...</tool_call> blocks.\nYou MUST NOT output action tags, <answer> tags, or extra prose.\n"
    else:
        rules = (
            f"You MUST output plain assistant text consistent with action {action}<{letter}>.\n"
            "You MUST NOT output action tags, <answer> tags, or any tool-call XML unless the action is tool_call<B>.\n"
        )
    return "\n\n[Forced Action]\n" + rules


def forced(text, letter):
    if letter == "B":
        return rendered(text) or text.strip()
    return surface(text)  # the forced tag is taken out again, whichever it is


def test_prompt_suffix(spark):
    from pyspark.sql import functions as F

    from turnwright.functions import text as tx

    df = spark.createDataFrame([(x,) for x in ["A", "B", "C", "D", "", "E"]], "x string")
    got = df.select("x", tx.prompt_suffix(F.col("x")), tx.prompt_suffix_v2(F.col("x"))).collect()
    assert [r[1] for r in got] == [suffix(x) for x in "ABCD"] + [None, None]
    assert got[1][2] == "\n\n[Forced Action]\nYou MUST output action tag tool_call<B> and keep content consistent with this action.\n"
    assert got[4][2] is None


def test_whole_prompt_suffix(spark):
    rows = fixture(spark, SF, "responses").collect()
    got = {(r.conv_id, r.turn): r.value for r in catalog.QUERIES["d20_prompt_suffix"](spark, SF).collect()}
    assert got == {(r.conv_id, r.turn): "Choose an action." + suffix(r.gt_letter) + "\nassistant: " + r.response for r in rows}


def test_whole_strict_scores(spark):
    rows = fixture(spark, SF, "responses").collect()
    got = {(r.conv_id, r.turn): r.ppl for r in catalog.QUERIES["i6_strict_scores"](spark, SF).collect()}
    # The offline scorer's log-probability of a word is a tenth of its length, whatever goes before.
    lengths = {(r.conv_id, r.turn): [len(w) for w in forced(r.response, r.gt_letter).split()] for r in rows}
    assert set(got) == set(lengths) and all(lengths.values())
    assert all(abs(got[k] - math.exp(sum(n) / 10 / len(n))) < 1e-5 * got[k] + 1e-6 for k, n in lengths.items())


def test_strict_scores_see_prompt_and_suffix(spark, monkeypatch):
    """A scorer whose every number is the count of the request's forced-action lines after a user's message."""
    from turnwright.operators import providers

    def scorer():
        return lambda requests: [json.dumps([-float("user: " in r["prompt"].split("[Forced Action]")[0])] * len(r["prompt"].split())) for r in requests]

    monkeypatch.setattr(providers, "length_scorer", scorer)
    got = [r.ppl for r in catalog.QUERIES["i6_strict_scores"](spark, SF).collect()]
    assert got and all(abs(x - math.e) < 1e-5 for x in got)


def test_whole_tools(spark):
    cells = {r.id: r.tools for r in fixture(spark, SF, "tool_cells").collect()}

    def items(cell):
        if cell is None:
            return []
        try:
            v = json.loads(cell)
        except ValueError:
            return [cell]
        return v if isinstance(v, list) else [cell]

    prompts = {r.id: r.prompt for r in catalog.QUERIES["b10_tools_text"](spark, SF).collect()}
    text = lambda t: t if isinstance(t, str) else json.dumps(t)
    assert prompts == {i: "\n\n".join(f'" {text(t)} "' for t in items(c)) for i, c in cells.items()}
    known = {r.id: r.known for r in catalog.QUERIES["f8_membership"](spark, SF).collect()}
    assert known == {i: any(n in (c or "") for n in ('[{"name":"look_up"', '{"name":"single"')) for i, c in cells.items()}
