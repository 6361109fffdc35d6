"""Parsing of tagged model output, as Column expressions.

Tags are found without regard to case. A pattern that is not found gives null, not an empty string.
Patterns are Java's; ``(?s)`` lets a dot match line ends, ``(?u)`` folds case beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four actions and their letters.
ACTIONS = {"A": "direct_answer", "B": "tool_call", "C": "request_for_info", "D": "cannot_answer"}
LETTERS = {name: letter for letter, name in ACTIONS.items()}

_ANY_ACTION = "direct_answer|tool_call|request_for_info|cannot_answer"
ACTION_TAG = rf"(?i)({_ANY_ACTION})\s*<([ABCD])>"
LOOSE_ACTION_TAG = rf"(?i)\b({_ANY_ACTION})\s*<\s*([ABCD])\s*>"
THINK = r"(?is)<think>(.*?)</think>"
UQ = r"(?is)\[uq\](.*?)\[/uq\]"
ANSWER = r"(?is)<answer>(.*?)</answer>"
BRACKET_ANSWER = r"(?is)\[answer\](.*?)\[/answer\]"
TOOL_BLOCK = r"(?is)<tool_call>\s*(.*?)\s*</tool_call>"
ACTION_XML = rf"(?is)<action>\s*({_ANY_ACTION})\s*</action>"
LABEL_XML = r"(?is)<label>\s*([ABCD])\s*</label>"
SUGGESTED = rf"(?i)suggested_action\s*=\s*({_ANY_ACTION})\s*<\s*([ABCD])\s*>"
SUGGESTED_LETTER = r"(?i)suggested_action\s*=\s*<?([ABCD])>?"
#: A letter A to D that no letter, digit or underscore touches.
LONE_LETTER = r"(?<![\p{L}\p{N}_])([A-Da-d])(?![\p{L}\p{N}_])"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space at both ends: Unicode's, and the four ASCII separators."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def think(text: Column) -> Column:
    """The stripped inside of the first think block, else of the first uq block."""
    return F.coalesce(strip(found(text, THINK)), strip(found(text, UQ)))


def think_only(text: Column) -> Column:
    return strip(found(text, THINK))


def answer(text: Column) -> Column:
    """All tool-call blocks, one a line; else the first answer in either kind of tag."""
    blocks = every(text, TOOL_BLOCK)
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(
        F.coalesce(strip(found(text, ANSWER)), strip(found(text, BRACKET_ANSWER)))
    )


def uncertainty_value(text: Column, name: str) -> Column:
    """``internal_uq`` or ``external_uq`` of the think block, within 0 and 1."""
    raw = found(think(text), rf"(?i){name}\s*=\s*([0-9]*\.?[0-9]+)").try_cast("double")
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def source(text: Column) -> Column:
    """What follows ``source=`` up to ``suggested_action=``, else to the end of the line."""
    inner = think(text)
    return F.coalesce(
        strip(found(inner, r"(?is)source\s*=\s*(.+?)\s+suggested_action\s*=")),
        strip(found(inner, r"(?i)source\s*=\s*([^\n]+)")),
    )


def suggested_letter(text: Column) -> Column:
    return F.upper(F.coalesce(found(text, ACTION_TAG, 2), found(think(text), SUGGESTED_LETTER)))


def category(text: Column) -> Column:
    """The action named by the first tag anywhere. A tag in the think block, or at the end of the answer, is such a tag."""
    return F.lower(found(text, ACTION_TAG, 1))


def last_letter(text: Column) -> Column:
    return F.try_element_at(every(text, LONE_LETTER, 1), F.lit(-1))


def letter(text: Column) -> Column:
    """First action tag; else in the answer a tag at the end of a line, or its last lone letter; else the last in the text."""
    inner = answer(text)
    return F.upper(
        F.coalesce(
            found(text, ACTION_TAG, 2),
            found(inner, r"(?im)<([ABCD])>\s*$"),
            last_letter(inner),
            last_letter(text),
        )
    )


def tagged_letter(text: Column) -> Column:
    """Letter of the first tag, blanks inside allowed; empty without one."""
    return F.coalesce(F.upper(found(text, LOOSE_ACTION_TAG, 2)), F.lit(""))


def judge_text(text: Column) -> Column:
    """The answer without a closing action tag; else the text without its first think block, uq block and tag."""
    inner = answer(text)
    tail = F.regexp_replace(inner, rf"(?im)({_ANY_ACTION})\s*<([ABCD])>\s*$[\s\S]*", "")
    body = strip(tail)
    rest = strip(first_replaced(text, THINK, ""))
    rest = strip(first_replaced(rest, UQ, ""))
    rest = strip(first_replaced(rest, ACTION_TAG, ""))
    return F.when(inner.isNotNull(), F.when(body != "", body).otherwise(strip(inner))).otherwise(rest)


def first_replaced(text: Column, pattern: str, by: str) -> Column:
    """With the first match only replaced."""
    flags = pattern[: pattern.index(")") + 1]
    body = pattern[len(flags) :]
    inner = flags.replace("(?", "").rstrip(")").replace("s", "")
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?{inner or 'i'}s:{body})", "$1" + by.replace("$", r"\$"))


def without_blocks(text: Column) -> Column:
    """Without any think, uq and answer blocks and action tags."""
    for pattern in (THINK, UQ, ANSWER, BRACKET_ANSWER, ACTION_TAG):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def without_think(text: Column) -> Column:
    """Think blocks taken out, the rest stripped."""
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


# The unified format: <think>, <action>, <label>, then the answer.


def tool_calls(text: Column) -> Column:
    """Array of (name, arguments as JSON text) of every block that holds a call, or a list of calls."""
    kind = "array<struct<name:string,arguments:string>>"

    def one(block: Column) -> Column:
        whole = F.when(F.ltrim(block).startswith("["), block).otherwise(F.concat(F.lit("["), block, F.lit("]")))
        parts = F.from_json(whole, "array<string>")
        parts = F.when(F.try_parse_json(whole).isNotNull(), parts)
        return F.transform(F.coalesce(parts, F.array().cast("array<string>")), call_of)

    calls = F.flatten(F.transform(every(text, TOOL_BLOCK, 1), one))
    return F.filter(calls, lambda c: c["name"] != "").cast(kind)


def call_of(item: Column) -> Column:
    """(name, arguments) of one call's JSON text, in the OpenAI form or flat; arguments that are no object become {}."""
    wrapped = F.get_json_object(item, "$.function").startswith("{")
    pick = lambda key: F.when(wrapped, F.get_json_object(item, f"$.function.{key}")).otherwise(F.get_json_object(item, f"$.{key}"))
    args = pick("arguments")
    return F.struct(
        strip(F.coalesce(pick("name"), F.lit(""))).alias("name"),
        F.when(args.startswith("{") & F.try_parse_json(args).isNotNull(), args).otherwise(F.lit("{}")).alias("arguments"),
    )


def unwrapped(text: Column) -> Column:
    """Without think, action and label wrappers."""
    body = strip(text)
    for pattern in (THINK, ACTION_XML, LABEL_XML, LOOSE_ACTION_TAG.replace(r"\b", "")):
        body = strip(F.regexp_replace(body, pattern, ""))
    return body


def has_call(text: Column) -> Column:
    return F.size(tool_calls(text)) > 0


def unified_parts(text: Column, rendered: Column | None = None) -> Column:
    """(action, label, thought, answer, bare) of an output in any form; ``bare`` is the text without its wrappers.

    Every part that is used more than once is bound, so that the expression stays small wherever it is put in.
    The answer is the tool calls (``rendered`` where given, else their raw blocks), else the answer tag, else ``bare``."""
    blocks = rendered if rendered is not None else F.array_join(every(text, TOOL_BLOCK), "\n")
    tag = LOOSE_ACTION_TAG.replace(r"\b", "")

    def tags(t: Column, calls: Column, blocks: Column) -> Column:
        first = F.coalesce(F.lower(found(t, ACTION_XML)), F.lower(found(t, tag)))
        letter = F.coalesce(F.upper(found(t, LABEL_XML)), F.upper(found(t, tag, 2)))
        inside = strip(found(t, ANSWER))
        return bound(lambda *p: join(calls, blocks, *p), first, letter, think_only(t), inside, unwrapped(t))

    def join(calls: Column, blocks: Column, first: Column, letter: Column, thought: Column, inside: Column, bare: Column) -> Column:
        has = F.size(calls) > 0
        action = F.coalesce(first, F.lower(found(thought, SUGGESTED)), F.when(has, F.lit("tool_call")))
        given = F.coalesce(letter, F.upper(found(thought, SUGGESTED, 2)), F.when(has, F.lit("B")))
        answer = F.when(has, blocks).otherwise(F.coalesce(inside, blank_to_null(bare)))
        return bound(
            lambda action, given, answer: F.struct(
                action.alias("action"),
                F.coalesce(given, letter_of_action(action)).alias("label"),
                thought.alias("thought"),
                answer.alias("answer"),
                bare.alias("bare"),
            ),
            action,
            given,
            answer,
        )

    return bound(tags, text, tool_calls(text), blocks)


def unified_action(text: Column) -> Column:
    return unified_parts(text)["action"]


def unified_label(text: Column) -> Column:
    return unified_parts(text)["label"]


def unified_answer(text: Column, rendered: Column | None = None) -> Column:
    """Tool calls rendered (``rendered`` where given, else their raw blocks), else the answer tag, else the unwrapped text."""
    return unified_parts(text, rendered)["answer"]


def normalized(text: Column, rendered: Column | None = None) -> Column:
    """The unified format of any output; empty text stays empty."""
    part = lambda tag, value: F.when(value != "", F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>")))

    def joined(raw: Column, p: Column) -> Column:
        body = blank_to_null(strip(F.coalesce(p["answer"], p["bare"])))
        whole = F.concat_ws("\n", part("think", p["thought"]), part("action", p["action"]), part("label", p["label"]), body)
        return F.when(raw == "", raw).otherwise(strip(whole))

    raw = strip(text)
    return bound(joined, raw, unified_parts(raw, rendered))


def canonical(action: Column, label: Column, body: Column, thought: Column, origin: str = "trajectory_or_when2call") -> Column:
    """Think block, action tag and answer block; just the answer where action or label is missing."""

    def whole(act: Column, lab: Column, text: Column, inner: Column) -> Column:
        given = F.concat(F.lit(f"source={origin} suggested_action="), act, F.lit(" <"), lab, F.lit(">"))
        inner = F.when(inner.contains("suggested_action"), inner).otherwise(given)
        made = F.concat(F.lit("<think>"), inner, F.lit("</think>\n"), act, F.lit("<"), lab, F.lit(">\n<answer>"), text, F.lit("</answer>"))
        return F.when((act == "") | (lab == ""), text).otherwise(made)

    def labelled(act: Column, lab: Column, text: Column, inner: Column) -> Column:
        return bound(whole, act, F.coalesce(blank_to_null(lab), letter_of_action(act), F.lit("")), text, inner)

    plain = lambda c: strip(F.coalesce(c, F.lit("")))
    return bound(labelled, F.lower(plain(action)), F.upper(plain(label)), plain(body), plain(thought))


def canonical_output(text: Column, rendered: Column | None = None) -> Column:
    """The canonical form of any output."""
    return bound(lambda p: canonical(p["action"], p["label"], p["answer"], p["thought"]), unified_parts(text, rendered))


def reward_input(text: Column, rendered: Column | None = None) -> Column:
    """Unified, then canonical where action, label and answer are there."""

    def made(unified: Column, p: Column) -> Column:
        there = p["action"].isNotNull() & p["label"].isNotNull() & p["answer"].isNotNull()
        return F.when((unified != "") & there, canonical(p["action"], p["label"], p["answer"], p["thought"])).otherwise(unified)

    return bound(lambda unified: bound(made, unified, unified_parts(unified)), normalized(text, rendered))


def forced_action(text: Column, letter_to: str) -> Column:
    """With the first action tag replaced by another one."""
    return first_replaced(F.coalesce(text, F.lit("")), LOOSE_ACTION_TAG, f"{ACTIONS[letter_to]}<{letter_to}>")


def forced_surface(text: Column, letter_to: str, rendered: Column | None = None) -> Column:
    """What a response must look like for a forced action: the tool calls alone for B, else the plain answer."""
    raw = strip(F.coalesce(text, F.lit("")))

    def surface(raw: Column, calls: Column, p: Column) -> Column:
        if letter_to == "B":
            return F.when(F.size(calls) > 0, p["answer"]).otherwise(raw)
        rest = F.regexp_replace(forced_action(raw, letter_to), r"(?i)</?answer>", "")
        return F.coalesce(p["answer"], strip(F.regexp_replace(strip(rest), LOOSE_ACTION_TAG, "")))

    return bound(surface, raw, tool_calls(raw), unified_parts(raw, rendered))


def prompt_suffix(letter: Column) -> Column:
    """The instruction that a prompt ends with to force the action of a letter; null for another letter."""
    tools = (
        "\n\n[Forced Action]\nYou MUST perform a tool call.\nYou MUST output only <tool_call>...</tool_call> blocks.\n"
        "You MUST NOT output action tags, <answer> tags, or extra prose.\n"
    )
    plain = F.concat(
        F.lit("\n\n[Forced Action]\nYou MUST output plain assistant text consistent with action "),
        action_of_letter(letter),
        F.lit("<"),
        letter,
        F.lit(">.\nYou MUST NOT output action tags, <answer> tags, or any tool-call XML unless the action is tool_call<B>.\n"),
    )
    return F.when(letter == "B", F.lit(tools)).when(action_of_letter(letter) != "", plain)


def prompt_suffix_v2(letter: Column) -> Column:
    """The same of the older format, one text for all letters."""
    text = F.concat(
        F.lit("\n\n[Forced Action]\nYou MUST output action tag "),
        action_of_letter(letter),
        F.lit("<"),
        letter,
        F.lit("> and keep content consistent with this action.\n"),
    )
    return F.when(action_of_letter(letter) != "", text)


def letter_of_action(action: Column) -> Column:
    out = F
    for name, value in LETTERS.items():
        out = out.when(action == name, F.lit(value))
    return out


def action_of_letter(value: Column) -> Column:
    out = F
    for name, action in ACTIONS.items():
        out = out.when(F.upper(value) == name, F.lit(action))
    return F.coalesce(out.otherwise(None), F.lit(""))


def gt_letter(value: Column) -> Column:
    """A letter from a letter or an action name; A where neither."""
    text = strip(F.coalesce(value, F.lit("")))
    named = F.lower(text)
    return F.coalesce(
        F.when(F.upper(text).isin("A", "B", "C", "D"), F.upper(text)),
        F.when(named == "direct", F.lit("A")),
        letter_of_action(named),
        F.lit("A"),
    )


def sentences(text: Column) -> Column:
    """Stripped non-blank sentences; each ends after one of ``.!?;`` or a line end."""
    parts = every(text, "[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """(sentence, first, end) with offsets of the stripped sentence in the text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sentence:string,first:int,end:int>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        body = strip(raw)
        lead = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+", ""))
        first = acc["at"] + lead
        item = F.struct(body.alias("sentence"), first.alias("first"), (first + F.length(body)).alias("end"))
        return F.struct(
            (acc["at"] + F.length(raw)).alias("at"),
            F.when(body == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"),
        )

    return F.aggregate(every(text, "[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$"), zero, step, lambda acc: acc["out"])


def raw_sentences(text: Column) -> Column:
    """(raw, body) of the stretches up to each end mark; the body is stripped, and may be empty."""
    return F.transform(every(text, "[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$"), lambda x: F.struct(x.alias("raw"), strip(x).alias("body")))


def f1_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return every(F.lower(F.coalesce(text, F.lit(""))), "[A-Za-z0-9_]+")


def token_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of two short texts; 0 where one has no tokens. For long texts see ``pairwise_token_f1``."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))

    def score(ta: Column, tb: Column) -> Column:
        inter = F.aggregate(F.array_distinct(ta), F.lit(0), lambda acc, t: acc + F.least(count(ta, t), count(tb, t)))
        both = F.size(ta) + F.size(tb)
        return F.when((F.size(ta) > 0) & (F.size(tb) > 0) & (inter > 0), 2.0 * inter / both).otherwise(F.lit(0.0))

    return bound(score, f1_tokens(a), f1_tokens(b))


def bound(f, *values: Column) -> Column:
    """``f`` of values that are worked out once, also where ``f`` uses them within a lambda."""
    row = F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda s: f(*[s[f"_{i}"] for i in range(len(values))])), 0)


def tool_name_and_arguments(text: Column) -> Column:
    """(name, arguments) of the first tool-call block, or of the text itself, as JSON; the first item of a list."""
    raw = strip(F.coalesce(text, F.lit("")))
    inside = F.coalesce(strip(found(raw, r"(?is)<(?:toolcall|tool_call)>\s*(.*?)\s*</(?:toolcall|tool_call)>")), raw)
    valid = F.try_parse_json(inside).isNotNull()
    item = F.when(inside.startswith("["), F.get_json_object(inside, "$[0]")).otherwise(inside)
    args = F.get_json_object(item, "$.arguments")
    good = valid & item.startswith("{")
    return F.struct(
        F.when(good, strip(F.coalesce(F.get_json_object(item, "$.name"), F.lit("")))).otherwise(F.lit("")).alias("name"),
        F.when(good & args.startswith("{"), args).otherwise(F.lit("{}")).alias("arguments"),
    )


# Cues of questions and refusals.
QUESTION_CUES = ("could you", "can you", "would you", "please provide", "please specify", "what ", "which ", "how ")
REFUSAL_CUES = ("unable", "cannot", "can't", "sorry", "apologies", "i'm unable", "i do not have")


def contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def is_question(text: Column) -> Column:
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    return low.contains("?") | contains_any(low, QUESTION_CUES)


def is_refusal(text: Column) -> Column:
    return contains_any(F.lower(strip(F.coalesce(text, F.lit("")))), REFUSAL_CUES)


def chat_base_url(url: Column) -> Column:
    """A service address without the chat-completions part."""
    bare = F.regexp_replace(strip(url), r"/+\z", "")
    return F.regexp_replace(bare, r"/(chat/completions|completions|chat)\z", "")
