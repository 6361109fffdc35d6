"""Rule classification of responses and data sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwright.functions.text import contains_any, strip, without_think

# Refusal and question patterns of preference data, in order.
REFUSAL_PATTERNS = (
    r"\bunable\b",
    r"\bcannot\b",
    r"\bcan't\b",
    r"\bsorry\b",
    r"i'm unable",
    r"i am unable",
    r"i don't have",
    r"i do not have",
    r"apologies",
    r"i'm sorry",
    r"i am sorry",
    r"i apologize",
    r"don't have the capability",
    r"lack the required",
    r"out of scope",
)
QUESTION_PATTERNS = (
    r"\?\n?\z",
    r"could you (please )?provide",
    r"could you (please )?specify",
    r"could you (please )?tell",
    r"could you (please )?confirm",
    r"would you (please )?",
    r"can you (please )?provide",
    r"to proceed,? (i )?need",
    r"to assist you,? (i )?need",
    r"please (provide|specify|tell|confirm)",
    r"what (is|are) ",
    r"which (one|type|language)",
    r"how (would|do) you",
)

# Markers in trajectories.
CANNOT_MARKERS = (
    "cannot",
    "can't",
    "unable to",
    "not able to",
    "do not have access",
    "don't have access",
    "i'm sorry",
    "sorry,",
    "i cannot",
    "i can't",
)
CLARIFY_MARKERS = (
    "could you",
    "can you provide",
    "please provide",
    "please clarify",
    "clarify",
    "which ",
    "what is",
    "what are",
    "need more information",
    "need a bit more",
    "missing",
    "specify",
)


def preference_category(text: Column) -> Column:
    """direct, tool_call, cannot_answer or request_for_info, by the first rule that holds."""
    raw = strip(F.coalesce(text, F.lit("")))
    low = F.lower(raw)
    tool = low.contains("<toolcall>") | low.contains("<tool_call>") | raw.contains('"name":')
    return (
        F.when(raw == "", F.lit("direct"))
        .when(tool, F.lit("tool_call"))
        .when(raw.rlike("(?iud)" + "|".join(REFUSAL_PATTERNS)), F.lit("cannot_answer"))
        .when(raw.rlike("(?iud)" + "|".join(QUESTION_PATTERNS)), F.lit("request_for_info"))
        .otherwise(F.lit("direct"))
    )


def category_letter(category: Column) -> Column:
    return (
        F.when(category == "direct", F.lit("A"))
        .when(category == "tool_call", F.lit("B"))
        .when(category == "request_for_info", F.lit("C"))
        .when(category == "cannot_answer", F.lit("D"))
    )


def turn_response(text: Column) -> Column:
    """(label, action, reason, hint) of an assistant's text without tool call."""
    body = without_think(F.coalesce(text, F.lit("")))
    low = F.lower(body)
    cannot = contains_any(low, CANNOT_MARKERS)
    clarify = body.contains("?") & contains_any(low, CLARIFY_MARKERS)
    row = lambda *values: F.struct(*[F.lit(v).alias(n) for n, v in zip(("label", "action", "reason", "hint"), values)])
    return (
        F.when(cannot, row("D", "cannot_answer", "trajectory_refusal_or_capability_gap", "cannot_answer"))
        .when(clarify, row("C", "request_for_info", "observed_clarification_request", "ask_user_for_missing_info"))
        .otherwise(row("A", "direct_answer", "observed_direct_answer", "answer_directly"))
    )


def is_trajectory_source(source: Column) -> Column:
    """Whether rows of a data source are trajectories."""
    name = F.coalesce(source, F.lit(""))
    return (name.startswith("cm2") & (name != "cm2_turn_action")) | (name == "nvidia_nemotron_checklist")


def truthy(value: Column) -> Column:
    """A flag from text: 1, true, yes and on hold; null does not."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def valid_label(value: Column) -> Column:
    """A, B, C or D of a loosely written label; else null."""
    label = F.upper(strip(F.coalesce(value, F.lit(""))))
    return F.when(label.isin("A", "B", "C", "D"), label)
