"""Perplexity, uncertainty and negative routing, as Column expressions."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwright.functions.text import bound

NAN = float("nan")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def perplexity(logprobs: Column) -> Column:
    """exp of the mean negative log-probability; NaN without any."""
    return F.when(F.size(logprobs) > 0, F.exp(-total(logprobs) / F.size(logprobs))).otherwise(F.lit(NAN))


def unmasked(logprobs: Column, mask: Column) -> Column:
    """Log-probabilities where the mask is not 0."""
    kept = F.filter(F.arrays_zip(logprobs.alias("lp"), mask.alias("m")), lambda x: x["m"] != 0)
    return F.transform(kept, lambda x: x["lp"])


def sequence_summary(logprobs: Column, mask: Column | None = None) -> Column:
    """(sequence_nll, sequence_ppl, token_count) of the tokens whose mask is not 0; zeros without any.

    The shorter of list and mask counts; without a mask all tokens do."""
    both = None if mask is None else F.least(F.size(logprobs), F.size(mask))
    kept = logprobs if mask is None else unmasked(F.slice(logprobs, 1, both), F.slice(mask, 1, both))
    n = F.greatest(F.coalesce(F.size(kept), F.lit(0)), F.lit(0))
    nll = F.when(n > 0, -total(kept) / n).otherwise(F.lit(0.0))
    return F.struct(nll.alias("sequence_nll"), F.when(n > 0, F.exp(nll)).otherwise(F.lit(0.0)).alias("sequence_ppl"), n.cast("long").alias("token_count"))


#: How many lists may lie around a list of token ids.
ID_DEPTH = 4


def token_ids(cell: Column) -> Column:
    """Token ids of a tokenizer's output in JSON: a list, the first of nested lists, or that under ``input_ids``.

    Numbers are cut to whole ones and texts of whole numbers read; anything else makes the list empty, as does a
    cell that is no list."""
    # Each step is bound: a step that names the one before it twice would double the work at every level.
    named = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.input_ids", "variant")).otherwise(v)
    value = bound(named, F.try_parse_json(cell))
    for _ in range(ID_DEPTH):
        inner = lambda v, first: F.when(F.schema_of_variant(first).startswith("ARRAY"), first).otherwise(v)
        value = bound(lambda v: bound(inner, v, F.try_variant_get(v, "$[0]", "variant")), value)  # noqa: B023

    def one(x: Column) -> Column:
        shape = F.schema_of_variant(x)
        text = F.trim(F.try_variant_get(x, "$", "string"))
        whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
        number = F.try_variant_get(x, "$", "double")
        return F.when(shape == "STRING", whole).when(shape == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("long")).when(
            shape == "BIGINT", F.try_variant_get(x, "$", "long")
        ).when((shape == "DOUBLE") | shape.startswith("DECIMAL"), number.try_cast("long"))

    ids = F.transform(F.try_variant_get(value, "$", "array<variant>"), one)
    none = F.array().cast("array<bigint>")
    return bound(lambda xs: F.when(F.exists(xs, lambda x: x.isNull()), none).otherwise(F.coalesce(xs, none)), ids)


def option_perplexity(logprobs: Column) -> Column:
    """Perplexity of the softmax over answer options; NaN for fewer than four."""
    top = F.array_max(logprobs)
    weights = F.transform(logprobs, lambda x: F.exp(x - top))
    norm = total(weights)
    entropy = -total(F.transform(weights, lambda w: F.when(w > 0, w / norm * F.log(w / norm)).otherwise(0.0)))
    return F.when(F.size(logprobs) >= 4, F.exp(entropy)).otherwise(F.lit(NAN))


def normalized_perplexity(ppl: Column, options: int = 4) -> Column:
    """0 for NaN or at most 1, then linear up to 1 at ``options``."""
    return F.when(ppl.isNull() | F.isnan(ppl) | (ppl <= 1), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), (ppl - 1) / (options - 1))
    )


def chosen_uncertainty(logprob: Column, options: int = 4) -> Column:
    """Uncertainty in [0, 1] from one option's log-probability, the rest spread evenly over the others."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(1e-10), F.exp(logprob)))
    rest = (1 - p) / (options - 1)
    entropy = -(p * F.log(p)) - F.when(rest > 0, (options - 1) * rest * F.log(rest)).otherwise(0.0)
    return normalized_perplexity(F.exp(entropy), options)


def last_position(tokens: Column, wanted: list[int]) -> Column:
    """Index from 0 of the last token among ``wanted``; null without one."""
    hits = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i).isin(wanted))
    return F.when(F.size(tokens) > 0, F.try_element_at(hits, F.lit(-1)))


def clamp01(value: Column) -> Column:
    """Within 0 and 1; 0.5 where it is no number."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def is_finite(value: Column) -> Column:
    x = value.try_cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def hash_share(key: Column) -> Column:
    """The first 64 bits of the key's MD5 as a share of 2^64."""
    high = F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10)
    return high.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def route(key: Column, mode: str = "default") -> Column:
    """hard below a quarter, random below a half, none above; mode ``none`` switches routing off."""
    u = hash_share(key)
    return F.lit("none") if mode == "none" else F.when(u < 0.25, F.lit("hard")).when(u < 0.5, F.lit("random")).otherwise(F.lit("none"))


# The hard negative of each letter.
HARD_NEGATIVE = {"A": "B", "B": "A", "C": "A", "D": "C"}


def hard_negative(letter: Column) -> Column:
    out = F
    for name, other in HARD_NEGATIVE.items():
        out = out.when(letter == name, F.lit(other))
    return out.otherwise(F.lit("A"))


@F.pandas_udf(T.StringType())
def random_negative(gt: pd.Series, key: pd.Series) -> pd.Series:
    """One of the other letters, by the Mersenne Twister seeded with 32 bits of MD5(key + letter)."""
    import hashlib

    def pick(letter: str, name: str) -> str:
        rng = random.Random(int(hashlib.md5((name + letter).encode()).hexdigest()[:8], 16))
        return rng.choice([x for x in "ABCD" if x != letter])

    return pd.Series([pick(a or "", b or "") for a, b in zip(gt, key)])


def group_key(uid: Column, idx: Column, fallback: Column) -> Column:
    """``uid:``, else ``idx:``, else the fallback key."""
    named = F.when(F.trim(uid.cast("string")) != "", F.concat(F.lit("uid:"), F.trim(uid.cast("string"))))
    return F.coalesce(named, F.concat(F.lit("idx:"), idx.cast("string")), fallback)


def question_key(question: Column) -> Column:
    return F.concat(F.lit("q:"), F.md5(question.cast("binary")))


def sigmoid(x: Column) -> Column:
    """Saturated beyond 30."""
    return F.when(x >= 30, F.lit(1.0)).when(x <= -30, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def certainty(margin: Column, tau: float = 0.1) -> Column:
    return sigmoid(margin / max(1e-6, tau))


def finite_or(value: float | None, default: float) -> float:
    return default if value is None or not math.isfinite(value) else float(value)


def aligned_tail(logprobs: Column, n: Column) -> Column:
    """The last n log-probabilities where there are so many and none is null; else null."""
    tail = F.slice(logprobs, F.greatest(F.size(logprobs) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    return F.when((n > 0) & (F.size(logprobs) >= n) & ~F.exists(tail, lambda x: x.isNull()), tail)
