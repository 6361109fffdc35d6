"""How long a prompt may be, and how long it is."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings that bound prompt and response together.
ROLLOUT_LIMITS = ("ROLLOUT_MAX_MODEL_LEN", "ROLLOUT_MAX_BATCHED_TOKENS")


def whole_number(value) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def prompt_limit(longest: int, response: int | str | None = None, settings: Mapping[str, str] | None = None) -> int:
    """The most tokens of a prompt: ``longest``, or what the least rollout limit leaves beside a response, at least 1.

    Settings that are empty or no numbers do not count; nor does a response budget that is no positive number."""
    limits = [n for k in ROLLOUT_LIMITS if (n := whole_number((settings or {}).get(k) or "")) is not None]
    if not limits:
        return longest
    budget = whole_number(response) or 0
    return min(longest, max(1, min(limits) - budget) if budget > 0 else min(limits))


def whitespace_length(text: Column) -> Column:
    """Words, as a length that needs no tokenizer; null for null."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def token_length(vocabulary: str):
    """A function of a text column: its length by a tokenizer file, loaded once a Python worker; null where it fails.

    Texts go through in Arrow batches, a thousand at a time, whole."""

    @F.pandas_udf(T.LongType())
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def one(text):
            try:
                return None if text is None else len(tokenizer.encode(text, add_special_tokens=False).ids)
            except Exception:  # noqa: BLE001 - a text that has no length is too long
                return None

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="Int64")

    return length


def within_limit(df: DataFrame, length: Column, limit: int, name: str = "n_tokens") -> DataFrame:
    """Rows of at most ``limit`` tokens, with their length; rows without a length go."""
    return df.withColumn(name, length).where(F.col(name) <= limit)
