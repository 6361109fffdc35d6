"""Quality rules: a threshold table compiled into one projection, without user functions.

Cases: a null or empty text has no words and is not kept. Words are runs of characters other than
ASCII white space. Repeated rows each get their own verdict. Extra columns are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.llm.common import ASCII_SPACE, as_documents, boxed

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it for was "  # English
    "der die das und zu den von mit sich des "  # German
    "de la le les et des un une que est "  # French
    "el los las del se por con y en una"  # Spanish
).split()


@dataclass(frozen=True)
class Rule:
    """Keep rows whose ``measure`` lies in [low, high]; rows of fewer than ``min_words`` words pass."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


#: The production thresholds.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=1.5, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.06),
    Rule("stop_words", "stop_ratio", low=0.005, min_words=100),
    Rule("repeated_lines", "dup_line_ratio", high=0.5, min_words=20),
    Rule("short_lines", "line_ratio", high=0.6, min_words=50),
)


def words_of(text: Column) -> Column:
    """Words by ASCII white space; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def with_repeated_words(df: DataFrame, width: int = 5) -> DataFrame:
    """``n_repeat_words`` in place of ``_hashes``: how many words lie in a window of ``width`` words found twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Sorting (hash, position) brings equal
    windows together; the covered words follow from the gaps between the sorted positions of repeated
    windows. Each step is a projection of its own, so that lambdas refer to values and not to expressions, and takes the
    place of the one before, so that no more than one array is carried along."""
    others = [c for c in df.columns if c != "_hashes"]
    n = F.size("_hashes")
    at = F.sequence(F.lit(0), n - width)
    window = lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(width)])
    keys = F.when(n >= width, F.transform(at, window)).otherwise(F.array().cast("array<bigint>"))
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    distinct = F.size(F.array_distinct("_keys")) == F.size("_keys")
    pairs = F.when(distinct, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_keys", pair)))
    near = lambda j: F.get(F.col("_pairs"), j)["h"]
    repeated = lambda p, j: F.coalesce((near(j - 1) == p["h"]), F.lit(False)) | F.coalesce(near(j + 1) == p["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_pairs", repeated), lambda p: p["i"]))
    add = lambda acc, i: F.struct(
        (i + width).alias("end"), (acc["total"] + i + width - F.greatest(acc["end"], i)).alias("total")
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    count = F.aggregate("_places", none, add, lambda acc: acc["total"]).cast("long")
    for name, value in (("_keys", keys), ("_pairs", pairs), ("_places", places), ("n_repeat_words", count)):
        df = df.select(*others, value.alias(name))
    return df


def measured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with the base counts and the ratios that rules refer to."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]
    has_word = lambda x: F.length(F.trim(x, F.lit(ASCII_SPACE))) > 0
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols")
    step = docs.select(*others, symbols, words_of(F.col("text")).alias("_words"), F.filter(F.split(text, "\n"), has_word).alias("_lines"))
    counts = step.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    counts = with_repeated_words(counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counts.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_lines", "n_words").alias("line_ratio"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        ok = F.col(r.measure).between(r.low, r.high)
        verdict = verdict & ((F.col("n_words") < r.min_words) | ok if r.min_words else ok)
    return verdict


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios, base_failed and kept for each row of a document table."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured(as_documents(docs, "doc_id", "text")).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept rows of a document table, with their own columns.

    A row number that no optimiser may work out twice keeps the filter above the projections: pushed below, it
    would repeat their expressions inside each other."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = measured(boxed(docs, "text")).withColumn("_at", F.monotonically_increasing_id())
    return found.where(~base & passes(rules) & (F.col("_at") >= 0)).select("_row.*")
