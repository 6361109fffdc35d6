"""Group margins of rollouts: conditional mean perplexities of a prompt's right and wrong responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.functions import uncertainty as uq

#: Columns that rollouts have here: group_key, pred_letter, gt_letter, seq_ppl.


def _right() -> Column:
    return (F.col("pred_letter") == F.col("gt_letter")) & (F.col("pred_letter") != "")


def _wrong() -> Column:
    return (F.col("pred_letter") != F.col("gt_letter")) & (F.col("pred_letter") != "")


def group_means(rollouts: DataFrame) -> DataFrame:
    """mean_correct, mean_wrong and n of each group; combined before the shuffle."""
    return rollouts.groupBy("group_key").agg(
        F.avg(F.when(_right(), F.col("seq_ppl"))).alias("mean_correct"),
        F.avg(F.when(_wrong(), F.col("seq_ppl"))).alias("mean_wrong"),
        F.count(F.lit(1)).alias("n"),
    )


def filled(rollouts: DataFrame, expected: int = 8) -> DataFrame:
    """ppl_gt, ppl_neg and where they come from: a rollout's own perplexity on its side, else its group's mean, else 1.

    Means join back by the group key: a frequent key is split by adaptive skew handling, as a window would not be."""
    means = group_means(rollouts)
    own = rollouts.join(means, "group_key")
    size = F.when(F.col("n") >= expected, F.lit("group_rollout:complete")).otherwise("group_rollout:partial")
    return own.select(
        *rollouts.columns,
        F.coalesce(F.when(_right(), F.col("seq_ppl")), F.col("mean_correct"), F.lit(1.0)).alias("ppl_gt"),
        F.coalesce(F.when(_wrong(), F.col("seq_ppl")), F.col("mean_wrong"), F.lit(1.0)).alias("ppl_neg"),
        (size if expected > 1 else F.lit("disabled")).alias("margin_source"),
    )


def turn_means(scores: DataFrame, by: list[str], turn: str = "turn", value: str = "value") -> DataFrame:
    """Mean score of each turn and how many scores it has."""
    return scores.groupBy(*by, turn).agg(F.avg(value).alias("score"), F.count(value).alias("n"))


def runtime_fields(rollouts: DataFrame, mode: str = "default", expected: int = 8, digits: int = 6) -> DataFrame:
    """Route, negative letter, perplexities, margin and its source, without an external scorer."""
    key = F.col("rollout_key")
    step = filled(rollouts, expected)
    way = uq.route(key, mode)
    return step.select(
        *rollouts.columns,
        way.alias("neg_type"),
        F.when(way == "hard", uq.hard_negative(F.col("gt_letter"))).otherwise("").alias("neg_letter"),
        F.round("ppl_gt", digits).alias("ppl_gt"),
        F.round("ppl_neg", digits).alias("ppl_neg"),
        F.round(F.col("ppl_neg") - F.col("ppl_gt"), digits).alias("margin"),
        "margin_source",
    )


def with_random_negatives(fields: DataFrame) -> DataFrame:
    """The random route's negatives, by a Python generator for the same choices."""
    pick = uq.random_negative(F.col("gt_letter"), F.col("rollout_key"))
    return fields.withColumn("neg_letter", F.when(F.col("neg_type") == "random", pick).otherwise(F.col("neg_letter")))


def ladder(
    rollouts: DataFrame,
    strict: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
    mode: str = "default",
    expected: int = 8,
    tau: float = 0.1,
    weight: float = 1.0,
    digits: int = 6,
) -> DataFrame:
    """Runtime fields step by step: own perplexity, then strict scores of routed rows, then group terms for the rest.

    A rollout's own perplexity is that of its side. ``strict`` adds ``strict_ppl`` to rows with ``letter``; only routed
    rows get it, and only for the side that is still open, so that no call is made for what is known, and what it gives is
    written below ``path``, so that none is made twice. Rows with an open side after that are the members of the
    groups: means are theirs alone. The source is ``neutral`` or the route, or that of the group where one was asked.
    Without groups (``expected`` 1) a side may stay null; the margin is 0 then."""
    if strict and not path:
        raise ValueError("strict scores need a path to be written to")
    key, gt = F.col("rollout_key"), F.col("gt_letter")
    way = uq.route(key, mode)
    rows = rollouts.select("*", way.alias("neg_type"))
    negative = F.when(F.col("neg_type") == "hard", uq.hard_negative(gt)).when(F.col("neg_type") == "random", uq.random_negative(gt, key))
    rows = rows.select("*", negative.alias("neg_letter"), F.when(_right(), F.col("seq_ppl")).alias("_gt"), F.when(_wrong(), F.col("seq_ppl")).alias("_neg"))
    if strict:
        for side, letter in (("_gt", "gt_letter"), ("_neg", "neg_letter")):
            ask = F.col(side).isNull() & (F.col("neg_type") != "none") & (F.coalesce(F.col(letter), F.lit("")) != "")
            scored = strict(rows.where(ask).withColumn("letter", F.col(letter))).withColumn(side, F.col("strict_ppl"))
            rows.where(~ask).unionByName(scored.select(rows.columns)).write.mode("overwrite").parquet(f"{path}/strict{side}")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/strict{side}")
    source = F.when(F.col("neg_type") == "none", F.lit("neutral")).otherwise(F.col("neg_type"))
    both = F.col("_gt").isNotNull() & F.col("_neg").isNotNull()
    named = rows.withColumn("margin_source", source)
    if expected > 1:
        group = filled(rows.where(~both), expected)
        group = group.withColumn("_gt", F.coalesce("_gt", "ppl_gt")).withColumn("_neg", F.coalesce("_neg", "ppl_neg"))
        named = named.where(both).unionByName(group.select(named.columns))
    margin = F.coalesce(F.round(F.col("_neg") - F.col("_gt"), digits), F.lit(0.0))
    return named.select(
        *rollouts.columns,
        F.lit(tau).alias("tau"),
        F.lit(weight).alias("lambda"),
        "neg_type",
        "neg_letter",
        F.round("_gt", digits).alias("ppl_gt"),
        F.round("_neg", digits).alias("ppl_neg"),
        margin.alias("margin"),
        "margin_source",
    )
