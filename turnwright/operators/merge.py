"""Resume merges, unions, first-wins deduplication and tool sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.functions.text import strip


def resume(rows: DataFrame, previous: DataFrame, column: str = "gt_action") -> DataFrame:
    """Rows with the previous run's value where it has one; raises where the row counts differ."""
    if rows.count() != previous.count():
        raise ValueError("the previous output has another number of rows")
    old = previous.select("row_id", F.col(column).alias("_old"))
    fresh = F.col(column) if column in rows.columns else F.lit(None)
    return rows.join(old, "row_id", "left").withColumn(column, F.coalesce("_old", fresh)).drop("_old")


def log_merge(rows: DataFrame, log: DataFrame, column: str = "gt_action") -> DataFrame:
    """Rows with the value of their last log line; lines without value or for unknown rows do nothing."""
    last = log.where(F.col(column).isNotNull()).groupBy("row_id").agg(F.max_by(column, "line_no").alias("_new"))
    fresh = F.col(column) if column in rows.columns else F.lit(None)
    return rows.join(last, "row_id", "left").withColumn(column, F.coalesce("_new", fresh)).drop("_new")


def union(*parts: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def without(rows: DataFrame, keys: DataFrame, on: str = "row_id") -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; combined before the shuffle, so that a frequent key is one row a task."""
    others = [c for c in rows.columns if c not in (key, order)]
    packed = F.struct(*[F.col(c) for c in (order, *others)])
    first = rows.groupBy(key).agg(F.min_by(packed, order).alias("_r"))
    return first.select(key, "_r.*").select(*rows.columns)


def annotations_union(observed: DataFrame, model: DataFrame) -> DataFrame:
    """Observed annotations, then the model's; the first of equal (row, turn, action, answer) stays."""
    both = union(observed.withColumn("_from", F.lit(0)), model.withColumn("_from", F.lit(1)))
    key = ["row_id", "turn_idx", "gt_action", strip(F.coalesce("target_answer", F.lit(""))).alias("target_answer")]
    return both.groupBy(*key).agg(F.min(F.struct("_from", "place"))["_from"].alias("origin"))


def distinct_tools(calls: DataFrame, column: str = "tool_name") -> DataFrame:
    return calls.select(column).where(F.col(column) != "").distinct()


def latest_by_key(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each key."""
    packed = F.struct(order, *columns)
    return rows.groupBy(key).agg(F.max(packed).alias("_r")).select(key, "_r.*")


def pending(rows: DataFrame, annotated: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without annotations, the first ``limit`` by row_id."""
    left = without(rows, annotated)
    return left if limit is None else left.orderBy("row_id").limit(limit)


def with_required(rows: DataFrame, wanted: Column, *required: str) -> DataFrame:
    """The ``wanted`` rows; one that lacks a ``required`` column (null, empty text or list) fails the job."""
    kinds = dict(rows.dtypes)
    lacks = lambda c: F.col(c).isNull() | (F.size(c) == 0 if kinds[c].startswith("array") else F.col(c).cast("string") == "")
    checked = rows.where(wanted)
    for c in required:
        error = F.raise_error(F.lit(f"a row without {c}")).cast(kinds[c])
        checked = checked.withColumn(c, F.when(lacks(c), error).otherwise(F.col(c)))
    return checked
