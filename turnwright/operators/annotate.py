"""Annotations of decision turns: observed candidates, normal form, balanced choice, enrichment and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwright.functions import classify
from turnwright.functions import semistructured as ss
from turnwright.functions import text as tx
from turnwright.operators.turns import KEY, first_assistant
from turnwright.sources.io import write_parts

ANNOTATION = (
    "turn_idx int, gt_action string, gt_action_name string, uq_target_type string, reason_type string, rationale string, "
    "target_answer string, chosen_response string, relevant_tools array<string>, missing_slots array<string>, "
    "timing_tag string, recovery_hint string, use_uq_reward boolean"
)
# Order of target types when annotations are chosen.
TYPE_RANK = {"high": 0, "medium": 1, "low": 2, "ambiguous": 3}


# Why an observed turn is a candidate, with a tool call and without.
RATIONALES = (
    "The observed assistant next action is a concrete tool call with available arguments.",
    "The observed assistant next action is a non-tool response at this turn.",
)


def candidates(turned: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One annotation a turn from its first assistant message; turns without one, or with an empty one, have none.

    A tool call is B with its calls as the answer; any other text is classified by its markers. ``tools`` has the
    sorted ``tool_names`` of each conv_id; a turn that cannot answer names them as relevant."""
    said = first_assistant(turned).withColumn("content", F.coalesce("content", F.lit("")))
    calls = tx.tool_calls(F.col("content"))
    step = said.select(*KEY, "turn", "content", calls.alias("calls"), tx.without_think(F.col("content")).alias("body"))
    has = F.size("calls") > 0
    step = step.where(has | ((F.col("body") != "") & ~F.col("content").contains("<tool_call>")))
    kind = classify.turn_response(F.col("body"))
    step = step.select("*", has.alias("has"), kind.alias("kind"))
    pick = lambda tool, field: F.when(F.col("has"), F.lit(tool)).otherwise(F.col(f"kind.{field}"))
    blocks = F.array_join(tx.every(F.col("content"), tx.TOOL_BLOCK), "")
    none = F.array().cast("array<string>")
    out = step.select(
        *KEY,
        pick("B", "label").alias("gt_action"),
        pick("tool_call", "action").alias("gt_action_name"),
        F.when(F.col("has") | F.col("kind.label").isin("C", "D"), F.lit("medium")).otherwise("low").alias("uq_target_type"),
        pick("observed_ready_to_execute", "reason").alias("reason_type"),
        F.when(F.col("has"), blocks).otherwise(F.col("body")).alias("target_answer"),
        F.when(F.col("has"), F.lit(RATIONALES[0])).otherwise(F.lit(RATIONALES[1])).alias("rationale"),
        F.when(F.col("has"), F.filter(F.transform("calls", lambda c: c["name"]), lambda n: n != "")).otherwise(none).alias("relevant_tools"),
        none.alias("missing_slots"),
        F.when(F.col("has"), F.lit("execute_now")).otherwise("respond_now").alias("timing_tag"),
        pick("call_tool_now", "hint").alias("recovery_hint"),
        F.lit(True).alias("use_uq_reward"),
    ).withColumn("chosen_response", F.col("target_answer"))
    if tools is None:
        return out
    named = F.when(F.col("gt_action") == "D", F.coalesce("tool_names", none)).otherwise(F.col("relevant_tools"))
    return out.join(tools.select("conv_id", "tool_names"), "conv_id", "left").withColumn("relevant_tools", named).drop("tool_names").select(out.columns)


def normal_form(annotation: Column) -> Column:
    """The 13 fields of an annotation's JSON text, with defaults; null without a label A to D or a whole turn number."""
    get = lambda k: tx.strip(F.coalesce(F.get_json_object(annotation, f"$.{k}"), F.lit("")))
    or_else = lambda k, d: F.coalesce(tx.blank_to_null(get(k)), d if isinstance(d, Column) else F.lit(d))
    listed = lambda k: F.filter(
        F.coalesce(F.from_json(F.get_json_object(annotation, f"$.{k}"), "array<string>"), F.array().cast("array<string>")),
        lambda x: tx.strip(x) != "",
    )
    label = classify.valid_label(get("gt_action"))
    turn = get("turn_idx").try_cast("int")
    item = F.struct(
        turn.alias("turn_idx"),
        label.alias("gt_action"),
        tx.action_of_letter(label).alias("gt_action_name"),
        F.lower(or_else("uq_target_type", "ambiguous")).alias("uq_target_type"),
        or_else("reason_type", "other").alias("reason_type"),
        get("rationale").alias("rationale"),
        get("target_answer").alias("target_answer"),
        or_else("chosen_response", get("target_answer")).alias("chosen_response"),
        listed("relevant_tools").alias("relevant_tools"),
        listed("missing_slots").alias("missing_slots"),
        get("timing_tag").alias("timing_tag"),
        get("recovery_hint").alias("recovery_hint"),
        F.lit(True).alias("use_uq_reward"),
    )
    return F.when(label.isNotNull() & turn.isNotNull(), item)


def parse_reply(reply: Column) -> Column:
    """A labeller's reply: annotations of its JSON, else of what lies between the first { and the last }; sorted."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    doc = F.when(F.try_parse_json(reply).isNotNull(), reply).when(F.try_parse_json(inner).isNotNull(), inner)
    listed = F.coalesce(F.get_json_object(doc, "$.annotations"), F.when(F.ltrim(doc).startswith("["), doc), F.concat(F.lit("["), doc, F.lit("]")))
    items = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    return F.array_sort(F.filter(F.transform(items, normal_form), lambda a: a.isNotNull()))


def priority(uq_type: Column) -> Column:
    out = F
    for name, rank in TYPE_RANK.items():
        out = out.when(F.lower(F.trim(uq_type)) == name, F.lit(rank))
    return out.otherwise(F.lit(4))


def balanced_one(annotations: DataFrame, counts: DataFrame) -> DataFrame:
    """Each row's annotation of the rarest label so far, then by target type, turn and label."""
    ranked = annotations.join(F.broadcast(counts), "gt_action", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = F.struct("n", priority(F.col("uq_target_type")).alias("p"), "turn_idx", "gt_action")
    best = ranked.groupBy("row_id").agg(F.min(key).alias("k"))
    return best.select("row_id", "k.turn_idx", "k.gt_action")


def balanced_some(annotations: DataFrame, counts: dict[str, int], most: int = 2) -> DataFrame:
    """Up to ``most`` annotations of each row (all for 0), greedily: labels already taken count as more frequent.

    The counts are a fixed snapshot; rows do not wait for each other (see ``balanced_running``)."""
    item = ["row_id", F.col("turn_idx").cast("long").alias("turn_idx"), "gt_action"]
    single = annotations.groupBy(*item).agg(F.min(priority(F.col("uq_target_type"))).alias("p"))
    if most <= 0:
        return single.select("row_id", "turn_idx", "gt_action")
    known = F.coalesce(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, int(v))])[F.col("gt_action")], F.lit(0)) if counts else F.lit(0)
    rows = single.withColumn("n", known.cast("long")).groupBy("row_id").agg(F.collect_list(F.struct("n", "p", "turn_idx", "gt_action")).alias("left"))
    rows = rows.withColumn("taken", F.slice("left", 1, 0))
    for _ in range(most):
        # Least by running count, target type, turn and label; what it adds to the count is not kept.
        running = lambda a: a["n"] + F.size(F.filter("taken", lambda t: t["gt_action"] == a["gt_action"]))
        order = F.transform("left", lambda a: F.struct(running(a).alias("now"), a["p"].alias("p"), a["turn_idx"].alias("turn_idx"), a["gt_action"].alias("gt_action"), a.alias("whole")))
        rows = rows.withColumn("best", F.array_min(order)["whole"])
        rows = rows.select("row_id", F.array_except("left", F.array("best")).alias("left"), F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("best"))).alias("taken"))
    return rows.select("row_id", F.explode("taken").alias("a")).select("row_id", "a.turn_idx", "a.gt_action")


def balanced_running(annotations: DataFrame, batch: Column, path: str, counts: dict[str, int] | None = None, most: int = 2) -> DataFrame:
    """``balanced_some`` in batches, one after the other: each sees the counts with the choices of the batches before it.

    ``batch`` numbers the rows' batches. Counts that every single row renews would need all rows in one task; a batch
    is the unit instead, so that the choice is the same at any partitioning. The rows are written below ``path`` once,
    a folder a batch; a batch reads its own folder, writes its choices beside it and adds what it wrote to the count table, one
    number a label. The result is what the batches wrote. Rows without a batch raise an error."""
    known = annotations.withColumn("_batch", F.coalesce(batch.cast("long"), F.raise_error(F.lit("a row without a batch")).cast("long")))
    rows = write_parts(known, F.col("_batch"), f"{path}/rows").drop("_batch")
    now = dict(counts or {})
    numbers = sorted(r[0] for r in rows.select("part").distinct().collect())
    spark = annotations.sparkSession
    for number in numbers:
        chosen = balanced_some(rows.where(F.col("part") == number).drop("part"), now, most)
        chosen.write.mode("overwrite").parquet(f"{path}/chosen/batch={number}")
        for r in spark.read.parquet(f"{path}/chosen/batch={number}").groupBy("gt_action").count().collect():
            now[r["gt_action"]] = now.get(r["gt_action"], 0) + r["count"]
    if not numbers:
        return balanced_some(annotations, now, most)
    return spark.read.schema("row_id long, turn_idx long, gt_action string, batch long").parquet(f"{path}/chosen").drop("batch")


def enriched(annotations: DataFrame, row: str = "row_id") -> DataFrame:
    """Label, name, answer, rollout key and reward flag of flat annotations with a label A to D."""
    label = classify.valid_label(F.col("gt_action"))
    body = F.coalesce(*[tx.blank_to_null(F.col(c)) for c in ("chosen_response", "target_answer", "reference_answer") if c in annotations.columns], F.lit(""))
    key = F.concat(F.lit("cm2:"), F.col(row).cast("string"), F.lit(":turn:"), F.col("turn_idx").cast("string"))
    return annotations.where(label.isNotNull()).select(
        row, "turn_idx", label.alias("gt_action"), tx.action_of_letter(label).alias("gt_action_name"), body.alias("answer"), key.alias("rollout_key"), F.lit(True).alias("use_uq_reward")
    )


def enriched_rows(annotations: DataFrame, row: str = "row_id") -> DataFrame:
    """All annotations with their own columns, those of a label A to D enriched, the others as they are.

    Of an enriched one: label and its name, the answer as ``chosen_response`` (a tool answer in the form of blocks) and,
    where it is null, as ``target_answer``, the first tool that the answer calls, rollout key and reward flag (true where
    it is null). A turn number that is missing is the annotation's place, if there is a column ``number``."""
    have = set(annotations.columns)
    label = classify.valid_label(F.coalesce(*[tx.blank_to_null(F.col(c)) for c in ("gt_action", "label") if c in have]))
    body = F.coalesce(*[tx.blank_to_null(F.col(c)) for c in ("chosen_response", "target_answer", "reference_answer") if c in have], F.lit(""))
    step = annotations.withColumn("_label", label).withColumn("_answer", F.when(F.col("_label") == "B", ss.tool_surface(body)).otherwise(body))
    # An answer without blocks may be a call as it is.
    blocks = F.when(F.lower("_answer").contains("<tool_call>"), F.col("_answer")).otherwise(F.concat(F.lit("<tool_call>"), F.col("_answer"), F.lit("</tool_call>")))
    turn = F.coalesce(*[F.col(c).cast("string") for c in ("turn_idx", "number") if c in have], F.lit("0"))
    old = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    good = F.col("_label").isNotNull()
    new = {
        "gt_action": F.col("_label"),
        "gt_action_name": tx.action_of_letter(F.col("_label")),
        "chosen_response": F.col("_answer"),
        "target_answer": F.coalesce(old("target_answer", "string"), F.col("_answer")),
        "called_tool_name": F.coalesce(tx.strip(F.get(tx.tool_calls(blocks), F.lit(0))["name"]), F.lit("")),
        "rollout_key": F.concat(F.lit("cm2:"), F.col(row).cast("string"), F.lit(":turn:"), turn),
    }
    values = [F.when(good, v).otherwise(old(n, "string")).alias(n) for n, v in new.items()]
    flag = F.when(good, F.coalesce(old("use_uq_reward", "boolean"), F.lit(True))).otherwise(old("use_uq_reward", "boolean"))
    return step.select(*[c for c in annotations.columns if c not in new and c != "use_uq_reward"], *values, flag.alias("use_uq_reward"))


def annotated_only(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Trajectory rows with at least one annotation of a valid label."""
    good = annotations.where(classify.valid_label(F.col("gt_action")).isNotNull()).select("row_id").distinct()
    return rows.where(classify.is_trajectory_source(F.col("data_source"))).join(good, "row_id", "left_semi")


def extreme_labels(counts: DataFrame) -> DataFrame:
    """Which labels are the rarest and which the most frequent; all of a tie."""
    w = Window.partitionBy()  # four rows
    return counts.select("gt_action", "n", (F.col("n") == F.min("n").over(w)).alias("under"), (F.col("n") == F.max("n").over(w)).alias("over"))
