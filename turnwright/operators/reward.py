"""The reward of a response: format, correctness, alignment and certainty, as one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.functions import classify
from turnwright.functions import semistructured as ss
from turnwright.functions import text as tx
from turnwright.functions import uncertainty as uq
from turnwright.operators.providers import Provider, judged, no_provider, register


@dataclass(frozen=True)
class RewardConfig:
    """Temperature, weight of the certainty, components left out, and whether tool lists are read in OpenAI form too.

    By default a tool list in OpenAI form has only empty names, so that no call is among them."""

    tau: float = 0.10
    lam: float = 1.0
    drop: tuple[str, ...] = ()
    openai_names: bool = False


def tokens_f1(a: Column, b: Column) -> Column:
    return tx.token_f1(a, b)


def alignment(action: Column, answer: Column, gold: Column, tools: Column | None = None, config: RewardConfig = RewardConfig()) -> Column:
    """How well an answer matches the chosen one, 0 to 1, under the gates of its action."""
    pa, ga = tx.strip(F.coalesce(answer, F.lit(""))), tx.strip(F.coalesce(gold, F.lit("")))
    mine, other = tx.tool_name_and_arguments(pa), tx.tool_name_and_arguments(ga)
    empty = lambda c: F.regexp_replace(c["arguments"], r"\s", "") == "{}"
    args = F.when(empty(mine) & empty(other), F.lit(1.0)).otherwise(tx.token_f1(mine["arguments"], other["arguments"]))
    call = 0.5 * F.when(mine["name"] == other["name"], 1.0).otherwise(0.0) + 0.5 * args
    if tools is not None:
        names = F.array_union(ss.flat_tool_names(tools), F.flatten(F.transform(tools, ss.tool_names))) if config.openai_names else ss.flat_tool_names(tools)
        unknown = F.coalesce((F.size(names) > 0) & ~F.array_contains(names, mine["name"]), F.lit(False))
        call = F.when(unknown, 0.0).otherwise(call)
    call = F.when(mine["name"] == "", 0.0).otherwise(call)
    f1 = tx.token_f1(pa, ga)
    ask, refuse = tx.is_question(pa), tx.is_refusal(pa)
    score = (
        F.when((pa == "") | (ga == ""), 0.0)
        .when(action == "tool_call", call)
        .when(action == "request_for_info", F.when(ask, f1).otherwise(0.0))
        .when(action == "cannot_answer", F.when(~ask & refuse, f1).otherwise(0.0))
        .when(action == "direct_answer", f1)
        .otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def format_parts(text: Column, letter: Column) -> dict[str, Column]:
    """Format score and its details."""
    origin, category, suggested = tx.source(text), tx.category(text), tx.suggested_letter(text)
    good = lambda c, value: F.when(F.coalesce(c, F.lit(False)), value).otherwise(0.0)
    consistent = F.coalesce(suggested == letter, F.lit(False))
    score = (
        good(tx.think(text).isNotNull(), 0.5)
        + good(tx.answer(text).isNotNull(), 0.5)
        + good(letter.isNotNull(), 0.3)
        + good(F.length(origin) >= 4, 0.3)
        + good(category.isNotNull(), 0.15)
        + good(consistent, 0.4)
    )
    return {
        "r_fmt": score,
        "suggested_action": F.coalesce(suggested, F.lit("")),
        "self_consistent": consistent,
        "category_match": category.isNotNull(),
        "suggested_category": F.coalesce(category, F.lit("")),
        "answer_category": F.coalesce(category, F.lit("")),
        "source": F.substring(F.coalesce(origin, F.lit("")), 1, 200),
    }


def correctness(letter: Column, gt: Column) -> tuple[Column, Column]:
    """(score, type): 2 exact, 1 on the same side of {A, B} and {C, D}, else 0."""
    missing = letter.isNull() | (F.coalesce(gt, F.lit("")) == "")
    same = letter.isin("A", "B") == gt.isin("A", "B")
    score = F.when(missing, 0.0).when(letter == gt, 2.0).when(same, 1.0).otherwise(0.0)
    kind = F.when(missing, "missing").when(letter == gt, "exact").when(same, "direction").otherwise("wrong")
    return score, kind


def score(
    df: DataFrame,
    keys: list[str],
    text: str = "response",
    gt: str = "gt_letter",
    gold: str | None = "chosen_response",
    tools: str | None = None,
    ppl_gt: str | None = None,
    ppl_neg: str | None = None,
    neg_type: str | None = None,
    uq_value: str | None = None,
    num_turns: str | None = None,
    config: RewardConfig = RewardConfig(),
) -> DataFrame:
    """Keys and the 32 reward columns of each response. An empty response scores 0 and has nulls beyond the first four.

    Steps are chained projections, so that a parsed part is worked out once and everything stays in one stage."""
    null = F.lit(None)
    col = lambda name, kind: (F.col(name) if name else null).cast(kind)
    base = df.select(
        *keys,
        F.col(text).alias("_text"),
        F.upper(tx.strip(F.coalesce(F.col(gt), F.lit("")))).alias("_gt"),
        F.coalesce(col(gold, "string"), F.lit("")).alias("_gold"),
        (F.col(tools) if tools else null.cast("array<string>")).alias("_tools"),
        col(ppl_gt, "double").alias("_pg"),
        col(ppl_neg, "double").alias("_pn"),
        F.coalesce(col(neg_type, "string"), F.lit("")).alias("neg_type"),
        col(uq_value, "double").alias("_uq"),
        F.greatest(F.coalesce(col(num_turns, "long"), F.lit(1)), F.lit(1)).alias("_turns"),
    )
    step = base.withColumn("_letter", tx.letter(F.col("_text"))).withColumn("_answer", tx.answer(F.col("_text")))
    step = step.withColumn("pred_action", tx.action_of_letter(F.col("_letter")))
    for name, value in format_parts(F.col("_text"), F.col("_letter")).items():
        step = step.withColumn(name, value)
    r_cls, kind = correctness(F.col("_letter"), F.col("_gt"))
    ok = F.coalesce(uq.is_finite(F.col("_pg")) & uq.is_finite(F.col("_pn")), F.lit(False))
    step = step.select("*", r_cls.alias("_cls"), kind.alias("cls_type"), ok.alias("_ok"))
    step = step.withColumn("_margin", F.when(F.col("_ok"), F.col("_pn") - F.col("_pg")).otherwise(0.0))
    step = step.withColumn("_cert", uq.certainty(F.col("_margin"), config.tau))
    formed = (tx.strip(F.coalesce("_answer", F.lit(""))) != "") & F.col("_letter").isNotNull()
    aligned = alignment(F.col("pred_action"), F.col("_answer"), F.col("_gold"), F.col("_tools") if tools else None, config)
    step = step.select("*", F.when(formed, aligned).otherwise(0.0).alias("_align"), F.when(formed, F.col("_cert")).otherwise(0.0).alias("_ppl"))
    drop = lambda name, c: F.lit(0.0) if name in config.drop else c
    answer_part = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("_align") + config.lam * F.col("_ppl")))
    step = step.select(
        "*",
        drop("r_fmt", F.col("r_fmt")).alias("_fmt"),
        drop("r_ans", answer_part).alias("_ans"),
        drop("r_cls", F.col("_cls")).alias("_right"),
    )
    most = 2.15 + (1.0 + config.lam) + 2.0
    step = step.withColumn("_raw", F.col("_fmt") + F.col("_ans") + F.col("_cert") * F.col("_right"))
    there = F.coalesce(F.col("_text") != "", F.lit(False))
    four = lambda c: F.round(c, 4)
    out = {
        "raw_score": four(F.col("_raw")),
        "max_score": F.lit(round(most, 4)),
        "r_fmt": four(F.col("_fmt")),
        "r_ans": four(F.col("_ans")),
        "r_align": four(F.col("_align")),
        "r_ppl_action": four(F.col("_ppl")),
        "r_cls": four(F.col("_right")),
        "cert": four(F.col("_cert")),
        "tau": F.lit(round(config.tau, 6)),
        "lambda": F.lit(round(config.lam, 6)),
        "ppl_gt": F.when(F.col("_ok"), F.round("_pg", 6)).otherwise(0.0),
        "ppl_gt_ok": F.col("_ok"),
        "ppl_neg": F.when(F.col("_ok"), F.round("_pn", 6)).otherwise(0.0),
        "ppl_neg_ok": F.col("_ok"),
        "margin": F.round("_margin", 6),
        "neg_type": F.col("neg_type"),
        "drop_components": F.lit(",".join(sorted(config.drop))),
        "cls_type": F.col("cls_type"),
        "letter": F.coalesce("_letter", F.lit("")),
        "pred_action": F.col("pred_action"),
        "suggested_action": F.col("suggested_action"),
        "self_consistent": F.col("self_consistent"),
        "category_match": F.col("category_match"),
        "suggested_category": F.col("suggested_category"),
        "answer_category": F.col("answer_category"),
        "source": F.col("source"),
        "uq_value": four(F.coalesce("_uq", F.lit(0.0))),
        "uq_source": F.when(F.col("_uq").isNotNull(), "runtime_ppl").otherwise("default"),
    }
    return step.select(
        *keys,
        F.when(there, four(F.col("_raw") / max(1e-6, most))).otherwise(0.0).alias("score"),
        F.col("_turns").alias("num_turns"),
        F.col("_turns").alias("max_num_turns"),
        F.lit(True).alias("tool_call_success"),
        *[F.when(there, c).alias(n) for n, c in out.items()],
    )


def sparse_sum(*rewards: DataFrame) -> DataFrame:
    """Sum of sparse rewards (row_id, position, reward); nothing is ever dense."""
    out = rewards[0]
    for r in rewards[1:]:
        out = out.unionByName(r)
    return out.groupBy("row_id", "position").agg(F.sum("reward").alias("reward"))


def last_valid(attention_mask: Column, prompt_length: Column) -> Column:
    """Where a response's last token stands: its tokens that are attended to, less one; 0 without any."""
    own = F.slice(attention_mask, prompt_length + 1, F.greatest(F.size(attention_mask) - prompt_length, F.lit(0)))
    return F.greatest(F.aggregate(own, F.lit(0), lambda n, m: n + m.cast("int")) - 1, F.lit(0))


def turn_rewards(scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """(row_id, turn_idx, position, reward, n, pred_label, gt_label): the weighted mean of each turn's annotation scores at its end.

    ``scores`` has a row an annotation: row_id, turn_idx, position, score, pred_label, gt_label. Labels are those of the
    annotation that comes last in ``number``, if there is such a column."""
    order = F.col("number") if "number" in scores.columns else F.col("gt_label")
    last = lambda c: F.max_by(c, order).alias(c)
    mean = F.avg(F.col("score") * weight).alias("reward")
    return scores.groupBy("row_id", "turn_idx", "position").agg(mean, F.count("score").alias("n"), last("pred_label"), last("gt_label")).where("n > 0")


def row_totals(rewards: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """A row's diagnostics from its turns: used_annotations, raw_sum, and the turns with their scores and labels, by turn.

    With ``annotations`` (row_id of every annotation) rows of which none was scored are there, too, and num_annotations."""
    item = F.struct("turn_idx", F.round("reward", 4).alias("score"), "pred_label", "gt_label")
    out = rewards.groupBy("row_id").agg(
        F.sum("n").alias("used_annotations"), F.round(F.sum("reward"), 4).alias("raw_sum"), F.array_sort(F.collect_list(item)).alias("_turns")
    )
    if annotations is not None:
        counts = annotations.groupBy("row_id").agg(F.count(F.lit(1)).alias("num_annotations"))
        out = counts.join(out, "row_id", "left")
        out = out.withColumn("used_annotations", F.coalesce("used_annotations", F.lit(0))).withColumn("raw_sum", F.coalesce("raw_sum", F.lit(0.0)))
    part = lambda name, kind: F.coalesce(F.transform("_turns", lambda t: t[name]), F.array().cast(f"array<{kind}>"))
    return out.select(
        *[c for c in out.columns if c != "_turns"],
        part("turn_idx", "int").alias("turns"),
        part("score", "double").alias("scores"),
        part("pred_label", "string").alias("pred_labels"),
        part("gt_label", "string").alias("gt_labels"),
    )


def mixed_rewards(rows: DataFrame, checklist: DataFrame, scores: DataFrame, actions: DataFrame, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Sparse rewards (row_id, position, reward) and one row of metrics for every row of a mixed batch.

    ``rows`` has row_id, data_source, attention_mask and prompt_length. A trajectory's reward is that of its checklists
    (``checklist``: row_id, position, reward, from outside) and ``weight`` times its turns' (``scores``, see ``turn_rewards``). A
    single action's is its score (``actions``: row_id, score, metrics) at the last valid token. Metrics of trajectories begin
    with ``cm2_when2call_``; what a branch has no metric for is null, but max_num_turns is 1 and tool_call_success is
    true. Rows of the wrong kind in ``checklist``, ``scores`` and ``actions`` are left out."""
    kind = classify.is_trajectory_source(F.col("data_source"))
    known = rows.select("row_id", kind.alias("_trajectory"), last_valid(F.col("attention_mask"), F.col("prompt_length")).alias("position"))
    mine = lambda df, flag: df.join(known.where(F.col("_trajectory") == flag).select("row_id"), "row_id", "left_semi")
    each = turn_rewards(mine(scores, True), weight)
    ends = actions.join(known.where(~F.col("_trajectory")).select("row_id", "position"), "row_id")
    sparse = sparse_sum(
        mine(checklist, True).select("row_id", F.col("position").cast("int").alias("position"), "reward"),
        each.select("row_id", F.col("position").cast("int").alias("position"), "reward"),
        ends.select("row_id", "position", F.coalesce("score", F.lit(0.0)).alias("reward")),
    )
    totals = row_totals(each, mine(scores, True))
    totals = totals.select("row_id", *[F.col(c).alias(f"cm2_when2call_{c}") for c in totals.columns if c != "row_id"])
    metrics = known.select("row_id").join(totals, "row_id", "left").join(mine(actions, False), "row_id", "left")
    for name, value in (("max_num_turns", F.lit(1)), ("tool_call_success", F.lit(True))):
        metrics = metrics.withColumn(name, F.coalesce(F.col(name), value) if name in metrics.columns else value)
    return sparse, metrics


def pairwise_token_f1(left: DataFrame, right: DataFrame, key: str = "pair_id", text: str = "text") -> DataFrame:
    """Token F1 of long texts by key: both sides' tokens are counted together, in one pass linear in the texts' lengths.

    Texts are dealt by key, as they are, and taken apart after that: tokens are counted where their texts lie."""
    side = lambda df, a, b: df.select(key, F.col(text).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    texts = side(left, 1, 0).unionByName(side(right, 0, 1)).repartition(key)
    tokens = texts.select(key, F.explode(tx.f1_tokens(F.col("t"))).alias("t"), "a", "b")
    both = tokens.groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("inter"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    f1 = F.when((F.col("inter") > 0), 2.0 * F.col("inter") / (F.col("na") + F.col("nb"))).otherwise(0.0)
    pairs = left.select(key).join(right.select(key), key)
    return pairs.join(sums.select(key, f1.alias("f1")), key, "left").select(key, F.coalesce("f1", F.lit(0.0)).alias("f1"))


@register("ppl_uq")
def ppl_uq(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """``score`` under the name by which configurations ask for it."""
    return score(df, keys, **options)


@register("mixed")
def mixed(df: DataFrame, keys: list[str], source: str = "data_source", weight: float = 1.0, **options) -> DataFrame:
    """Rows of trajectories and of single actions, by their source; the scores of trajectories are weighted."""
    flag = "_trajectory"
    scored = score(df.withColumn(flag, classify.is_trajectory_source(F.col(source))), [*keys, flag], **options)
    return scored.withColumn("score", F.when(F.col(flag), F.col("score") * weight).otherwise(F.col("score"))).drop(flag)


def parse_with_judge(df: DataFrame, keys: list[str], text: str, factory: Callable[[], Provider] = no_provider) -> DataFrame:
    """Keys, label, action, answer and thought of turns: from the text's form, else from a judge's complete reply.

    Only turns without label or action are asked about; a reply without a label A to D, an action and an answer
    changes nothing."""
    step = df.select(*keys, F.col(text).alias("_text"), tx.unified_parts(F.col(text)).alias("_p"))
    known = F.when(F.col("_p.label").isNotNull() & F.col("_p.action").isNotNull(), F.lit(True))
    step = step.select(*keys, "_text", known.alias("_known"), *[F.col(f"_p.{c}").alias(c) for c in ("label", "action", "answer", "thought")])
    said = judged(step, "_known", "_text", factory)
    part = lambda name: tx.strip(F.coalesce(F.get_json_object("reply", f"$.{name}"), F.lit("")))
    said = said.select("*", *[part(f"pred_{c}").alias(f"_{c}") for c in ("label", "action", "answer")], part("think").alias("_thought"))
    label = classify.valid_label(F.col("_label"))
    whole = label.isNotNull() & (F.col("_action") != "") & (F.col("_answer") != "")
    pick = lambda name, value: F.when(whole, value).otherwise(F.col(name)).alias(name)
    return said.select(*keys, pick("label", label), pick("action", F.col("_action")), pick("answer", F.col("_answer")), pick("thought", F.col("_thought")))
