"""Operators on small tables: turns, samples, merges, margins, rewards, cells and sources."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from turnwright.functions import semistructured as ss
from turnwright.functions import uncertainty as uq
from turnwright.operators import annotate, margins, merge, reward, sampling, turns
from turnwright.sources import io

MESSAGES = "conv_id long, turn long, role string, content string"


def test_turns(spark):
    rows = [(1, i, r, r[0]) for i, r in enumerate("system user assistant tool assistant user".split())]
    rows += [(2, 0, "assistant", "x"), (2, 1, None, None)]
    turned = turns.user_turns(spark.createDataFrame(rows, MESSAGES))
    got = [r.turn_idx for r in turned.orderBy("conv_id", "turn").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 0, 0]
    prefix = {(r.conv_id, r.turn_idx): r.n_msgs for r in turns.prompt_prefix(turned).collect()}
    assert prefix == {(1, 0): 2, (1, 1): 6, (2, 0): 2}
    arrays = turns.as_arrays(spark.createDataFrame(rows, MESSAGES))
    cut = arrays.select("conv_id", F.size(turns.prefix_of(F.col("messages"), 0)).alias("n")).orderBy("conv_id").collect()
    assert [r.n for r in cut] == [2, 2]
    assert turns.first_assistant(turned).count() == 2


def test_turns_of_nothing(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert turns.summary(turns.user_turns(empty)).count() == 0


def test_balanced_cuts_only_a_and_b(spark):
    notes = [(i, 0, "A") for i in range(30)] + [(i, 0, "B") for i in range(30, 50)] + [(i, 0, "C") for i in range(50, 65)] + [(i, 0, "D") for i in range(65, 70)]
    rows = spark.createDataFrame([(i,) for i in range(80)], "row_id long")
    out = sampling.balanced(rows, spark.createDataFrame(notes, "row_id long, turn_idx int, gt_action string"))
    sizes = {r.bucket: r.n for r in out.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sizes == {None: 10, "A": 5, "B": 5, "C": 15, "D": 5}


def test_ratio_targets():
    counts = {"cm2_x": 50, "cm2_turn_action": 30, "when2call_a": 40, "other": 7}
    assert sampling.ratio_targets(counts, {"cm2": 1.0, "when2call": 1.0}) == {"cm2_x": 25, "cm2_turn_action": 15, "when2call_a": 40}
    assert sampling.parse_ratios("a=3, b = 1") == {"a": 3.0, "b": 1.0}
    for bad in ("a", "a=0", "=1", "a=x"):
        with pytest.raises(ValueError):
            sampling.parse_ratios(bad)
    with pytest.raises(ValueError):
        sampling.ratio_targets(counts, {"absent": 1.0})


def test_split_is_exact_and_disjoint(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(90)], "row_id long, data_source string")
    out = sampling.train_val(rows, val_size=10)
    assert out.count() == 90
    assert out.where("split = 'val'").count() == 10
    again = sampling.train_val(rows.repartition(7), val_size=10)
    assert sorted(map(tuple, out.select("row_id", "split").collect())) == sorted(map(tuple, again.select("row_id", "split").collect()))


@pytest.mark.parametrize("size", [0, 1, 5, 12, 99])
def test_allocation_matches_largest_remainders(spark, size):
    counts = {"a": 5, "b": 3, "c": 3, "d": 1}
    df = spark.createDataFrame(list(counts.items()), "data_source string, n long")
    got = {r.data_source: r.n_val for r in sampling.allocation(df, size).collect()}
    total, size = sum(counts.values()), min(size, sum(counts.values()))
    raw = {s: n * size / total for s, n in counts.items()}
    want = {s: math.floor(x) for s, x in raw.items()}
    for s in sorted(raw, key=lambda s: (raw[s] - want[s], s), reverse=True)[: size - sum(want.values())]:
        want[s] += 1
    assert got == want and sum(got.values()) == size


def test_merges(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "row_id long, gt_action string")
    old = spark.createDataFrame([(1, None), (2, "B"), (3, "C")], "row_id long, gt_action string")
    assert [r.gt_action for r in merge.resume(rows, old).orderBy("row_id").collect()] == ["x", "B", "C"]
    with pytest.raises(ValueError):
        merge.resume(rows, old.limit(2))
    log = spark.createDataFrame([(2, 0, "A"), (2, 5, "D"), (2, 6, None), (9, 1, "A")], "row_id long, line_no long, gt_action string")
    assert [r.gt_action for r in merge.log_merge(rows, log).orderBy("row_id").collect()] == ["x", "D", "z"]
    keyed = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, "c")], "key string, row_no long, v string")
    assert sorted(map(tuple, merge.first_of_key(keyed, "key", "row_no").collect())) == [("k", 1, "a"), ("m", 3, "c")]


def test_margin_table(spark):
    rows = [("g", "A", "A", 2.0), ("g", "B", "A", 4.0), ("g", "", "A", 9.0), ("r", "A", "A", 3.0), ("w", "B", "A", 5.0), ("n", "", "A", 7.0)]
    df = spark.createDataFrame(rows, "group_key string, pred_letter string, gt_letter string, seq_ppl double")
    got = {(r.group_key, r.pred_letter): (r.ppl_gt, r.ppl_neg) for r in margins.filled(df, 1).collect()}
    assert got == {
        ("g", "A"): (2.0, 4.0),
        ("g", "B"): (2.0, 4.0),
        ("g", ""): (2.0, 4.0),
        ("r", "A"): (3.0, 1.0),
        ("w", "B"): (1.0, 5.0),
        ("n", ""): (1.0, 1.0),
    }


def test_uncertainty(spark):
    lp = [math.log(0.5)] * 10
    df = spark.createDataFrame([(lp, [1, 0] * 5)], "lp array<double>, m array<int>")
    row = df.select(
        uq.perplexity(F.col("lp")).alias("p"),
        uq.option_perplexity(F.slice("lp", 1, 4)).alias("o"),
        uq.normalized_perplexity(F.lit(2.5)).alias("n"),
        F.size(uq.unmasked(F.col("lp"), F.col("m"))).alias("k"),
        uq.chosen_uncertainty(F.lit(0.0)).alias("c"),
        uq.sigmoid(F.lit(31.0)).alias("s"),
    ).first()
    assert 1.9 < row.p < 2.1 and row.o == pytest.approx(4.0) and row.n == 0.5 and row.k == 5 and row.c == 0.0 and row.s == 1.0


def test_hash_share_and_random_negative(spark):
    import hashlib
    import random

    keys = [f"idx:{i}" for i in range(200)]
    df = spark.createDataFrame([(k, "ABCD"[i % 4]) for i, k in enumerate(keys)], "k string, gt string")
    got = df.select("k", "gt", uq.hash_share(F.col("k")).alias("u"), uq.random_negative("gt", "k").alias("n")).collect()
    for r in got:
        digest = hashlib.md5(r.k.encode()).digest()
        assert r.u == int.from_bytes(digest[:8], "big") / float(2**64)
        rng = random.Random(int(hashlib.md5((r.k + r.gt).encode()).hexdigest()[:8], 16))
        assert r.n == rng.choice([x for x in "ABCD" if x != r.gt])


def test_reward(spark):
    good = "<think>source=known fact suggested_action=direct_answer<A></think>\ndirect_answer<A>\n<answer>Paris</answer>"
    df = spark.createDataFrame([(1, good, "A", "Paris"), (2, "", "A", "x"), (3, None, "A", "x"), (4, "no idea", "D", "x")], "id int, response string, gt_letter string, chosen_response string")
    rows = {r.id: r for r in reward.score(df, ["id"]).collect()}
    r = rows[1]
    assert (r.r_fmt, r.r_align, r.cert, r.r_ans, r.r_cls) == (2.15, 1.0, 0.5, 1.5, 2.0)
    assert r.score == round((2.15 + 1.5 + 0.5 * 2) / 6.15, 4) and len(r) == 33
    assert rows[2].score == 0.0 and rows[2].letter is None and rows[3].score == 0.0
    assert rows[4].cls_type == "missing" and rows[4].pred_action == ""


def test_alignment_gates(spark):
    call = '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'
    rows = [("tool_call", call, call, ['{"name":"f"}']), ("tool_call", call, call, ['{"name":"g"}']), ("tool_call", call, call, ['{"function":{"name":"f"}}']), ("request_for_info", "tell me", "tell me", None), ("cannot_answer", "sorry no", "sorry no", None)]
    df = spark.createDataFrame(rows, "a string, p string, g string, t array<string>")
    cols = [F.col(c) for c in "apg"]
    strict = [r.v for r in df.select(reward.alignment(*cols, F.col("t")).alias("v")).collect()]
    assert strict == [1.0, 0.0, 0.0, 0.0, 1.0]
    loose = df.select(reward.alignment(*cols, F.col("t"), reward.RewardConfig(openai_names=True)).alias("v")).collect()
    assert loose[2].v == 1.0


def test_pairwise_f1_equals_in_row_f1(spark):
    from turnwright.functions.text import token_f1

    rows = [(1, "a b b", "b b c"), (2, "", "x"), (3, "?", "!"), (4, "one", "one")]
    df = spark.createDataFrame(rows, "pair_id int, l string, r string")
    one = {r.pair_id: r.v for r in df.select("pair_id", token_f1(F.col("l"), F.col("r")).alias("v")).collect()}
    two = reward.pairwise_token_f1(df.select("pair_id", F.col("l").alias("text")), df.select("pair_id", F.col("r").alias("text")))
    assert {r.pair_id: r.f1 for r in two.collect()} == pytest.approx(one)


def test_cells(spark):
    cells = ['{"a":1}', "[1,2]", '"s"', "", "bad", "NaN", '{"a":1,"a":2}', None, "3", "true", "null"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", ss.kind(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == ["object", "array", "string", "invalid", "invalid", "invalid", "invalid", "invalid", "number", "boolean", "null"]


def test_object_in_text(spark):
    texts = ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":{"b":"}"}} end', "none", '[{"a":1},{"a":3}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", ss.object_in_text("t").alias("v")).orderBy("i").collect()]
    # Braces are tried from the right: the inner object comes first.
    assert got == ['{"a": 1}', '{"a": 2}', '{"b": "}"}', None, '{"a": 3}']


def test_parse_reply(spark):
    reply = 'Here: {"annotations":[{"turn_idx":1,"gt_action":"b"},{"turn_idx":0,"gt_action":"C ","relevant_tools":["x"," "]},{"turn_idx":"z","gt_action":"A"}]}'
    row = spark.createDataFrame([(reply,)], "r string").select(annotate.parse_reply(F.col("r")).alias("a")).first()
    assert [(a.turn_idx, a.gt_action, a.relevant_tools) for a in row.a] == [(0, "C", ["x"]), (1, "B", [])]


def test_jsonl_numbers_physical_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":1}\n\nbad\n  {"a":2}\n')
    got = [(r.idx, r.ok) for r in io.read_jsonl(spark, str(path)).orderBy("idx").collect()]
    assert got == [(0, True), (2, False), (3, True)]


def test_json_array_reader(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"data": [{"a": 1}, {"a": 2}]}')
    bad.write_text('{"x": 1}')
    assert io.read_json_array(spark, str(good)).count() == 2
    with pytest.raises(Exception, match="expected a JSON list"):
        io.read_json_array(spark, str(bad)).collect()


def test_paths_and_configuration(tmp_path):
    assert io.suffixed_path("/a/b.json") == "/a/b_forverl.json"
    assert io.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        io.read_config(str(tmp_path / "c.json"))


def test_stream_emits_each_member_once(spark, tmp_path):
    from turnwright.streaming.group_margin import drain, group_margins

    rows = [(i, f"g{i % 3}", "A" if i % 2 else "B", "A", float(i + 1)) for i in range(14)]
    df = spark.createDataFrame(rows, "event_id long, group_key string, pred_letter string, gt_letter string, seq_ppl double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = group_margins(stream, expected=4, timeout_ms=800).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    drain(job.option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").start(), 800)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.event_id for r in out) == list(range(14))
    assert {r.margin_source for r in out} == {"group_rollout:complete", "group_rollout:timeout"}


def test_drain_waits_for_all_groups_and_raises(spark, tmp_path, monkeypatch):
    from turnwright.streaming import group_margin

    clock = [0.0]

    class Slow:
        """Reads for 100 seconds, then holds groups for another 100."""

        isActive, stopped = True, None

        @property
        def lastProgress(self):
            if clock[0] < 1:
                return None
            return {"numInputRows": int(clock[0] < 100), "stateOperators": [{"numRowsTotal": int(clock[0] < 200)}]}

        def exception(self):
            return None

        def stop(self):
            self.stopped = clock[0]

    with monkeypatch.context() as m:
        m.setattr(group_margin.time, "time", lambda: clock[0])
        m.setattr(group_margin.time, "sleep", lambda s: clock.__setitem__(0, clock[0] + s))
        job = Slow()
        group_margin.drain(job, 1000)
        assert job.stopped >= 200
        Slow.isActive = False
        with pytest.raises(RuntimeError):
            group_margin.drain(Slow(), 1000)

    def broken(batch, number):
        raise ValueError("no sink")

    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    job = stream.writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "marks")).start()
    with pytest.raises(Exception, match="no sink"):
        group_margin.drain(job, 200)


@pytest.mark.parametrize("cell", [10_000, 3])
def test_limits_are_exact_without_sorting_whole_values(spark, monkeypatch, cell):
    """The same rows by cells of a key's first digits as by sorting; ties and nulls too."""
    import hashlib

    monkeypatch.setattr(sampling, "CELL_ROWS", cell)
    rows = [(i % 70 if i < 90 else i, "abc"[min(i % 5, 2)] if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, data_source string")
    limits = {"a": 7, "b": 0, "c": 60, "none": 3}
    got = sampling.first_rows(df, "data_source", limits, sampling.shuffle_key(42), 200).collect()
    assert len(got) == 200
    for source, n in limits.items():
        mine = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, s in rows if s == source)
        chosen = sorted((hashlib.md5(f"42:{r.row_id}".encode()).hexdigest(), r.row_id) for r in got if r.data_source == source and r._first)
        assert chosen == mine[:n]
    assert all(r._first is None for r in got if r.data_source is None)
    assert sampling.smallest(df, "data_source", limits, sampling.shuffle_key(42), 200).count() == 200 - sum(1 for _, s in rows if s) + sum(min(n, sum(s == k for _, s in rows)) for k, n in limits.items())


def greedy(notes, counts, most):
    """One row's choice, as a plain loop."""
    left = sorted({(t, g): p for t, g, p in sorted(notes, key=lambda x: -annotate.TYPE_RANK.get(x[2], 4))}.items())
    left, taken, running = [(t, g, p) for (t, g), p in left], [], dict(counts)
    while left and (most <= 0 or len(taken) < most):
        best = min(left, key=lambda a: (running.get(a[1], 0), annotate.TYPE_RANK.get(a[2], 4), a[0], a[1]))
        left.remove(best)
        taken.append(best[:2])
        running[best[1]] = running.get(best[1], 0) + 1
    return taken


def test_greedy_choices(spark, tmp_path):
    """Up to three annotations by snapshot, and in batches whose counts go on."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.choice("ABCD"), rng.choice(["high", "low", "x"])) for i in range(60) for _ in range(rng.randrange(6))]
    df = spark.createDataFrame(rows, "row_id long, turn_idx int, gt_action string, uq_target_type string")
    by = {}
    for i, *note in rows:
        by.setdefault(i, []).append(tuple(note))
    for most in (0, 1, 3):
        counts = {"A": 5, "B": 4, "C": 4}
        got = sorted((r.row_id, r.turn_idx, r.gt_action) for r in annotate.balanced_some(df, counts, most).collect())
        assert got == sorted((i, *x) for i, notes in by.items() for x in greedy(notes, counts, most))
    now, want = {}, []
    for batch in range(6):
        chosen = [(i, *x) for i in sorted(by) if i // 10 == batch for x in greedy(by[i], now, 2)]
        for _, _, g in chosen:
            now[g] = now.get(g, 0) + 1
        want += chosen
    got = annotate.balanced_running(df, F.floor(F.col("row_id") / 10), str(tmp_path / "a"), most=2).collect()
    assert sorted((r.row_id, r.turn_idx, r.gt_action) for r in got) == sorted(want)
    assert annotate.balanced_running(df.where("false"), F.lit(0), str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception, match="without a batch"):
        annotate.balanced_running(df, F.lit(None), str(tmp_path / "c"))


def test_required_fields(spark):
    rows = spark.createDataFrame([(1, "t", "m"), (2, None, None), (3, "t", "")], "id long, tools string, messages string")
    assert [r.id for r in merge.with_required(rows.where("id < 3"), F.col("tools").isNotNull(), "id", "messages").collect()] == [1]
    with pytest.raises(Exception, match="a row without messages"):
        merge.with_required(rows, F.col("tools").isNotNull(), "id", "messages").collect()


def test_scorers_by_name(spark):
    from turnwright.operators import providers

    df = spark.createDataFrame([(1, "cm2", "A"), (2, "when2call", "A")], "id int, data_source string, gt_letter string")
    df = df.withColumn("response", F.lit("direct_answer<A> <answer>x</answer>")).withColumn("chosen_response", F.lit("x"))
    one = {r.id: r.score for r in providers.scorer("ppl_uq")(df, ["id"]).collect()}
    two = {r.id: r.score for r in providers.scorer("mixed")(df, ["id"], weight=0.25).collect()}
    assert one[1] == one[2] > 0 and two == {1: one[1] * 0.25, 2: one[2]}
    with pytest.raises(ValueError, match="no scorer"):
        providers.scorer("absent")
    with pytest.raises(ValueError, match="registered already"):
        providers.register("mixed")(lambda df: df)


def test_turns_parsed_by_a_judge(spark):
    """A judge is asked about what has no form, and only whole replies count."""
    import json

    replies = {"half": {"pred_label": "A", "pred_action": "direct_answer"}, "whole": {"pred_label": "c", "pred_action": "request_for_info", "pred_answer": "x?", "think": " t "}, "bad": "no"}

    def judge():
        return lambda requests: [json.dumps(replies[r["prompt"]]) if r["prompt"] in replies else 1 / 0 for r in requests]

    df = spark.createDataFrame([(1, "half"), (2, "whole"), (3, "bad"), (4, "tool_call<B> <answer>y</answer>"), (5, None)], "id int, text string")
    got = {r.id: tuple(r)[1:] for r in reward.parse_with_judge(df.where("id < 5"), ["id"], "text", judge).collect()}
    assert got == {1: (None, None, "half", None), 2: ("C", "request_for_info", "x?", "t"), 3: (None, None, "bad", None), 4: ("B", "tool_call", "y", None)}
    assert reward.parse_with_judge(df, ["id"], "text").count() == 5


def test_json_array_sink(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, {"k": ["é"]}) for i in range(7)], "id int, m map<string,array<string>>").repartition(3)
    io.write_json_array(df, str(tmp_path / "a.json"))
    text = (tmp_path / "a.json").read_text()
    want = [json.loads(r) for r in df.toJSON().collect()]
    assert text == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    assert "".join(io.json_array(df.where("false"))) == "[]\n"


def test_pairwise_f1_deals_texts_and_not_tokens(spark):
    """One shuffle of whole texts: tokens are counted where their texts lie; keys may repeat, texts be null or empty."""
    left = spark.createDataFrame([(1, "a b b C"), (2, None), (3, "x"), (4, "q q"), (4, "r"), (5, "")], "pair_id long, text string")
    right = spark.createDataFrame([(1, "B b c d"), (2, "a"), (3, "y"), (4, "q r s"), (6, "only")], "pair_id long, text string")
    out = reward.pairwise_token_f1(left, right)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(pair_id#\d+L, t#", plan)
    assert sorted((r.pair_id, round(r.f1, 6)) for r in out.collect()) == [(1, 0.75), (2, 0.0), (3, 0.0), (4, 0.666667), (4, 0.666667)]
