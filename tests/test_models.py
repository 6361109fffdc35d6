"""Calls of models: bounded queues, saved replies, sentences over tokens, the ladder of scores, objects in replies, prompt limits."""

from __future__ import annotations

import json
import math
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from turnwright.functions import semistructured as ss
from turnwright.operators import margins, prompts, providers


def counting(folder):
    """A slow provider that notes how many calls are under way, and every prompt, in files."""

    def factory():
        lock, under_way = threading.Lock(), [0]

        def ask(requests):
            with lock:
                under_way[0] += 1
                with open(f"{folder}/peak-{os.getpid()}", "a") as f:
                    f.write(f"{under_way[0]}\n")
            time.sleep(0.3 if requests[0]["prompt"].endswith("0") else 0.01)
            with lock:
                under_way[0] -= 1
                with open(f"{folder}/asked-{os.getpid()}-{threading.get_ident()}", "a") as f:
                    f.writelines(r["prompt"] + "\n" for r in requests)
            return [r["prompt"].upper() for r in requests]

        return ask

    return factory


def lines(folder, kind):
    return [x for f in os.listdir(folder) if f.startswith(kind) for x in open(f"{folder}/{f}").read().split()]


def test_calls_are_bounded_and_do_not_wait_for_slow_ones(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(300)], "id long, prompt string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        out = providers.calls(df, "prompt", counting(str(tmp_path)), workers=4, batch=1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.id, r.reply) for r in out} == {(i, f"P{i}") for i in range(300)} and len(out) == 300
    assert max(map(int, lines(tmp_path, "peak"))) == 4
    # Thirty slow calls run beside each other and beside the quick ones of later batches.
    order = [r.id for r in out]
    assert order != sorted(order) and set(order[:30]) != set(range(30))


def test_answered_rows_go_back_together(spark):
    """Requests stay small, and their rows do not become a batch each on the way back; other columns are unchanged."""
    df = spark.range(0, 900, 1, 1).selectExpr("id", "concat('p', id) as prompt", "if(id % 2 = 0, id, null) as half", "array(named_struct('a:b', id)) as cell")
    asked = providers.calls(df, "prompt", lambda: lambda requests: [str(len(requests))] * len(requests), batch=8)
    sizes = asked.select("id").mapInArrow(lambda parts: (b.from_pydict({"n": [b.num_rows]}) for b in parts), "n long")
    assert {r.reply for r in asked.collect()} <= {"8", "4"} and asked.drop("reply").exceptAll(df).count() == 0
    assert max(r.n for r in sizes.collect()) > 100


def test_saved_replies_outlive_a_failure(spark, tmp_path):
    """A run that dies keeps the parts that were done; the next one asks for the others only."""
    rows = [(i, f"p{i}") for i in range(60)] + [(5, "p5"), (None, "none")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    path, notes = str(tmp_path / "saved"), str(tmp_path)
    calm = counting(notes)

    def deadly():
        def ask(requests):
            if any(r["prompt"] == "p7" for r in requests):
                os._exit(3)
            return calm()(requests)

        return ask

    with pytest.raises(Exception):
        providers.saved_calls(df, "id", "prompt", path, deadly, every=10, batch=4)
    kept = set(spark.read.parquet(f"{path}/replies/*").toPandas().id) if os.path.isdir(f"{path}/replies") else set()
    asked = len(lines(tmp_path, "asked"))
    out = providers.saved_calls(df, "id", "prompt", path, calm, every=10, batch=4).collect()
    assert {(r.id, r.reply) for r in out} == {(i, f"P{i}") for i in range(60)} | {(None, None)} and len(out) == 62
    assert len(lines(tmp_path, "asked")) == asked + 60 - len(kept) and 7 not in kept
    half = providers.saved_calls(df, "id", "prompt", str(tmp_path / "other"), lambda: lambda rs: [None if r["prompt"] == "p3" else "x" for r in rs])
    assert half.where("reply is null").count() == 2
    assert providers.saved_calls(df, "id", "prompt", str(tmp_path / "other"), lambda: lambda rs: ["late"] * len(rs)).where("reply = 'late'").count() == 1


def sentence_scores(text, pieces, nlls):
    """By the definition: ranges by search, every token against every sentence."""
    use = min(len(pieces), len(nlls))
    at, ranges = 0, []
    for p in pieces[:use]:
        found = text.find(p, at) if p else at
        found = at if found < 0 else found
        ranges.append((found, found + len(p)))
        at = found + len(p)
    spans, start = [], 0
    for i, c in enumerate(text + "\n"):
        if c in ".!?;\n" or i == len(text):
            if text[start : i + 1].strip():
                spans.append((start, min(i + 1, len(text))))
            start = i + 1
    out = []
    for n, (a, b) in enumerate(spans):
        mine = [nlls[i] for i, (x, y) in enumerate(ranges) if y > a and x < b]
        if mine:
            out.append((n, math.exp(sum(mine) / len(mine)), sum(mine) / len(mine), len(mine)))
    return out


def test_sentence_perplexities(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ["One two. Three!four five", "", "   ", "a;b c\nd", "x", "naïve 日本語. straße?!  \n\n end", "no end mark", "…! 🙂🙃. ok", ". . .", "word " * 3000 + "."]
    texts += ["".join(rng.choice("ab .!?;\né🙂") for _ in range(80)) for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        pieces = [tokenizer.decode([x], skip_special_tokens=False) for x in ids]
        if i % 7 == 3:
            pieces[:1] = ["not in the text"]
        rows.append((i, t, pieces, [rng.random() for _ in pieces][: len(pieces) - (i % 5 == 1)]))
    rows += [(900, None, ["a"], [0.5]), (901, "a.", None, [0.5]), (902, "a.", ["a"], None)]
    df = spark.createDataFrame(rows, "id long, t string, pieces array<string>, nlls array<double>")
    out = providers.sentence_perplexities(df, "id", "t", "pieces", "nlls").collect()
    got = sorted((r.id, r.sentence, r.ppl, r.nll, r.token_count) for r in out)
    want = sorted((i, *s) for i, t, p, n in rows if t and p and n for s in sentence_scores(t, p, n))
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    assert all(g[2:4] == pytest.approx(w[2:4]) for g, w in zip(got, want)) and len(want) > 100


def test_ladder(spark, tmp_path):
    """Each row by hand: own, strict where routed and open, then its group among the rows that are still open."""
    rng = random.Random(2)
    rows = [(f"k{i}", f"g{i % 7}", rng.choice(["A", "B", "C", "D", ""]), rng.choice("ABCD"), rng.choice([None, 1.5, 2.0 + i / 10])) for i in range(200)]
    df = spark.createDataFrame(rows, "rollout_key string, group_key string, pred_letter string, gt_letter string, seq_ppl double")
    asked = []

    def strict(part):
        asked.extend((r.rollout_key, r.letter) for r in part.collect())
        return part.withColumn("strict_ppl", F.when(F.ascii("rollout_key") + F.length("rollout_key") % 2 > 0, F.length("rollout_key") + F.ascii("letter") / 100))

    out = {r.rollout_key: r for r in margins.ladder(df, strict, str(tmp_path), expected=5, tau=0.3, weight=2.0).collect()}
    known = {r.rollout_key: r for r in df.select("rollout_key", F.expr("md5(rollout_key)").alias("h")).collect()}
    state, wanted = {}, set()
    for k, g, p, t, own in rows:
        u = int(known[k].h[:16], 16) / 2**64
        way = "hard" if u < 0.25 else "random" if u < 0.5 else "none"
        neg = out[k].neg_letter
        assert (neg is None) == (way == "none") and neg != t
        a, b = own if p and p == t else None, own if p and p != t else None
        if way != "none":
            wanted |= {(k, x) for x, v in ((t, a), (neg, b)) if v is None}
            a = len(k) + ord(t) / 100 if a is None else a
            b = len(k) + ord(neg) / 100 if b is None else b
        state[k] = way, g, p, t, own, a, b
    assert set(asked) == wanted and len(asked) == len(wanted)
    for k, (way, g, p, t, own, a, b) in state.items():
        source = "neutral" if way == "none" else way
        if a is None or b is None:
            mine = [s for s in state.values() if s[1] == g and (s[5] is None or s[6] is None)]
            right = [s[4] for s in mine if s[2] and s[2] == s[3] and s[4] is not None]
            wrong = [s[4] for s in mine if s[2] and s[2] != s[3] and s[4] is not None]
            a = a if a is not None else sum(right) / len(right) if right else 1.0
            b = b if b is not None else sum(wrong) / len(wrong) if wrong else 1.0
            source = "group_rollout:complete" if len(mine) >= 5 else "group_rollout:partial"
        r = out[k]
        assert (r.ppl_gt, r.ppl_neg, r.margin) == pytest.approx((a, b, b - a), abs=2e-6)
        assert (r.margin_source, r.neg_type, r.tau, r["lambda"]) == (source, way, 0.3, 2.0)
    alone = margins.ladder(df, expected=1).where("rollout_key = 'k0'").first()
    assert alone.margin_source in ("neutral", "hard", "random") and (alone.ppl_gt is None or alone.ppl_neg is None) and alone.margin == 0.0


def from_the_right(text):
    """Every brace from the right, matched character by character."""
    as_object = lambda v: v if isinstance(v, dict) else next((x for x in reversed(v) if isinstance(x, dict)), None) if isinstance(v, list) else None
    for start in (i for i in range(len(text) - 1, -1, -1) if text[i] == "{"):
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        if (v := as_object(json.loads(text[start : end + 1]))) is not None:
                            return v
                    except ValueError:
                        pass
                    break
    return None


def test_object_in_text(spark):
    rng = random.Random(11)
    texts = ['Here: {"a": {"b": 1}} done', 'x {"a":{"b":1}} y {"c":{"d":2}} {', '{"a":1} {bad}', "}{", '{"k": "{}"}x', '{"k": "{x}"}', 'a {"k": "\\"{"} b', 'z {"n": NaN} {"m": [1, {"q": "}"}]}']
    texts += ["".join(rng.choice(['{', '}', '"', "\\", '"a":', "1", ",", " ", '{"b": 2}', "{}", '"{"']) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    df = spark.createDataFrame([(i, "! " + t) for i, t in enumerate(texts)], "i int, t string")
    got = [None if r.v is None else json.loads(r.v) for r in df.select("i", ss.object_in_text("t").alias("v")).orderBy("i").collect()]
    assert list(map(repr, got)) == [repr(from_the_right("! " + t)) for t in texts]
    whole = ['{"a": {"b": 1}}', '[{"a": 1}, {"b": 2}, 3]', 'see ```json\n{"a": {"c": 1}}\n``` or ``` {"z" ``` {"y": 1}']
    want = [{"a": {"b": 1}}, {"b": 2}, {"a": {"c": 1}}]
    df = spark.createDataFrame(list(enumerate(whole)), "i int, t string")
    assert [json.loads(r.v) for r in df.select("i", ss.object_in_text("t").alias("v")).orderBy("i").collect()] == want


def test_object_among_many_braces():
    """Linear in the text: megabytes of braces, open, closed, nested and quoted."""
    import pandas as pd

    n = 1 << 20
    texts = ["{" * n + '{"a":1}' + "}" * 5, "x" + "{" * n + "}" * n, '{"a":' * (n // 5) + "1" + "}" * (n // 5 - 1) + " z", "x" + '{"' * (n // 2), '! {"a": "' + "{" * 1000 + '"}']
    began = time.perf_counter()
    got = ss.object_in_text.func(pd.Series(texts))
    assert time.perf_counter() - began < 30
    assert list(got[:2]) == ['{"a": 1}', "{}"] and got[2] == '{"a": 1}' and got[3] is None and json.loads(got[4])


def test_prompt_limit(spark):
    assert prompts.prompt_limit(500) == 500 and prompts.prompt_limit(500, 100, {"ROLLOUT_MAX_MODEL_LEN": "x"}) == 500
    assert prompts.prompt_limit(500, 100, {"ROLLOUT_MAX_MODEL_LEN": "550", "ROLLOUT_MAX_BATCHED_TOKENS": "900"}) == 450
    assert prompts.prompt_limit(500, None, {"ROLLOUT_MAX_BATCHED_TOKENS": "300"}) == 300 == prompts.prompt_limit(500, "bad", {"ROLLOUT_MAX_BATCHED_TOKENS": "300"})
    assert prompts.prompt_limit(500, 900, {"ROLLOUT_MAX_MODEL_LEN": "550"}) == 1
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["", "one two three", "naïve 日本語", "word " * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n_tokens for r in prompts.within_limit(df, prompts.token_length(path)("t"), 4000).collect()}
    size = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts) if t is not None}
    assert got == {i: n for i, n in size.items() if n <= 4000} and 3 not in got and 4 not in got


def test_mixed_rewards(spark):
    """Rows by hand: checklists and turns of trajectories, single actions at the last valid token, metrics of either kind."""
    from turnwright.operators import reward

    rows = [(1, "cm2_main", [1, 1, 1, 1, 0], 2), (2, "when2call", [0, 1, 1, 1, 0], 2), (3, "when2call", [1, 1, 0, 0, 0], 2), (4, "cm2_main", [], 0), (5, "when2call", None, 1)]
    rows = spark.createDataFrame(rows, "row_id long, data_source string, attention_mask array<int>, prompt_length int")
    checks = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.25), (2, 0, 9.0)], "row_id long, position int, reward double")
    scores = [(1, 0, 3, 0.2, "A", "A", 0), (1, 0, 3, 0.6, "B", "C", 1), (1, 1, 7, 1.0, None, "D", 2), (2, 0, 1, 9.0, "A", "A", 0), (4, 0, 2, None, "A", "A", 0)]
    scores = spark.createDataFrame(scores, "row_id long, turn_idx int, position int, score double, pred_label string, gt_label string, number int")
    actions = spark.createDataFrame([(2, 0.7, "x"), (3, None, "y"), (5, 0.1, "z"), (1, 9.0, "no")], "row_id long, score double, letter string")
    sparse, metrics = reward.mixed_rewards(rows, checks, scores, actions, weight=0.5)
    got = {(r.row_id, r.position): r.reward for r in sparse.collect()}
    assert got == {(1, 0): 0.5, (1, 3): pytest.approx(0.45), (1, 7): 0.5, (2, 1): 0.7, (3, 0): 0.0, (5, 0): 0.1}
    m = {r.row_id: r for r in metrics.collect()}
    assert set(m) == {1, 2, 3, 4, 5} and all(r.max_num_turns == 1 and r.tool_call_success for r in m.values())
    one = m[1]
    assert (one.cm2_when2call_used_annotations, one.cm2_when2call_num_annotations, one.cm2_when2call_raw_sum, one.letter) == (3, 3, 0.7, None)
    assert (one.cm2_when2call_turns, one.cm2_when2call_scores) == ([0, 1], [0.2, 0.5])
    assert (one.cm2_when2call_pred_labels, one.cm2_when2call_gt_labels) == (["B", None], ["C", "D"])
    assert (m[4].cm2_when2call_used_annotations, m[4].cm2_when2call_num_annotations, m[4].cm2_when2call_turns) == (0, 1, [])
    assert (m[2].score, m[2].letter, m[2].cm2_when2call_used_annotations) == (0.7, "x", None)


def test_token_ids(spark):
    from turnwright.functions import uncertainty as uq

    cells = ["[1,2]", "[[3,4],[5]]", "[[[6]]]", '{"input_ids":[7,"8"," +9 "]}', '{"input_ids":[[1.9,-2.5,true]]}', "[]", "[[]]", "[1,null]", '["x"]', '{"other":[1]}', "5", '"[1]"', "bad", None, '[{"a":1}]', "[1e400]"]
    want = [[1, 2], [3, 4], [6], [7, 8, 9], [1, -2, 1]] + [[]] * 11
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    assert [r.v for r in df.select("i", uq.token_ids(F.col("c")).alias("v")).orderBy("i").collect()] == want


def test_sequence_summary(spark):
    from turnwright.functions import uncertainty as uq

    rows = [([-1.0, -3.0, -5.0], [1, 0, 1]), ([-1.0, -3.0], [1, 1, 1]), ([-1.0], [0]), ([], []), (None, None), ([-2.0, -4.0], [1])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lp array<double>, mask array<int>")
    got = [tuple(r.s) for r in df.select("i", uq.sequence_summary(F.col("lp"), F.col("mask")).alias("s")).orderBy("i").collect()]
    want = [(3.0, math.exp(3), 2), (2.0, math.exp(2), 2), (0.0, 0.0, 0), (0.0, 0.0, 0), (0.0, 0.0, 0), (2.0, math.exp(2), 1)]
    assert got == [pytest.approx(w) for w in want]
    assert tuple(df.select(uq.sequence_summary(F.col("lp")).alias("s")).first().s) == pytest.approx((3.0, math.exp(3), 3))


def test_enriched_rows(spark):
    from turnwright.operators import annotate

    rows = [
        (1, 0, "b", None, '{"name": "f", "arguments": "{\\"x\\": 1}"}', None, False),
        (1, None, None, "D", "Sorry.", "kept", None),
        (2, 3, "E", None, "as it is", None, None),
        (2, 4, None, None, None, None, None),
        (3, 5, "A", None, None, "from target", None),
    ]
    df = spark.createDataFrame(rows, "row_id long, turn_idx int, gt_action string, label string, chosen_response string, target_answer string, use_uq_reward boolean")
    df = df.withColumn("number", F.lit(9)).withColumn("extra", F.col("row_id") * 2)
    got = {(r.row_id, r.turn_idx): r for r in annotate.enriched_rows(df).collect()}
    block = '<tool_call>\n{"arguments": {"x": 1}, "name": "f"}\n</tool_call>'
    part = lambda r: (r.gt_action, r.gt_action_name, r.chosen_response, r.target_answer, r.called_tool_name, r.rollout_key, r.use_uq_reward)
    assert part(got[(1, 0)]) == ("B", "tool_call", block, block, "f", "cm2:1:turn:0", False)
    assert part(got[(1, None)]) == ("D", "cannot_answer", "Sorry.", "kept", "", "cm2:1:turn:9", True)
    assert part(got[(2, 3)]) == ("E", None, "as it is", None, None, None, None)
    assert part(got[(2, 4)]) == (None,) * 7
    assert part(got[(3, 5)]) == ("A", "direct_answer", "from target", "from target", "", "cm2:3:turn:5", True)
    assert all(r.extra == 2 * r.row_id for r in got.values())
