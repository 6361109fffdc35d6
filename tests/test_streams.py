"""Streams with state: waiting groups, whole conversations, and logs that replays do not double."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from turnwright.operators import margins
from turnwright.streaming.group_margin import drain, expected_size, group_margins
from turnwright.streaming.labelling import label_stream, whole_conversations
from turnwright.streaming.waiting import expiry_ms, start_available

ROLLOUTS = "event_id long, group_key string, pred_letter string, gt_letter string, seq_ppl double"


def put(spark, rows, schema, path, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={number}")


def feed(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def start(df, out, marks, every=None):
    to = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append")
    return to.trigger(processingTime=every).start() if every else start_available(to, df.sparkSession)


def test_groups_complete_and_time_out(spark, tmp_path):
    """The members of a complete group and of one that times out have the margins of the batch form."""
    rows = [(i, f"g{i % 3}", "AB C"[i % 4].strip(), "A", None if i == 4 else float(i + 1)) for i in range(11)]
    put(spark, rows, ROLLOUTS, str(tmp_path / "in"), 0)
    job = start(group_margins(feed(spark, ROLLOUTS, str(tmp_path / "in")), 4, 800), str(tmp_path / "out"), str(tmp_path / "marks"), "200 milliseconds")
    drain(job, 800)
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r for r in margins.filled(spark.createDataFrame(rows, ROLLOUTS)).collect()}
    assert len(got) == 11 and {r.group_key: r.margin_source for r in got.values()} == {
        "g0": "group_rollout:complete", "g1": "group_rollout:complete", "g2": "group_rollout:timeout"
    }
    for i, r in got.items():
        assert (r.ppl_gt, r.ppl_neg) == pytest.approx((want[i].ppl_gt, want[i].ppl_neg))


def test_late_members_and_restart(spark, tmp_path):
    """A restart goes on with the members that wait; each is emitted once, and late ones open a group of their own."""
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    run = lambda timeout, every=None: start(group_margins(feed(spark, ROLLOUTS, source), 3, timeout), out, marks, every)
    member = lambda i: (i, "g", "A", "A", float(i))
    put(spark, [member(1), member(2)], ROLLOUTS, source, 1)
    run(600_000).awaitTermination()
    assert spark.read.schema("event_id long").parquet(out).count() == 0
    # One that comes again takes its own place, so that the third member completes the group; a fourth is late.
    put(spark, [member(2), member(3), member(4)], ROLLOUTS, source, 2)
    run(600_000).awaitTermination()
    done = {r.event_id: r.margin_source for r in spark.read.parquet(out).collect()}
    assert done == dict.fromkeys((1, 2, 3), "group_rollout:complete")
    put(spark, [(9, "other", "B", "A", 2.0)], ROLLOUTS, source, 3)
    job = run(300, "100 milliseconds")
    for _ in range(200):
        time.sleep(0.1)
        if spark.read.parquet(out).where("event_id = 9").count():
            break
    job.stop()
    rows = [(r.event_id, r.margin_source) for r in spark.read.parquet(out).collect()]
    # The late member's timer was set for ten minutes: it still waits.
    assert sorted(rows) == [(i, "group_rollout:complete") for i in (1, 2, 3)] + [(9, "group_rollout:timeout")]


def test_rows_do_not_join_an_expired_group(spark, tmp_path, monkeypatch):
    """After a stop longer than the expiry an old group is finished before new rows of its key are taken."""
    from turnwright.streaming import waiting

    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    run = lambda: start(group_margins(feed(spark, ROLLOUTS, source), 2, 100), out, marks).awaitTermination()
    put(spark, [(1, "g", "A", "A", 1.0)], ROLLOUTS, source, 1)
    run()
    assert expiry_ms(100) == 5_000 and expiry_ms(2_000) == 20_000
    time.sleep(5.5)
    put(spark, [(2, "g", "A", "A", 4.0), (3, "g", "B", "A", 8.0)], ROLLOUTS, source, 2)
    run()
    got = {r.event_id: (r.ppl_gt, r.ppl_neg, r.margin_source) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (1.0, 1.0, "group_rollout:timeout"), 2: (4.0, 8.0, "group_rollout:complete"), 3: (4.0, 8.0, "group_rollout:complete")
    }
    assert waiting.with_state_store(spark) is spark


def test_groups_share_keys_of_state(spark, tmp_path):
    """State grows with the buckets and not with the groups; each group still waits for its own members, ids stay exact."""
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    big = 2**53 + 1
    member = lambda i: (None if i == 7 else big + 2 * i, None if i == 5 else f"g{i % 300}", "A", "A", float(i + 1))
    put(spark, [member(i) for i in range(300)], ROLLOUTS, source, 0)

    def run():
        job = start(group_margins(feed(spark, ROLLOUTS, source), 2, 600_000, buckets=4), out, marks)
        job.awaitTermination()
        return max(s["numRowsTotal"] for p in job.recentProgress for s in p["stateOperators"])

    assert 4 <= run() <= 40
    assert spark.read.schema("event_id long").parquet(out).count() == 0
    put(spark, [member(i) for i in range(300, 600)], ROLLOUTS, source, 1)
    run()
    got = {r.event_id: r.margin_source for r in spark.read.parquet(out).collect()}
    # The group of null has one member, as has the group of the other one that its key once was.
    want = {None if i == 7 else big + 2 * i for i in range(600)} - {big + 10, big + 610}
    assert set(got) == want and set(got.values()) == {"group_rollout:complete"}


MESSAGES = "conv_id long, turn long, role string, content string, n_messages long"


def test_conversations_split_over_batches(spark, tmp_path):
    """A conversation whose messages lie in three files is labelled once, with all of its turns."""
    said = [(c, t, "assistant" if t % 2 else "user", f"{c}:{t}", 6) for c in range(5) for t in range(6)]
    source = str(tmp_path / "in")
    for part in range(3):
        put(spark, [m for m in reversed(said) if m[1] % 3 == part or m[0] == part], MESSAGES, source, part)
    batches = []

    def label(batch):
        batches.append(sorted((r.conv_id, r.turn) for r in batch.collect()))
        return batch.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda m: m["content"]), " ").alias("text"), F.min("whole").alias("whole"))

    run = lambda: label_stream(whole_conversations(feed(spark, MESSAGES, source)), label, str(tmp_path / "log"), str(tmp_path / "marks"), "conv_id").awaitTermination()
    run()
    want = sorted((c, " ".join(f"{c}:{t}" for t in range(6)), True) for c in range(5))
    log = lambda: sorted((r.conv_id, r.text, r.whole) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert log() == want and sum(map(len, batches)) == 30 and len([b for b in batches if b]) >= 2
    # A conversation that comes again, whole, is in the log already; one without its end waits.
    put(spark, [(0, t, "user", "again", 6) for t in range(6)] + [(7, 0, "user", "only", 2)], MESSAGES, source, 3)
    run()
    assert log() == want
    put(spark, [(7, 1, "user", "end", 2)], MESSAGES, source, 4)
    run()
    assert log() == sorted([*want, (7, "only end", True)])


def test_replayed_batch_is_written_once(spark, tmp_path):
    """A batch that fails after its write is run again and replaces its own folder."""
    from turnwright.streaming import labelling

    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    for part in range(3):
        put(spark, [(part * 10 + i,) for i in range(4)], "id long", source, part)
    failures = [1]
    real = labelling.write_batch

    def write_then_fail(df, number, where):
        real(df, number, where)
        if number == 1 and failures:
            failures.pop()
            raise RuntimeError("lost after the write")

    labelling.write_batch = write_then_fail
    try:
        run = lambda: label_stream(feed(spark, "id long", source), lambda b: b.withColumn("label", F.col("id") * 2), path, str(tmp_path / "marks"), "id")
        with pytest.raises(Exception, match="lost after the write"):
            run().awaitTermination()
        assert spark.read.parquet(path).count() == 8
        run().awaitTermination()
    finally:
        labelling.write_batch = real
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(p * 10 + i for p in range(3) for i in range(4))


def test_group_settings():
    assert expected_size({}) == 1 and expected_size({"N_SAMPLES": "8"}) == 8
    assert expected_size({"REWARD_GROUP_MARGIN_EXPECTED_SIZE": "x", "N_SAMPLES": "-1", "actor_rollout_ref.rollout.n": "16"}) == 16
