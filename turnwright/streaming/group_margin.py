"""Streams of rollouts: wait for a group to be complete or for a time-out, then emit each member's margins once."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnwright.streaming.waiting import BUCKETS, Wait, in_groups

MEMBERS = "event_id long, group_key string, ppl_gt double, ppl_neg double, margin_source string"
HELD = "event_id long, group_key string, pred_letter string, gt_letter string, seq_ppl double"


def expected_size(settings: Mapping[str, str]) -> int:
    """How many rollouts a group has, from the first setting that is a positive number; 1 (no groups) without one."""
    for name in ("REWARD_GROUP_MARGIN_EXPECTED_SIZE", "N_SAMPLES", "actor_rollout_ref.rollout.n"):
        with contextlib.suppress(ValueError):
            if (n := int(str(settings.get(name) or "").strip() or 0)) > 0:
                return n
    return 1


def members(rows: list[tuple], complete: bool) -> Iterator[tuple]:
    """Margins of all members of one group, as the batch operator fills them."""
    source = "group_rollout:complete" if complete else "group_rollout:timeout"
    sides = []
    for right in (True, False):
        own = [ppl if pred and (pred == gt) is right and ppl is not None and ppl == ppl else None for _, _, pred, gt, ppl in rows]
        known = [ppl for ppl in own if ppl is not None]
        other = sum(known) / len(known) if known else 1.0
        sides.append([other if ppl is None else ppl for ppl in own])
    for (event_id, key, *_), right, wrong in zip(rows, *sides):
        yield event_id, key, right, wrong, source


def group_margins(stream: DataFrame, expected: int = 8, timeout_ms: int = 2000, buckets: int = BUCKETS) -> DataFrame:
    """Append-mode margins of a stream of (event_id, group_key, pred_letter, gt_letter, seq_ppl).

    A group is emitted with its ``expected``th member, or ``timeout_ms`` after its first. State: at most
    ``expected`` - 1 members a group."""
    held, out = map(T._parse_datatype_string, (HELD, MEMBERS))
    return in_groups(stream, Wait(held, out, "group_key", "event_id", lambda rows: len(rows) >= expected, members, timeout_ms), buckets)


def drain(job: StreamingQuery, timeout_ms: int) -> None:
    """Wait until a group-margin stream has read its input and emitted all groups, then stop it.

    Time-outs fire by the clock, so that the stream itself never ends. A stream that fails, or that somebody
    else stops before its groups are out, raises an error."""
    done = False
    while job.isActive and not done:
        time.sleep(timeout_ms / 4000)
        if last := job.lastProgress:
            # Without any batch so far there are no state operators: nothing to read, nothing to wait for.
            done = last["numInputRows"] == 0 and all(s["numRowsTotal"] == 0 for s in last["stateOperators"])
    if failure := job.exception():
        raise failure
    if not done:
        raise RuntimeError("the stream was stopped before all groups were emitted")
    job.stop()
