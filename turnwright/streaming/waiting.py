"""Streams whose rows wait for the rest of their group: groups share keys of state and timers, results once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys of state. A key of its own for each group would cost several calls of the state store and one of Python a group and batch.
BUCKETS = 2048
BUCKET = "_bucket"
#: So many rows are one value of the state.
PART = 500


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with a state store that groups with timers need, unless one was chosen.

    The setting is read when a query starts; a query that has a checkpoint keeps what it began with."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    return spark


def start_available(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """A stream that ends when it has read what there is; rows that still wait stay in its state.

    Timers keep a stream alive by batches without data, so that it would not end; they are off for this one (a stream takes
    the settings of the session as it starts), and what is due is done in its next batch with data."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def expiry_ms(timeout_ms: int) -> int:
    """How old a group may be that a new row still joins."""
    return max(5_000, 10 * timeout_ms)


def in_groups(stream: DataFrame, wait: Wait, buckets: int = BUCKETS) -> DataFrame:
    """What ``wait`` makes of a stream's rows, in append mode; groups are dealt over ``buckets`` keys of state.

    The number is part of the state, as the number of partitions is: a stream goes on with what it began with. A batch reads
    and writes what waits in the buckets that its rows fall into."""
    with_state_store(stream.sparkSession)
    # Integers go to Python as texts: pandas would make floats of those that have nulls.
    sent = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.IntegralType) else F.col(f.name) for f in wait.kept]
    dealt = stream.select(F.pmod(F.hash(wait.key), F.lit(buckets)).alias(BUCKET), *sent)
    return dealt.groupBy(BUCKET).transformWithStateInPandas(wait, wait.out, "Append", "ProcessingTime")


class Wait(StatefulProcessor):
    """Rows of a group wait until ``full`` says that they are all there, or until ``timeout_ms`` after the first.

    A list state holds the rows of a bucket's groups, each with the time at which its group is due, as pickled lists of
    tuples; a bucket has a timer for each such time. A row with the ``name`` of an earlier one of its group takes its place.
    ``full`` gets the rows held so far by name; ``finish`` makes the result of a group, rows of ``out``, from its rows and
    whether it is complete. Rows that come later open a new group.
    The time gives the group's age as well: where a stream was stopped for longer than the expiry, new rows do not
    join the old group, which is finished as timed out. Nothing is dropped by a time to live, so that no row is lost."""

    def __init__(self, kept: T.StructType, out: T.StructType, key: str, name: str, full: Callable[[dict], bool], finish: Callable[[list[tuple], bool], Iterable[tuple]], timeout_ms: int):
        self.kept, self.out, self.key, self.full, self.finish, self.timeout_ms = kept, out, key, full, finish, timeout_ms
        self.group, self.name = kept.names.index(key), kept.names.index(name)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "part binary")

    def held(self) -> dict:
        """When each group is due, and its rows by name."""
        out: dict = {}
        for (part,) in self.parts.get():
            for due, r in pickle.loads(part):
                out.setdefault(r[self.group], (due, {}))[1][r[self.name]] = r
        return out

    def hold(self, groups: dict) -> None:
        rows = [(due, r) for due, mine in groups.values() for r in mine.values()]
        self.parts.clear()
        for i in range(0, len(rows), PART):
            self.parts.appendList([(pickle.dumps(rows[i : i + PART]),)])

    def tuples(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        plain = pdf[self.kept.names].astype(object)
        columns = [plain[f.name].where(plain[f.name].notna(), None) for f in self.kept]
        whole = [isinstance(f.dataType, T.IntegralType) for f in self.kept]
        return zip(*[[x if x is None else int(x) for x in c] if w else c for w, c in zip(whole, columns)])

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out.names, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        now, groups = timerValues.getCurrentProcessingTimeInMs(), self.held()
        waited = bool(groups)
        for pdf in rows:
            done: list[tuple] = []
            for r in self.tuples(pdf):
                group = r[self.group]
                due, mine = groups.get(group, (now + self.timeout_ms, None))
                if mine and now > due - self.timeout_ms + expiry_ms(self.timeout_ms):
                    done += self.finish(list(mine.values()), False)
                    due, mine = now + self.timeout_ms, None
                if mine is None:
                    mine = {}
                    groups[group] = (due, mine)
                mine[r[self.name]] = r
                if self.full(mine):
                    done += self.finish(list(mine.values()), True)
                    del groups[group]
            if done:
                yield self.table(done)
        if waited or groups:
            self.hold(groups)
            times = {due for due, _ in groups.values()}
            timers = set(self.handle.listTimers())
            for t in timers - times:
                self.handle.deleteTimer(t)
            for t in times - timers:
                self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        groups, at = self.held(), expiredTimerInfo.getExpiryTimeInMs()
        over = [g for g, (due, _) in groups.items() if due <= at]
        done = [row for g in over for row in self.finish(list(groups.pop(g)[1].values()), False)]
        if over:
            self.hold(groups)
        if done:
            yield self.table(done)

    def close(self) -> None:
        pass
