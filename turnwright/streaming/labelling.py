"""Labelling of a stream of messages by whole conversations, into a log that a replayed batch does not double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnwright.streaming.waiting import Wait, in_groups, start_available


def whole_conversations(stream: DataFrame, key: str = "conv_id", name: str = "turn", size: str = "n_messages", timeout_ms: int = 600_000) -> DataFrame:
    """The messages of a conversation in one micro-batch, once ``size`` of them are there, with ``whole``.

    Messages may come in any order and over any number of batches; one that comes again takes the place of the first.
    What is still missing ``timeout_ms`` after the first message is not waited for (``whole`` is false then). State:
    the messages of conversations that are not complete."""
    kept = stream.schema
    out = T.StructType([*kept, T.StructField("whole", T.BooleanType())])
    at = kept.names.index(size)

    def full(rows: dict) -> bool:
        last = next(reversed(rows.values()))
        return last[at] is not None and len(rows) >= last[at]

    def finish(rows: list[tuple], complete: bool) -> Iterator[tuple]:
        return ((*r, complete) for r in rows)

    return in_groups(stream, Wait(kept, out, key, name, full, finish, timeout_ms))


def write_batch(df: DataFrame, number: int, path: str) -> None:
    """The rows of a micro-batch in a folder of its number: a batch that is run again replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def logged(df: DataFrame, path: str, key: str, before: int) -> DataFrame:
    """Keys that batches with a number below ``before`` have written; rows of ``df``'s session."""
    try:
        done = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.select(key).where("false")
    return done.where(F.col("batch") < before).select(key).distinct()


def label_stream(stream: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Label each micro-batch into a log of one folder a batch; a restart resumes after the last batch that was done.

    A batch that failed after its write, or whose commit was lost, is run again and overwrites its own folder. With
    ``key``, rows whose key an earlier batch has labelled are left out."""

    def sink(batch: DataFrame, number: int) -> None:
        todo = batch if key is None else batch.join(logged(batch, path, key, number), key, "left_anti")
        write_batch(label(todo), number, path)

    return start_available(stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), stream.sparkSession)
