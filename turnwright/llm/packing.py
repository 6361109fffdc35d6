"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents in storage order. A document is served whole, or, where it has more than ``unit``
tokens, in units of so many. In every round each queue earns credit: its share of ``size`` tokens. A queue serves its next
unit in the round in which its credit covers a part of that unit; the part is fixed for a queue and drawn from the hash of
its name, so that queues of one document do not all wait for the last round. What was served beyond the credit, or earned
beyond what was served, is the queue's deficit and carried on; it never exceeds one unit.

As credit never lapses, a unit's round follows from the tokens before it in its queue alone: no pass goes from round to
round. Rounds are numbered for each unit on its own, units are dealt by round, and a unit's place is the tokens of the rounds
before (a running sum over rounds, in two steps) and of the units before it in its round (by queue, then in the queue's
order). Places are cut into sequences of ``size`` tokens, whatever round or partition they come from. Costs do not depend on
the number of queues, ids move once, and the driver holds a few numbers; a task that encodes keeps one for each queue it meets.

With shares equal to the queues' parts of all tokens (the default) all queues end together. With given targets a
queue may end early; then rounds have fewer tokens and the rest keep their proportions. Queues without target wait until those
with one have ended, and are mixed by their parts of what is left.

Cases: a null text is empty and has only the end id. A null source is a queue of its own, and so is every other
source, however many there are. Repeated rows are packed each. An empty table gives no pieces. Sequences are full but
the last one."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwright.llm.common import as_documents, broadcast_if_small, prepared, text_slices, write_table
from turnwright.llm.tokens import encoder, production_path

SEQUENCE = 4096
END = 2
#: A unit has at most so many parts of a sequence: shorter documents are served whole.
UNITS = 4
#: Rounds whose running sum one task works out.
SUPER = 4096

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
)


def queue_name(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def tokenized(docs: DataFrame, path: str, end: int, unit: int) -> DataFrame:
    """Written table of units: doc_id, queue, part, tokens before in part and queue, start in the document, n, the
    document's tokens, ids (16 or 32 bits each)."""
    base = as_documents(docs, "doc_id", "text", "source")
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    frame = base.select("doc_id", queue.alias("queue"), "text")
    prepared(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path)
        kind = "<u2" if max(enc.tok.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"
        seen: dict[str, int] = {}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            names = b.column("queue").to_pylist()
            for s in text_slices(texts):
                row, before, start, length, total, ids = [], [], [], [], [], []
                for i, made in enumerate(enc.encode(texts[s], end), s.start):
                    have = np.frombuffer(made, "<u4").astype(kind)
                    first = seen.get(names[i], 0)
                    seen[names[i]] = first + len(have)
                    for at in range(0, len(have), unit):
                        piece = have[at : at + unit]
                        row.append(i)
                        before.append(first + at)
                        start.append(at)
                        length.append(len(piece))
                        total.append(len(have))
                        ids.append(piece.tobytes())
                take = pa.array(row, pa.int64())
                longs = [pa.array(x, pa.int64()) for x in (before, start, length, total)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(take),
                        b.column("queue").take(take),
                        pa.array([part] * len(row), pa.int32()),
                        *longs,
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "queue", "part", "before", "start", "n", "doc_tokens", "ids"],
                )

    schema = "doc_id long, queue string, part int, before long, start long, n long, doc_tokens long, ids binary"
    return write_table(frame.mapInArrow(run, schema), "packing-units", "lz4")


def credits(parts: DataFrame, size: int, targets: dict[str | None, float] | None) -> DataFrame:
    """queue, part, tokens of the queue before the part, credit a round, and the round in which the queue begins."""
    queue = Window.partitionBy("queue")
    before = F.sum("n").over(queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    want = F.lit(0.0)
    if targets:
        pairs = [F.lit(x) for s, t in targets.items() for x in (queue_name(s), float(t))]
        want = F.coalesce(F.create_map(*pairs)[F.col("queue")], F.lit(0.0))
    table = parts.select(
        "queue", "part", F.coalesce(before, F.lit(0)).alias("begin"), F.sum("n").over(queue).alias("total"), want.alias("want")
    )
    each = parts.groupBy("queue").agg(F.sum("n").alias("total")).select("total", want.alias("want"))
    aimed = F.col("want") > 0
    wanted, rest = each.agg(F.sum(F.when(aimed, F.col("want"))), F.sum(F.when(~aimed, F.col("total")))).first()
    credit = F.when(aimed, size * F.col("want") / F.lit(wanted or 1.0)).otherwise(
        size * F.col("total").cast("double") / F.lit(float(rest or 1))
    )
    last = each.where(aimed).agg(F.max(F.floor(F.col("total") / credit) + 1)).first()[0]
    return table.select(
        "queue", "part", "begin", credit.alias("credit"), F.when(aimed, 0).otherwise(F.lit(last or 0)).cast("long").alias("later")
    )


def covered() -> Column:
    """The part of a unit that a queue's credit must cover before it is served: 0 to 1, by the queue's name."""
    steps = 1 << 20
    return F.pmod(F.xxhash64("queue"), F.lit(steps)) / F.lit(float(steps))


def rounds_before(units: DataFrame) -> tuple[DataFrame, int]:
    """round and the tokens of all rounds before it; and how many rounds there are."""
    sums = write_table(units.groupBy("round").agg(F.sum("n").alias("n")), "packing-rounds")
    sums = sums.withColumn("super", F.floor(F.col("round") / SUPER))
    upto = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("super").agg(F.sum("n").alias("s"))
    supers = supers.select("super", F.coalesce(F.sum("s").over(upto(Window.partitionBy(), "super")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(upto(Window.partitionBy("super"), "round")), F.lit(0))
    out = sums.select("super", "round", inside.alias("inside")).join(supers, "super")
    return out.select("round", (F.col("first") + F.col("inside")).alias("rounds_first")), sums.count()


def pack(
    docs: DataFrame,
    path: str | None = None,
    size: int = SEQUENCE,
    end: int = END,
    targets: dict[str | None, float] | None = None,
    unit: int | None = None,
) -> DataFrame:
    """Pieces of all documents; ``targets`` gives shares by source, else each has its part of all tokens."""
    prepared(docs.sparkSession)
    units = tokenized(docs, path or production_path(), end, unit or max(1, size // UNITS))
    parts = write_table(units.groupBy("queue", "part").agg(F.sum("n").alias("n")), "packing-parts")
    begins = broadcast_if_small(credits(parts, size, targets), parts.count())
    begin = (F.col("begin") + F.col("before")).alias("begin")
    number = F.col("later") + F.floor((F.col("begin") + F.col("before") + covered() * F.col("n")) / F.col("credit"))
    dealt = units.join(begins, ["queue", "part"]).select(
        "doc_id", "queue", number.alias("round"), begin, "start", "n", "doc_tokens", "ids"
    )
    before, rounds = rounds_before(dealt)
    served = Window.partitionBy("round").orderBy("queue", "begin").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("n").over(served), F.lit(0)))
    placed = placed.join(broadcast_if_small(before, rounds), "round")
    placed = placed.withColumn("position", F.col("rounds_first") + F.col("within"))

    def run(batches):
        """Units cut at the ends of sequences; neighbours of one document, sequence and round are one piece."""
        import pyarrow as pa

        names = ["doc_id", "queue", "round", "begin", "start", "n", "doc_tokens", "position"]
        held = None

        def table(rows):
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

        for b in batches:
            rows = []
            binary = b.column("ids")
            lists = [b.column(c).to_pylist() for c in names]
            for i, (doc, queue, turn, begin, start, n, total, position) in enumerate(zip(*lists)):
                raw = binary[i].as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                done = 0
                while done < n:
                    sequence, offset = divmod(position + done, size)
                    take = min(n - done, size - offset)
                    data = ids[4 * done : 4 * (done + take)]
                    mark = (turn, queue, begin + done, sequence)
                    if held and start + done and held[1] == mark:
                        row = held[0]
                        row[2] += take
                        row[3] = zlib.crc32(data, row[3])
                    else:
                        if held:
                            rows.append(held[0])
                        row = [doc, start + done, take, zlib.crc32(data), total, sequence, offset, queue]
                    done += take
                    held = (row, (turn, queue, begin + done, sequence))
            yield table(rows)
        if held:
            yield table([held[0]])

    return placed.select(
        "doc_id", "queue", "round", "begin", "start", "n", "doc_tokens", "position", "ids"
    ).mapInArrow(run, PIECES)
