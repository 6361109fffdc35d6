"""Hard negatives by distributed radix selection.

Each component x of a vector becomes the integer floor(256 * x), and a row's score is its integer inner product with the
anchor. A window is a range of scores of one anchor, among rows of its label (to find its positives) or of another one
(to find negatives of an anchor and a positive), of which the first ``k`` rows are wanted, higher scores and then smaller
vec_id first. Every round counts each window's rows by the next ``DIGIT`` bits of their distance to the top of the
window, and goes on in the bucket that holds the kth row, digit by digit; where more than ``FEW`` rows share one score, the
bits of vec_id are the next digits. When the bucket has ``FEW`` rows or less, a last pass gathers the rows down to its end,
and only these are sorted. So no group grows with the table, however many rows a window has or share a score.

Scores are products of matrices: rows are packed in chunks, anchors and their windows in blocks, both bounded in rows and
bytes, and each block meets each chunk - a stated query set against all rows, in blocks. Blocks are broadcast where all
of them are at most ``SENT`` bytes.

Cases: rows with a null vec_id, label or vector, or with any null or non-finite component take no part. A vector
is compared with those of its own length; an empty one has score 0. Rows that repeat a vec_id take part each: each is an
anchor, and a positive or negative, of its own, but none is its own positive; a copy of the anchor is one. Scores
beyond 2^53 are worked out in integers; a table whose scores may pass 2^59 raises an error. An empty table gives no rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwright.llm.common import prepared, write_table

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: Bounds of a window of negatives, in percent of the positive's score.
LOW, HIGH = 30, 90
#: Bits of a digit; rows of a bucket that is small enough to be gathered.
DIGIT = 8
FEW = 64
#: Rows and bytes of a chunk, anchors of a block, and bytes of all blocks up to which they are broadcast.
CHUNK = 4096
CHUNK_BYTES = 4 << 20
BLOCK = 1024
SENT = 64 << 20
#: Bytes of counts that a task holds.
HELD = 64 << 20
#: Scores that are looked at together.
CELLS = 1 << 20

WINDOW = "n long, p int, lo long, hi long, need long, top long, bits int, id_low long, id_bits int, open boolean"


def quantised(embeddings: DataFrame) -> DataFrame:
    """n (a row number), vec_id, label and q, the integers as doubles, of all rows that take part."""
    have = {c.lower(): c for c in embeddings.columns}
    v, vec_id, label = embeddings[have["embedding"]], embeddings[have["vec_id"]].cast("long"), embeddings[have["label"]].cast("long")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < 1 << 52, F.floor(x).cast("double")).otherwise(x)  # larger doubles are whole
    q = F.transform(v, lambda x: whole(x.cast("double") * SCALE))
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    good = embeddings.where(vec_id.isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)))
    return good.select(F.monotonically_increasing_id().alias("n"), vec_id.alias("vec_id"), moved.alias("label"), q.alias("q"))


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """(width, chunk): rows of one length as arrays of their ids, labels and vectors."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def out(width: int):
            n, i, label, q = zip(*held.pop(width))
            data = {"n": np.array(n), "id": np.array(i), "label": np.array(label), "q": np.array(q, np.float64).reshape(len(n), width).astype(kind)}
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([pickle.dumps(data)], pa.binary())], names=["width", "chunk"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("n", "vec_id", "label", "q")]):
                width = len(row[3])
                mine = held.setdefault(width, [])
                mine.append(row)
                if len(mine) >= min(CHUNK, CHUNK_BYTES // (8 * (width + 1)) + 1):
                    yield out(width)
        for width in list(held):
            yield out(width)

    return rows.mapInArrow(run, "width int, chunk binary")


def blocks(windows: DataFrame, anchors: DataFrame, count: int, kind: str) -> DataFrame:
    """(width, b, block): anchors of one length with their windows."""
    names = ["p", "lo", "hi", "top", "bits", "id_low", "id_bits"]

    def pack(table):
        import pyarrow as pa

        col = lambda c: table.column(c).to_numpy()
        width, b = table.column("width")[0].as_py(), table.column("b")[0].as_py()
        n, first, at = np.unique(col("n"), return_index=True, return_inverse=True)
        q = np.array([table.column("q")[int(i)].as_py() for i in first], np.float64).reshape(len(n), width).astype(kind)
        data = {"name": (width, b), "n": n, "label": col("label")[first], "q": q, "at": at} | {c: col(c).astype(np.int64) for c in names}
        return pa.table({"width": pa.array([width], pa.int32()), "b": pa.array([b], pa.int32()), "block": pa.array([pickle.dumps(data)], pa.binary())})

    mine = windows.select("n", *names).join(anchors.select("n", "label", "q"), "n")
    mine = mine.withColumn("width", F.size("q")).withColumn("b", F.pmod(F.xxhash64("n"), F.lit(count)).cast("int"))
    return mine.groupBy("width", "b").applyInArrow(pack, "width int, b int, block binary")


def met(chunk: dict, block: dict, same: bool) -> Iterator[tuple]:
    """(windows, rows, scores) of pairs within a window's range: slices of the block's windows against the whole chunk."""
    big = max((float((np.abs(m.astype(np.float64)) ** 2).sum(1).max()) for m in (chunk["q"], block["q"]) if m.size), default=0.0)
    number = np.float64 if big < 1 << 53 else np.int64
    scores = (block["q"].astype(number) @ chunk["q"].astype(number).T).astype(np.int64)
    fits = (block["label"][:, None] == chunk["label"][None, :]) == same
    if same:
        fits &= block["n"][:, None] != chunk["n"][None, :]
    step = max(1, CELLS // max(1, len(chunk["n"])))
    for first in range(0, len(block["at"]), step):
        w = slice(first, first + step)
        at = block["at"][w]
        s = scores[at]
        i, j = np.nonzero(fits[at] & (s >= block["lo"][w, None]) & (s <= block["hi"][w, None]))
        yield i + first, j, s[i, j]


def bucket_of(block: dict, chunk: dict, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair lies in its window's bucket, and its next digit there."""
    below = block["top"][i] - s
    bits, by_id = block["bits"][i], block["id_bits"][i]
    beyond = chunk["id"][j].astype(np.uint64) - block["id_low"][i].astype(np.uint64)  # modulo 2^64, as ids may be far apart
    scored = bits > 0
    inside = np.where(scored, (below >= 0) & (below >> np.minimum(bits, 62) == 0), (below == 0) & (by_id > 0))
    low = np.where(by_id >= 64, np.uint64(0), beyond >> np.minimum(by_id, 63).astype(np.uint64))
    inside &= scored | (low == 0)
    digit = np.where(scored, below >> np.maximum(bits - DIGIT, 0), (beyond >> np.maximum(by_id - DIGIT, 0).astype(np.uint64)).astype(np.int64))
    return inside, digit


def each_pair(chunks: DataFrame, made: DataFrame, count: int, send: bool, work: Callable, schema: str) -> DataFrame:
    """What ``work`` makes, as dicts of arrays, of the pairs (chunk, block) of one length that a task has."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        pairs = ((pickle.loads(c.as_py()), pickle.loads(k.as_py())) for b in batches for c, k in zip(b.column("chunk"), b.column("block")))
        for out in work(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(out[x]) for x in names], names=names)

    dealt = chunks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return dealt.join(F.broadcast(made) if send else made, ["width", "b"]).select("chunk", "block").mapInArrow(run, schema)


def histograms(pairs: Iterator[tuple[dict, dict]], same: bool) -> Iterator[dict]:
    """n, p, digit, rows: how many rows of each window's bucket have a digit; a task's counts are added up, within ``HELD``."""
    held: dict[tuple, tuple[dict, np.ndarray]] = {}

    def told() -> Iterator[dict]:
        for block, counts in held.values():
            key = np.flatnonzero(counts)
            w = key >> DIGIT
            digit = (key & ((1 << DIGIT) - 1)).astype(np.int32)
            yield {"n": block["n"][block["at"][w]], "p": block["p"][w].astype(np.int32), "digit": digit, "rows": counts[key]}
        held.clear()

    for chunk, block in pairs:
        name = tuple(block["name"])
        if name not in held:
            size = len(block["at"]) << DIGIT
            if held and 8 * (size + sum(len(c) for _, c in held.values())) > HELD:
                yield from told()
            held[name] = ({c: block[c] for c in ("n", "at", "p")}, np.zeros(size, np.int64))
        counts = held[name][1]
        for i, j, s in met(chunk, block, same):
            inside, digit = bucket_of(block, chunk, i, j, s)
            if inside.any():
                first = int(i[0])
                found = np.bincount(((i[inside] - first) << DIGIT) + digit[inside])
                counts[first << DIGIT : (first << DIGIT) + len(found)] += found
    yield from told()


def qualifying(chunk: dict, block: dict, same: bool) -> dict:
    """n, p, score, vec_id, copies of the rows down to the end of each window's last bucket."""
    out = {c: [np.zeros(0, np.int64)] for c in ("w", "score", "vec_id")}
    for i, j, s in met(chunk, block, same):
        least = block["top"][i] - (np.int64(1) << np.minimum(block["bits"][i], 62)) + 1
        # In a bucket of one score the ids end with the bucket.
        one = (block["bits"][i] == 0) & (block["id_bits"][i] < 64) & (s == block["top"][i])
        beyond = chunk["id"][j].astype(np.uint64) - block["id_low"][i].astype(np.uint64)
        after = (chunk["id"][j] > block["id_low"][i]) & (beyond >> np.minimum(block["id_bits"][i], 63).astype(np.uint64) > 0)
        good = (s >= least) & ~(one & after)
        for c, v in (("w", i), ("score", s), ("vec_id", chunk["id"][j])):
            out[c].append(v[good])
    found = np.stack([np.concatenate(v) for v in out.values()])
    found, copies = np.unique(found, axis=1, return_counts=True)
    w = found[0]
    return {"n": block["n"][block["at"][w]], "p": block["p"][w].astype(np.int32), "score": found[1], "vec_id": found[2], "copies": copies.astype(np.int64)}


def bit_length(x: Column) -> Column:
    """Bits of a number from 0 on."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0).cast("int")


def select(windows: DataFrame, anchors: DataFrame, chunks: DataFrame, same: bool, count: int, send: bool, kind: str, ids: tuple[int, int]) -> DataFrame:
    """n, p, rank, score, vec_id: the first ``need`` rows of each window (n, p, lo, hi, need)."""
    bits = bit_length(F.col("hi") - F.col("lo"))
    all_ids = (ids[1] - ids[0]).bit_length()
    now = windows.select("*", F.col("hi").alias("top"), bits.alias("bits"), F.lit(ids[0]).cast("long").alias("id_low"), F.lit(64).alias("id_bits"), F.lit(True).alias("open"), F.col("need").alias("rest"))
    # A window of one score begins with the ids.
    now = now.withColumn("id_bits", F.when(F.col("bits") == 0, F.lit(all_ids)).otherwise(F.col("id_bits")))
    now = write_table(now, "negatives-windows")
    while not now.where("open").isEmpty():
        made = blocks(now.where("open"), anchors, count, kind)
        seen = each_pair(chunks, made, count, send, lambda pairs: histograms(pairs, same), "n long, p int, digit int, rows long")
        seen = seen.groupBy("n", "p", "digit").agg(F.sum("rows").alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy("n", "p").orderBy("digit"))  # a window's digits: 256 rows at most
        seen = seen.withColumn("upto", upto).join(now.where("open").select("n", "p", "rest"), ["n", "p"])
        seen = seen.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("rows") < F.col("rest")))
        nxt = now.join(seen.select("n", "p", "digit", "rows", "upto"), ["n", "p"], "left")
        hit, scored = F.col("digit").isNotNull(), F.col("bits") > 0
        left, left_ids = F.greatest(F.col("bits") - DIGIT, F.lit(0)), F.greatest(F.col("id_bits") - DIGIT, F.lit(0))
        # From the score's last digit on to the ids, where too many rows share it.
        ended = hit & scored & (left == 0)
        wide = F.col("rows") > FEW
        nxt = nxt.select(
            "n", "p", "lo", "hi", "need",
            F.when(hit & scored, F.col("top") - F.expr("shiftleft(cast(digit as bigint), greatest(bits - %d, 0))" % DIGIT)).otherwise(F.col("top")).alias("top"),
            F.when(hit & scored, left).otherwise(F.col("bits")).alias("bits"),
            F.when(hit & ~scored, F.col("id_low") + F.expr("shiftleft(cast(digit as bigint), greatest(id_bits - %d, 0))" % DIGIT)).otherwise(F.col("id_low")).alias("id_low"),
            F.when(ended, F.when(wide, F.lit(all_ids)).otherwise(F.lit(64))).when(hit & ~scored, left_ids).otherwise(F.col("id_bits")).cast("int").alias("id_bits"),
            (F.col("open") & hit & wide & ~(~scored & (left_ids == 0)) & ~(ended & F.lit(all_ids == 0))).alias("open"),
            F.when(hit, F.col("rest") - (F.col("upto") - F.col("rows"))).otherwise(F.col("rest")).alias("rest"),
        )
        now = write_table(nxt, "negatives-windows")
    made = blocks(now, anchors, count, kind)
    found = each_pair(chunks, made, count, send, lambda pairs: (qualifying(c, b, same) for c, b in pairs), "n long, p int, score long, vec_id long, copies long")
    found = found.groupBy("n", "p", "score", "vec_id").agg(F.sum("copies").alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("n", "p").orderBy(F.desc("score"), "vec_id")) - F.col("copies")
    found = found.withColumn("before", before).join(windows.select("n", "p", "need"), ["n", "p"]).where("before < need")
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.col("need")))
    return found.select("n", "p", "score", "vec_id", F.explode(ranks).alias("rank")).withColumn("rank", F.col("rank").cast("int"))


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    prepared(embeddings.sparkSession)
    rows = write_table(quantised(embeddings), "negatives-rows")
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    top = F.max(F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    anchor = F.col("vec_id") % every == 0
    most, peak, low, high, count, width = rows.agg(
        F.max(norm), top, F.min("vec_id"), F.max("vec_id"), F.count_if(anchor), F.max(F.size("q"))
    ).first()
    if not most or most < 0:
        most, peak = 0.0, peak or 0.0
    if most >= 1 << 59:
        raise ValueError("the vectors are too long for integer scores")
    kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8"
    ids, count = (low or 0, high or 0), count or 0
    parts = max(1, -(-count // BLOCK))
    send = count * ((width or 0) * 8 + positives * 100) <= SENT
    chunks = write_table(packed(rows, kind), "negatives-chunks")
    anchors = write_table(rows.where(anchor), "negatives-anchors")
    reach = (F.ceil(F.sqrt(norm * F.lit(float(most)))) + 1).cast("long")
    near = anchors.select("n", F.lit(0).alias("p"), (-reach).alias("lo"), reach.alias("hi"), F.lit(positives).cast("long").alias("need"))
    near = write_table(select(near, anchors, chunks, True, parts, send, kind, ids), "negatives-positives")
    # Rounded towards the window: the least score from LOW percent on, the highest up to HIGH percent.
    least = F.expr(f"-((-{LOW} * score - pmod(-{LOW} * score, 100)) div 100)")
    highest = F.expr(f"({HIGH} * score - pmod({HIGH} * score, 100)) div 100")
    far = near.select("n", F.col("rank").alias("p"), least.alias("lo"), highest.alias("hi"), F.lit(negatives).cast("long").alias("need")).where("lo <= hi")
    far = select(write_table(far, "negatives-ranges"), anchors, chunks, False, parts, send, kind, ids)
    named = anchors.select("n", F.col("vec_id").alias("anchor_id"))
    pairs = near.select("n", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("n", "p", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(pairs, ["n", "p"]).join(named, "n")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def duckdb_sql() -> str:
    """Every anchor against every row, sorted."""
    return f"""
with rows as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.n as an, a.vec_id as anchor_id, r.n, r.vec_id, r.label = a.label as same,
    cast(list_inner_product(a.q, r.q) as bigint) as score
  from rows a join rows r on a.vec_id % {EVERY} = 0 and a.n <> r.n),
pos as (
  select * from (select *, row_number() over (partition by an order by score desc, vec_id) as p from scored where same)
  where p <= {POSITIVES})
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from (
  select pos.anchor_id, pos.vec_id as positive_id, pos.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by pos.an, pos.p order by s.score desc, s.vec_id) as rank
  from pos join scored s on s.an = pos.an and not s.same
    and {LOW} * pos.score <= 100 * s.score and 100 * s.score <= {HIGH} * pos.score)
where rank <= {NEGATIVES}
"""
