"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, by code point, weigh ``weights`` in turn and share all words; a target stops at ``passes`` times its
source's words, and the excess is shared anew until no target is above (each step is one aggregate of the source table).

Order: the documents of a source follow each other by a digest of their ids, and a source that is wanted more than once
starts again. The digest's leading bits cut a source into cells of about ``CELL`` rows; the words before a cell come
from the cells' sums in two levels, those before a document from a window over its cell. Rows that repeat id and text
have one digest; where they are many they get cells of their own, so that no cell grows with a repeated row.

Schedule: each weight has a ``shape``, its rate at the ``KNOTS`` of training time, joined by straight lines. Around a source's
mean rate (its target over all targets) the rates are shifted so that they sum to one at any time and a source's
integral is its target. The integral is a quadratic in each piece; solving it for the words that come before a document
in its source gives the time at which they have all been asked for: the document's position. Documents are range-sorted by
position.

A source's last document is cut where the target ends, so that the words taken are the target, rounded.

Cases: a null text has no words; a document without words is not taken. A null source is the last one. A null doc_id
counts as empty text. Repeated rows are taken each. Without any word all targets are 0; an empty table gives no rows.
Extra columns go, but for ``arrange``, which keeps the columns of the table whatever their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwright.llm.common import SUPER, boxed, broadcast_if_small, with_facts, write_table

WEIGHTS = (5, 2, 1)
PASSES = 3
KNOTS = (0.0, 0.5, 1.0)
#: Rates of the weights at the knots, before they are shifted: heavy sources first, light ones last.
SHAPES = ((1.0, 0.5, 0.0), (0.25, 0.75, 0.5), (0.0, 0.5, 1.0))
#: How far rates follow their shapes; up to 1 they stay above 0 for shapes within half a unit of their mean.
STRENGTH = 0.75
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a cell, and of one repeated row from which it has cells of its own.
CELL = 4_000
#: Rows of a source from which its facts are broadcast.
HOT = 4_096
BITS = 60


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``number``: 0, 1, ... in the order given, by range partitions and the counts of those before."""
    low = F.monotonically_increasing_id()
    out = write_table(df.orderBy(*order).select("*", F.shiftright(low, 33).alias("_part"), low.bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    counts = out.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return out.join(F.broadcast(counts), "_part").withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``queue``, ``source_size`` of every source with its ``kind`` (place in ``weights``) and ``target``."""
    kind = (F.col("number") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1)
    # The key of a null source is empty, the others begin with a mark.
    order = (F.when(F.col("queue") == "", 1).otherwise(0), F.col("queue"))
    sizes = write_table(numbered(sizes, *order).withColumn("kind", kind).withColumn("weight", weight), "mix-sources")
    most = F.lit(passes) * F.col("source_size")
    total, shares = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    free, left = total or 0, shares or 1
    while True:
        share = F.col("weight").cast("double") * F.lit(float(free)) / F.lit(float(left))
        full, rest = sizes.agg(F.sum(F.when(share > most, most)), F.sum(F.when(share <= most, F.col("weight")))).first()
        new = ((total or 0) - (full or 0), rest or left)
        if new == (free, left):
            return sizes.select("queue", "rows", "source_size", "kind", F.least(most.cast("double"), share).alias("target"))
        free, left = new


def schedule(shares: Sequence[float], shapes: Sequence[Sequence[float]] = SHAPES, knots: Sequence[float] = KNOTS, strength: float = STRENGTH) -> tuple[list[list[float]], list[list[float]]]:
    """Rates at the knots, relative to a source's mean rate, and their integral up to each knot, for every kind.

    ``shares`` are the kinds' parts of all words. At any time the rates weighted by them sum to one, and each
    kind's integral over all time is one."""
    steps = [b - a for a, b in zip(knots, knots[1:])]
    mean = lambda v: sum((x + y) / 2 * d for x, y, d in zip(v, v[1:], steps))
    level = [sum(s * g[j] for s, g in zip(shares, shapes)) for j in range(len(knots))]
    rates = [[1 + strength * ((x - mean(g)) - (y - mean(level))) for x, y in zip(g, level)] for g in shapes]
    if min(min(r) for r in rates) < 0:
        raise ValueError("the shapes stray too far from their mean for this strength")
    demand = [[0.0] for _ in rates]
    for r, d in zip(rates, demand):
        for x, y, s in zip(r, r[1:], steps):
            d.append(d[-1] + (x + y) / 2 * s)
        d[-1] = 1.0
    return rates, demand


def time_of(part: Column, rates: Column, demand: Column, knots: Sequence[float] = KNOTS) -> Column:
    """When (0 to 1) a source has been asked for ``part`` (0 to 1) of its words: the integral of its rate, inverted."""
    out = None
    for j, (a, b) in reversed(list(enumerate(zip(knots, knots[1:])))):
        rest, slope = part - demand[j], (rates[j + 1] - rates[j]) / F.lit(b - a)
        root = F.sqrt(F.greatest(rates[j] * rates[j] + 2.0 * slope * rest, F.lit(0.0)))
        here = F.lit(a) + F.least(F.lit(b - a), F.coalesce(F.try_divide(2.0 * rest, rates[j] + root), F.lit(0.0)))
        out = here if out is None else F.when(part < demand[j + 1], here).otherwise(out)
    return out


def with_start(rows: DataFrame) -> DataFrame:
    """Add ``start``: the words of the source's documents before this one, in digest order."""
    cell = (F.col("digest") / F.lit(float(1 << BITS)) * F.ceil(F.col("rows") / CELL)).cast("long")
    rows = rows.withColumn("cell", cell)
    same = ["queue", "cell", "digest", "doc_id", "content"]
    sums = lambda df, keys: write_table(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")
    cells = sums(rows, ["queue", "cell"])
    large = cells.where(F.col("n") > 4 * CELL).select("queue", "cell")
    if large.count():
        # Rows that are alike and many: cut them out of their cells, and into pieces.
        hot = rows.join(F.broadcast(large), ["queue", "cell"], "left_semi").groupBy(*same).count().where(F.col("count") > CELL)
        key = F.struct("digest", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "content")
        hot = hot.groupBy("queue", "cell").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), (F.col("count") / CELL).cast("int").alias("parts")))).alias("hot"))
        hot = write_table(hot, "mix-hot")
        rows = rows.join(broadcast_if_small(hot, hot.count()), ["queue", "cell"], "left").withColumn("_key", key)
        below = F.size(F.filter("hot", lambda x: x["key"] < F.col("_key")))
        own = F.filter("hot", lambda x: x["key"] == F.col("_key"))
        piece = F.when(F.col("hot").isNull(), F.lit(0)).otherwise(2 * below + F.size(own))
        sub = F.coalesce(F.pmod(F.xxhash64("row"), F.get(own, F.lit(0))["parts"]), F.lit(0))
        rows = rows.withColumn("piece", piece).withColumn("sub", sub.cast("int")).drop("hot", "_key")
    else:
        rows = rows.withColumn("piece", F.lit(0)).withColumn("sub", F.lit(0))
    place = ["cell", "piece", "sub"]
    cells = sums(rows, ["queue", *place]).withColumn("_super", F.floor(F.col("cell") / SUPER))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = cells.groupBy("queue", "_super").agg(F.sum("words").alias("w"))
    first = first.select("queue", "_super", F.coalesce(F.sum("w").over(upto("queue").orderBy("_super")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("words").over(upto("queue", "_super").orderBy(*place)), F.lit(0))
    before = cells.withColumn("inside", inside).join(first, ["queue", "_super"])
    before = before.select("queue", *place, (F.col("first") + F.col("inside")).alias("before"))
    own = F.sum("size").over(upto("queue", *place).orderBy(*same[2:]))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).join(broadcast_if_small(before, cells.count()), ["queue", *place])
    return rows.withColumn("start", F.col("before") + F.col("own"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, shapes: Sequence[Sequence[float]] = SHAPES, keep: bool = False) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken, and ``copies``: (position, words) of each time it is taken.

    ``position`` counts the words of training before the copy's first one. With ``keep`` the document's own columns stay
    as ``_row``."""
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    rows = boxed(docs, "doc_id", "text", "source").select(
        *(["_row"] if keep else []),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("content"),
        digest.alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = write_table(rows, "mix-rows")
    sources = rows.groupBy("queue").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = write_table(targets(sources, weights, passes).withColumn("goal", F.floor(F.col("target") + 0.5)), "mix-goals")
    by_kind = {r["kind"]: r["n"] for r in goals.groupBy("kind").agg(F.sum("goal").alias("n")).collect()}  # a row a weight
    length = sum(by_kind.values())
    rates, demand = schedule([by_kind.get(k, 0) / max(length, 1) for k in range(len(weights))], shapes)
    fact = lambda v: F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in v]), F.col("kind") + 1)
    facts = goals.select(F.xxhash64("queue").alias("key"), "queue", "rows", F.struct("source_size", "target", "goal", "kind", "rows").alias("fact"))
    placed = with_facts(rows.withColumn("key", F.xxhash64("queue")), facts, ["key", "queue"], "rows", HOT).select(*rows.columns, "fact.*")
    placed = with_start(placed).withColumns({"rates": fact(rates), "demand": fact(demand)})

    def copy(number: int) -> Column:
        start = number * F.col("source_size") + F.col("start")
        words = F.least(F.col("size"), F.col("goal") - start)
        part = F.try_divide(start.cast("double"), F.col("goal").cast("double"))
        position = F.floor(F.lit(float(length)) * time_of(part, F.col("rates"), F.col("demand")))
        return F.when(words > 0, F.struct(position.alias("position"), words.alias("words")))

    copies = F.array_compact(F.array(*[copy(n) for n in range(passes)]))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    named = [c for c in ("_row",) if keep]
    return placed.withColumn("copies", copies).select(*named, "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The plan, sorted by the position at which a document is first taken; those that are not come last."""
    out = write_table(plan(docs), "mix-plan")
    first = F.get("copies", F.lit(0))["position"]
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("n_copies"), first.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def arrange(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: their own columns as ``row``, ``position`` and the ``words`` to take of each copy."""
    out = write_table(plan(docs, keep=True, **options).select("_row", "doc_id", F.inline("copies")), "mix-copies")
    return out.orderBy("position", "doc_id").select(F.col("_row").alias("row"), "position", "words")


def duckdb_sql() -> str:
    """Targets from the sources sorted by how soon they are full; positions from the same integral."""
    a, knots = STRENGTH, KNOTS
    rows = " union all ".join(f"select {k} as kind, " + ", ".join(f"cast({x} as double) as g{j}" for j, x in enumerate(s)) for k, s in enumerate(SHAPES))
    steps = [b - c for c, b in zip(knots, knots[1:])]
    mean = lambda p: " + ".join(f"({p}{j} + {p}{j + 1}) / 2 * {d}" for j, d in enumerate(steps))
    rate = ", ".join(f"1 + {a} * ((g{j} - gm) - (l{j} - lm)) as r{j}" for j in range(len(knots)))
    level = ", ".join(f"sum(share * g{j}) as l{j}" for j in range(len(knots)))
    return rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce('=' || source, '') as q, text,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (
  select *, case k when 0 then 5 when 1 then 2 else 1 end as w from (
    select q, z, (row_number() over (order by q = '', q) - 1) % 3 as k from (select q, sum(size) as z from d group by q))),
f as (
  select *, sum(z) over () - coalesce(sum(3 * z) over (order by z / w, q rows between unbounded preceding and 1 preceding), 0) as free,
    sum(w) over () - coalesce(sum(w) over (order by z / w, q rows between unbounded preceding and 1 preceding), 0) as part from s),
l as (
  select arg_min(free, part * -1) as free, max(part) as part from f
  where cast(w as double) * cast(free as double) / cast(part as double) <= 3 * z),
t as (
  select q, k, z, target, cast(floor(target + 0.5) as bigint) as goal from (
    select q, k, z, least(cast(3 * z as double), cast(w as double) * cast(l.free as double) / cast(l.part as double)) as target from s, l)),
shape as ({rows}),
share as (
  select kind, coalesce(n, 0) / greatest(sum(n) over (), 1) as share, sum(n) over () as total
  from shape left join (select k, sum(goal) as n from t group by k) on k = kind),
level as (select *, {mean("l")} as lm from (select {level} from shape join share using (kind))),
rates as (select kind, total, {rate} from (select *, {mean("g")} as gm from shape) join share using (kind), level),
placed as (
  select d.*, t.*, coalesce(sum(size) over (partition by d.q order by md5(coalesce(cast(doc_id as varchar), '')), md5(coalesce(text, ''))
    rows between unbounded preceding and 1 preceding), 0) as c from d join t on d.q = t.q),
taken as (
  select *, greatest(least(size, goal - c), 0) + greatest(least(size, goal - z - c), 0) + greatest(least(size, goal - 2 * z - c), 0) as taken,
    cast(size > 0 and goal > c as int) + cast(size > 0 and goal > z + c as int) + cast(size > 0 and goal > 2 * z + c as int) as n,
    case when size > 0 and goal > c then cast(c as double) / cast(goal as double) end as y from placed)
select doc_id, size, cast(z as bigint) as source_size, target, cast(taken as bigint) as taken, n as n_copies,
  cast(floor(total * case when y is null then null when y < m then 2 * y / (r0 + sqrt(r0 * r0 + 2 * ((r1 - r0) / 0.5) * y))
    else 0.5 + least(0.5, 2 * (y - m) / (r1 + sqrt(r1 * r1 + 2 * ((r2 - r1) / 0.5) * (y - m)))) end) as bigint) as position
from taken join (select *, (r0 + r1) / 2 * 0.5 as m from rates) r on r.kind = taken.k
"""
