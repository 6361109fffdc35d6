"""Balanced label propagation of documents onto shards, with DataFrame operations only.

Documents of equal text are linked. Each group of linked documents is a node joined to its members (no pairs); the labels
of the members are shards, at first by a hash. The table of labels has how many members of each group have which
label. In each round it is counted anew, a group's members move towards the label that most of them have, among the
shards with room for all of them, and groups are admitted in hash order while the shard's quota lasts. The labels of
the others are joined with what they chose and written again: the chosen shard where it still has room, else a
member's own, else another by a hash; from these labels the next round counts. Rounds go on until at most ``FEW`` groups
are open. These, and before the rounds the groups beyond a quarter of a shard (fewer than about four a shard), are
placed by the driver, the largest first: a group stays whole where a shard has room for it, else it fills the
roomiest shards one after the other. Documents without links cost no edge wherever they lie, so they fill what is
left. The law is ``rows``: counts differ by one at most.

Rows follow their group by a join in which groups of more than ``HOT`` rows are broadcast, so that no text's rows meet.

Cases: a null text counts no bytes, has crc32 0 and is linked to nothing; an empty text is a text like any
other. Rows that repeat a doc_id are placed each on its own. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from turnwright.llm.common import as_documents, ranked, with_facts, write_table

SHARDS = 24
#: Groups that the driver places after the rounds. Fewer than ``SHARDS`` can fit no shard whole, so that rounds end.
FEW = 2_000
#: Rows of a group from which its placement is broadcast.
HOT = 4_096

_GROUP = ["h1", "text_crc32", "size"]


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def place(groups: list[Row], room: list[int]) -> list[tuple]:
    """(h1, text_crc32, size, first, last, shard): members first..last-1 of every group, taken out of ``room``."""
    spans = []
    for g in sorted(groups, key=lambda g: (-g["members"], g["h1"], g["text_crc32"], g["size"])):
        at, end = 0, g["members"]
        while at < end:
            whole = [i for i, r in enumerate(room) if r >= end - at]
            if whole:
                shard = max(whole, key=lambda i: (g["near"][i], room[i]))
            else:
                shard = max(range(len(room)), key=lambda i: (room[i], g["near"][i]))
            n = min(room[shard], end - at)
            spans.append((g["h1"], g["text_crc32"], g["size"], at, at + n, shard))
            room[shard] -= n
            at += n
    return spans


def assign(docs: DataFrame, shards: int = SHARDS, few: int = FEW) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = as_documents(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h1"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = write_table(base, "sharding-rows")
    n = rows.count()
    caps = [n // shards + (i < n % shards) for i in range(shards)]
    part = max(1, max(caps) // 4)

    # Groups with their members' first labels counted by shard.
    label = F.pmod(F.xxhash64("uid"), F.lit(shards))
    seen = [F.count(F.when(label == i, 1)).alias(f"n{i}") for i in range(shards)]
    groups = rows.where("h1 is not null").groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("members"), *seen)
    groups = groups.where("members > 1").select(*_GROUP, "members", F.array(*[f"n{i}" for i in range(shards)]).alias("near"))
    groups = write_table(groups, "sharding-groups")
    room = list(caps)
    spans = place(groups.where(F.col("members") > part).collect(), room)
    small = groups.where(F.col("members") <= part)
    labels = small.select(*_GROUP, "members", F.posexplode("near").alias("label", "here")).where("here > 0")
    labels = write_table(labels, "sharding-labels")
    settled = None
    left = small.count()
    round_ = 0
    while left > max(few, shards):
        round_ += 1
        # Neighbours' labels, as they are now.
        counted = [F.sum(F.when(F.col("label") == i, F.col("here")).otherwise(0)) for i in range(shards)]
        open_groups = labels.groupBy(*_GROUP, "members").agg(F.array(*counted).alias("near"))
        # The shard with room for the group that most members are labelled with; ties by a hash of group and shard.
        best = F.array_max(
            F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda i: F.struct(
                    (F.get(_numbers(room), i) >= F.col("members")).alias("open"),
                    F.get(F.col("near"), i).alias("members"),
                    F.xxhash64(F.col("h1"), i).alias("tie"),
                    i.cast("int").alias("shard"),
                ),
            )
        )
        wanted = open_groups.withColumn("_best", best).select(*_GROUP, "members", "_best.open", "_best.shard")
        buckets = max(1, left // 20_000)
        wanted = wanted.withColumn("_b", F.pmod(F.xxhash64(*_GROUP), F.lit(buckets)))
        # Groups that fit nowhere count for no shard; the driver splits them.
        wanted = wanted.withColumn("_rows", F.when(F.col("open"), F.col("members")).otherwise(0))
        sums = wanted.groupBy("shard", "_b").agg(F.sum("_rows").alias("_s"))
        before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("shard", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
        upto = Window.partitionBy("shard", "_b").orderBy(*_GROUP).rowsBetween(Window.unboundedPreceding, 0)
        moved = wanted.withColumn("_upto", F.sum("_rows").over(upto)).join(sums, ["shard", "_b"])
        fits = (F.col("_rows") > 0) & (F.col("_before") + F.col("_upto") <= F.get(_numbers(room), F.col("shard")))
        moved = write_table(moved.select(*_GROUP, "members", "shard", fits.alias("fits")), "sharding-moves")
        taken = {r["shard"]: r["n"] for r in moved.where("fits").groupBy("shard").agg(F.sum("members").alias("n")).collect()}
        new = moved.where("fits").select(*_GROUP, "members", "shard")
        settled = new if settled is None else settled.union(new)
        room = [r - taken.get(i, 0) for i, r in enumerate(room)]
        # What was refused: members go where their group wanted to, or stay, or look elsewhere.
        refused = moved.where(~F.col("fits")).select(*_GROUP, "shard")
        has_room = lambda shard: F.get(_numbers(room), shard) >= F.col("members")  # noqa: B023, E731
        other = F.pmod(F.xxhash64("h1", "label", F.lit(round_)), F.lit(shards)).cast("int")
        label = F.when(has_room(F.col("shard")), F.col("shard")).when(has_room(F.col("label")), F.col("label")).otherwise(other)
        labels = labels.join(refused, _GROUP).select(*_GROUP, "members", label.alias("label"), "here")
        labels = write_table(labels.groupBy(*_GROUP, "members", "label").agg(F.sum("here").alias("here")), "sharding-labels")
        left = refused.count()
    counted = [F.sum(F.when(F.col("label") == i, F.col("here")).otherwise(0)) for i in range(shards)]
    spans += place(labels.groupBy(*_GROUP, "members").agg(F.array(*counted).alias("near")).collect(), room)

    # Members follow their group; all other rows fill the shards up to their caps.
    # The driver's spans: of less than FEW groups and those beyond a quarter shard, each in a few shards.
    kind = "h1 long, text_crc32 long, size long, first long, last long, home int"
    cuts = F.broadcast(write_table(docs.sparkSession.createDataFrame(spans, kind), "sharding-spans"))
    mine = rows.join(cuts.select(*_GROUP).distinct(), _GROUP, "left_semi")
    within = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    homes = ranked(mine, _GROUP, ["uid"], n).join(cuts, _GROUP).where(within).select("uid", "home")
    placed = rows.join(homes, "uid", "left")
    if settled is not None:
        placed = with_facts(placed, settled, _GROUP, "members", HOT).withColumn("home", F.coalesce("home", "shard")).drop("shard")
    placed = placed.withColumn("shard", F.col("home").cast("int")).drop("home")
    placed = write_table(placed, "sharding-placed")
    used = {r["shard"]: r["n"] for r in placed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = [used.get(i, 0) for i in range(shards)]
    free = [c - h for c, h in zip(caps, held)]
    ends = [sum(free[: i + 1]) for i in range(shards)]
    home = ranked(placed.where("shard is not null"), ["shard"], ["uid"], n).withColumnRenamed("rank", "slot")
    fill = ranked(placed.where("shard is null").drop("shard").withColumn("_all", F.lit(0)), ["_all"], ["h1", "uid"], n)
    at = F.size(F.filter(_numbers(ends), lambda e: e <= F.col("rank")))
    fill = fill.drop("_all").withColumn("shard", at.cast("int")).withColumn(
        "slot",
        F.col("rank") - F.get(_numbers([e - f for e, f in zip(ends, free)]), at) + F.get(_numbers(held), at),
    )
    return home.unionByName(fill.drop("rank")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
