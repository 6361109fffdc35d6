"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwright.session import ship

#: Columns of a document table and their types.
DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}

#: ASCII white space, as the quality contract splits words.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch between Spark and Python: texts are large, and two workers share an executor's memory.
BATCH_BYTES = "2097152b"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, its workers able to import this package, and Arrow batches small unless they were set."""
    # Workers give memory back to the system; the default pool keeps it.
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":  # Spark's default
        spark.conf.set(key, BATCH_BYTES)
    return ship(spark)


def document_columns(docs: DataFrame, *names: str) -> list[Column]:
    """The named document columns, typed; a missing one is null."""
    have = {c.lower(): c for c in docs.columns}
    return [(docs[have[n]] if n in have else F.lit(None)).cast(DOCUMENT_COLUMNS[n]).alias(n) for n in names]


def as_documents(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named document columns; other columns go."""
    return docs.select(*document_columns(docs, *names))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, from spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine (tests) a temporary folder takes its place; on a
    cluster without it this raises."""
    sc = prepared(spark).sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="turnwright-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, lost executors recompute nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Chunks that a lexicon works on at once.
STEP = 10_000


class Lexicon:
    """Feature rows of distinct white-space chunks, kept between batches of one Python worker.

    ``compute`` maps a list of new chunks to a list of numpy arrays (one row a chunk each).
    Beyond ``limit`` chunks the store starts anew, so memory stays bounded."""

    def __init__(self, compute: Callable[[list[str]], list[np.ndarray]], limit: int = 120_000):
        self.compute, self.limit = compute, limit
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def lookup(self, lists: list[list[str]]) -> np.ndarray:
        """Row numbers of all chunks of all lists, one after the other."""
        new = list(set().union(*lists).difference(self.index)) if lists else []
        if new and len(self.index) + len(new) > self.limit and self.index:
            self.index, self.rows = {}, []
            new = list(set().union(*lists))
        made = [self.compute(new[i : i + STEP]) for i in range(0, len(new), STEP)]
        if made:
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new))))
            self.rows = [np.concatenate(parts) for parts in zip(*([self.rows] if self.rows else []), *made)]
        total = sum(map(len, lists))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, total)


_STATE: dict = {}


def release() -> None:
    """Give memory that this process no longer needs back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drop what this Python worker keeps between tasks, so that another step's store does not lie beside a new one."""
    if _STATE:
        _STATE.clear()
        release()


def worker_state(key, make: Callable):
    """What this Python worker keeps between tasks: the one thing used last, so that memory stays bounded."""
    if key not in _STATE:
        forget()
        _STATE[key] = make()
    return _STATE[key]


def text_slices(texts: list, most: int = 750_000, free: bool = True) -> Iterator[slice]:
    """Runs of consecutive texts of about ``most`` characters; a longer text stands alone.

    After the last one unused memory is released, if ``free``: two workers share an executor with its JVM."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))
    if free:
        release()


def offsets(lengths: list[int]) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def summed_vector(
    df: DataFrame, vector: Callable[[Iterator[pd.DataFrame]], np.ndarray], width: int, blocks: int = 32
) -> np.ndarray:
    """Sum over all partitions of ``vector(batches)``, an int64 array of fixed ``width``.

    Partial sums meet in two steps (salted by partition, then by block), so that no task
    gathers what grows with the number of partitions; the driver gets ``width`` numbers."""
    prepared(df.sparkSession)
    step = -(-width // blocks)

    def partial(batches):
        from pyspark import TaskContext

        forget()
        total = vector(batches)
        release()
        salt = TaskContext.get().partitionId() // 16
        if total.any():
            yield pd.DataFrame(
                {
                    "block": np.arange(blocks, dtype=np.int32),
                    "salt": np.full(blocks, salt, np.int32),
                    "v": [total[i * step : (i + 1) * step].astype("<i8").tobytes() for i in range(blocks)],
                }
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<i8") for v in pdf["v"])
        return pd.DataFrame({"block": pdf["block"][:1], "salt": pdf["salt"][:1], "v": [total.tobytes()]})

    schema = "block int, salt int, v binary"
    parts = df.mapInPandas(partial, schema).groupBy("block", "salt").applyInPandas(add, schema)
    parts = parts.withColumn("salt", F.col("salt") * 0).groupBy("block").applyInPandas(add, schema)
    out = np.zeros(step * blocks, np.int64)
    for row in parts.collect():
        piece = np.frombuffer(bytes(row.v), "<i8")
        out[row.block * step : row.block * step + len(piece)] = piece
    return out[:width]


def append(df: DataFrame, added: str, make: Callable, *inputs: str, drop: bool = False) -> DataFrame:
    """``df`` with columns ``added`` (DDL), which ``make`` gives batch by batch from ``inputs``; without these, if ``drop``.

    ``make`` takes one Python list for each input and returns one sequence for each new column.
    The other columns pass through as Arrow data, whatever their types."""
    spark = prepared(df.sparkSession)
    new = T._parse_datatype_string(added)
    at = [df.columns.index(c) for c in inputs]
    stay = [i for i in range(len(df.columns)) if not drop or i not in at]
    schema = T.StructType([*[df.schema.fields[i] for i in stay], *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = make(*[b.column(i).to_pylist() for i in at])
            arrays = [*[b.column(i) for i in stay], *[pa.array(x, type=t, from_pandas=True) for x, t in zip(made, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def boxed(docs: DataFrame, *names: str) -> DataFrame:
    """``_row`` with all columns of ``docs``, whatever their names, beside the named document columns."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *document_columns(docs, *names))


def held_out(remainder: int, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ranked(df: DataFrame, by: list[str], order: list[str], rows: int, target: int = 4_000) -> DataFrame:
    """Add ``rank``: 0, 1, ... within ``by`` without gaps, no window partition over about ``target`` rows.

    Rows are dealt into hash buckets of ``order``; a bucket's first rank is the number of rows in
    the buckets before it, summed in two steps. The order is that of the buckets, then of ``order``."""
    n = max(1, rows // target)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_super", F.floor(F.col("_bucket") / SUPER))
    sums = counts.groupBy(*by, "_super").agg(F.sum("_n").alias("_s"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_super", F.coalesce(F.sum("_s").over(upto(*by).orderBy("_super")), F.lit(0)).alias("_first"))
    before = F.coalesce(F.sum("_n").over(upto(*by, "_super").orderBy("_bucket")), F.lit(0))
    counts = counts.withColumn("_in", before).join(sums, [*by, "_super"])
    counts = counts.select(*by, "_bucket", (F.col("_first") + F.col("_in")).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = bucketed.withColumn("_within", F.row_number().over(within) - 1)
    return out.join(counts, [*by, "_bucket"]).withColumn("rank", (F.col("_before") + F.col("_within")).cast("long")).drop(
        "_bucket", "_before", "_within"
    )


#: Buckets whose running sum one task works out.
SUPER = 4096


def with_facts(rows: DataFrame, facts: DataFrame, key: list[str], size: str, hot: int) -> DataFrame:
    """``rows`` and the other columns of ``facts`` by ``key``, null where it has none.

    ``size`` is how many rows a fact is for. Facts for more than ``hot`` rows are joined apart: there is at most one
    for ``hot`` rows, so that they are broadcast, and their rows need not meet in one task."""
    names = [c for c in facts.columns if c not in (*key, size)]
    side = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]
    packed = F.struct(*names)
    often = facts.where(F.col(size) > hot).select(*side, packed.alias("_often"))
    often = broadcast_if_small(often, often.count())
    match = lambda first: (first == F.col("_k0")) & reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(key) if i], F.lit(True))
    drop = [f"_k{i}" for i in range(len(key))]
    rows = rows.join(often, match(F.col(key[0])), "left").drop(*drop)
    seldom = facts.where(F.col(size) <= hot).select(*side, packed.alias("_seldom"))
    seldom = broadcast_if_small(seldom, seldom.count())
    # A row that is settled, or has no key, takes a random one, so that such rows spread out.
    there = F.col("_often").isNull() & F.col(key[0]).isNotNull()
    rows = rows.withColumn("_key", F.when(there, F.col(key[0])).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    rows = rows.join(seldom, match(F.col("_key")) & F.col("_often").isNull(), "left").drop(*drop)
    value = F.coalesce("_often", "_seldom")
    return rows.select(*[c for c in rows.columns if c not in ("_key", "_often", "_seldom")], *[value[c].alias(c) for c in names])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the least node.

    Alternates large-star and small-star steps until nothing changes. Roots have no row.
    Each step's table is written to the shared folder; the loop's number of steps grows with the
    logarithm of the longest path."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = write_table(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), name)
    seen = state(now)
    while seen[0]:
        # Large star: every larger neighbour of a node points to the least of the node and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: a node and its smaller neighbours point to the least of these.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(small, "a").select(F.col("b").alias("x"), "a", "m")
        nxt = nxt.select(F.explode(F.array(F.col("x"), F.col("a"))).alias("a"), F.col("m").alias("b"))
        now = write_table(tidy(nxt), name)
        new = state(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def broadcast_if_small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """A hint to broadcast only where ``rows`` counted rows (of a few numbers each) are at most ``most``."""
    return F.broadcast(df) if rows <= most else df
