"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors of equal numbers and label (two 64-bit hashes) are one representative with a count. Each representative is
normalised and projected on Gaussian directions; ``k`` projections, shifted and cut into cells of ``WIDTH``, are one
table's key. At the distance that belongs to the threshold a projection agrees with probability p_near, between
unrelated unit vectors with p_far: k grows with the logarithm of the number of vectors so that unrelated pairs stay rare,
and the number of tables follows so that a pair at the threshold is missed with probability ``MISS`` at most.
Only buckets of two or more are compared, within one label and one length, by the cosine in double precision, in blocks
bounded in rows and bytes. A bucket with the same members as one of an earlier table is left out, and a pair is
counted in the first table in which it meets, so that no pairs are written: a block gives link counts and the edges of a
spanning forest. Vectors travel in their own number type. Rows get their counts by the hashes; representatives of more
than ``HOT`` rows are broadcast, so that no vector's rows meet.

Cases: a vector that is null, empty, zero or holds a null or a number that is not finite links with nothing, nor
does one without label; it is a component of its own. Rows that repeat a vec_id are vectors each. An empty table
gives no rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwright.llm.common import components, prepared, with_facts, write_table

COSINE = 0.98
WIDTH = 2.0
MISS = 1e-4
#: Most rows of a block, and most bytes of its vectors and keys.
BLOCK = 8192
BLOCK_BYTES = 8 << 20
#: Rows of one vector from which its counts are broadcast.
HOT = 4096


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection of two vectors at ``distance`` falls into the same cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections in a key, tables) for so many vectors."""
    near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2))
    k = max(12, math.ceil(math.log(max(vectors, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def table_keys(unit: np.ndarray, k: int, tables: int, seed: int = 8) -> np.ndarray:
    """One 64-bit key a table of every row."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], k * tables))
    b = rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    odd = rng.integers(0, 1 << 62, k, dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        mixed = ((cells + 1_000_003) * odd).sum(2)
        mixed ^= mixed >> 31
        return mixed * np.int64(0x5851F42D4C957F2D) + unit.shape[1]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges among (a, b) that make up a spanning forest."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def link(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = prepared(embeddings.sparkSession)
    have = {c.lower(): c for c in embeddings.columns}
    v = embeddings[have["embedding"]]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = embeddings[have["label"]]
    good = label.isNotNull() & embeddings[have["vec_id"]].isNotNull() & finite & F.exists(v, lambda x: x != 0)
    key = lambda seed: F.when(F.coalesce(good, F.lit(False)), F.xxhash64(F.lit(seed), label, v))
    base = embeddings.select(embeddings[have["vec_id"]].cast("long").alias("vec_id"), label.alias("label"), v.alias("v"), key(1).alias("h1"), key(2).alias("h2"))
    reps = base.where("h1 is not null").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    # Two different vectors may share a vec_id; a number tells them apart.
    reps = write_table(reps.withColumn("n", F.monotonically_increasing_id()), "vectors-reps")
    count, widest = reps.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    k, tables = plan(count, cosine)
    block = max(1, min(block, BLOCK_BYTES // (8 * ((widest or 1) + tables))))

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            vectors = b.column("v").to_pylist()
            keys: list[bytes] = [b""] * len(vectors)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for rows in by.values():
                x = np.array([vectors[i] for i in rows], np.float64)
                made = table_keys(unit(x), k, tables).astype("<i8")
                for i, row in zip(rows, made):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "keys"]
            )

    keyed = write_table(reps.mapInArrow(hashed, T.StructType([*reps.schema.fields, T.StructField("keys", T.BinaryType())])), "vectors-keys")

    def exploded(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            raw = np.frombuffer(b"".join(b.column("keys").to_pylist()), "<i8") if n else np.zeros(0, np.int64)
            row = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("n").take(row),
                    b.column("label").take(row),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                    pa.array(raw),
                ],
                names=["n", "label", "t", "key"],
            )

    kind = reps.schema["label"].dataType.simpleString()
    places = keyed.select("n", "label", "keys").mapInArrow(exploded, f"n long, label {kind}, t int, key long")
    member = [F.bit_xor(F.xxhash64(F.lit(seed), "n")).alias(f"x{seed}") for seed in (1, 2)]
    sizes = places.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("size"), *member).where("size > 1")
    # Buckets of the same members meet once, in their first table.
    sizes = sizes.groupBy("label", "size", "x1", "x2").agg(F.min(F.struct("t", "key")).alias("b"))
    sizes = write_table(sizes.select("label", "size", "b.t", "b.key"), "vectors-buckets")
    members = places.join(sizes, ["label", "t", "key"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = members.withColumn("mine", F.pmod(F.xxhash64("n", F.lit(3)), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select(
        "n", "label", "t", "key", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")
    )
    full = members.join(keyed.select("n", "rep", "copies", "v", "keys"), "n")

    def compare(table):
        import pyarrow as pa

        table = table.combine_chunks()
        n, mine = table.column("n").to_numpy(), table.column("mine").to_numpy()
        t, lo, hi = (table.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        copies, rep = table.column("copies").to_numpy(), table.column("rep").to_numpy()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<i8").reshape(len(n), tables)
        vectors = table.column("v").combine_chunks()
        vectors = vectors.chunk(0) if hasattr(vectors, "chunk") else vectors
        begin = vectors.offsets.to_numpy()
        numbers = vectors.values.to_numpy(zero_copy_only=False)
        width = np.diff(begin)
        links = np.zeros(len(n), np.int64)
        ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            x = unit(numbers[begin[of][:, None] + np.arange(w)].astype(np.float64))
            left = np.flatnonzero(mine[of] == lo)
            right = np.flatnonzero(mine[of] == hi)
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                near = x[part] @ x[right].T >= cosine
                near &= n[of][part][:, None] != n[of][right][None, :]
                if lo == hi:
                    near &= n[of][part][:, None] < n[of][right][None, :]
                i, j = np.nonzero(near)
                i, j = of[part[i]], of[right[j]]
                first = ~(keys[i, :t] == keys[j, :t]).any(1) if t else np.ones(len(i), bool)
                i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ea.append(i)
                eb.append(j)
        tree = forest(len(n), np.concatenate(ea), np.concatenate(eb))
        some = np.flatnonzero(links)
        one, two = [n[some], rep[some]], [links[some]]
        a = np.array([rep[x] for x, _ in tree], np.int64)
        b = np.array([rep[y] for _, y in tree], np.int64)
        blank = np.zeros(len(tree), np.int64)
        return pa.table(
            {
                "n": pa.array(np.concatenate([one[0], blank - 1])),
                "a": pa.array(np.concatenate([one[1], a])),
                "b": pa.array(np.concatenate([one[1], b])),
                "links": pa.array(np.concatenate([two[0], blank])),
            }
        )

    found = full.groupBy("label", "t", "key", "lo", "hi").applyInArrow(compare, "n long, a long, b long, links long")
    found = write_table(found, "vectors-found")
    roots = components(found.where("n < 0").select("a", "b"), "vectors-components")
    counts = found.where("n >= 0").groupBy("n").agg(F.sum("links").alias("links"))
    roots = roots.toDF("node", "root")
    facts = reps.drop("v", "label").join(counts, "n", "left").join(roots, F.col("rep") == F.col("node"), "left")
    facts = facts.where((F.col("copies") > 1) | F.col("links").isNotNull() | F.col("root").isNotNull())
    near = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    facts = write_table(facts.select("h1", "h2", "copies", near.alias("near"), F.coalesce("root", "rep").alias("class")), "vectors-facts")
    out = with_facts(base.select("vec_id", "h1", "h2"), facts, ["h1", "h2"], "copies", HOT)
    out = out.select("vec_id", F.coalesce("near", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small numbers do not overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
