"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words stand between ASCII white space; a shingle is five consecutive words (all words of a shorter text), weighted by
its count in the text times idf = 1 + ln((N+1)/(df+1)) / ln(CELLS). df counts all documents, in ``CELLS`` hashed cells: a
cell's share of the corpus that stems from unlike shingles is the mean number of shingles a document over ``CELLS``, so
that a rare shingle has about the same idf, at most 2, at any corpus size, and one that every document has 1.

Samples are drawn bin-wise: a shingle falls by its hash into one of BANDS * ROWS bins, and each bin keeps the
(shingle, level) of the least improved-consistent-weighted-sampling value; a bin without a shingle draws anew over
all of the text's shingles. ROWS samples make a band. BANDS suit the least weighted similarity that a plain similarity
of 0.8 can have (see ``SIMILARITY``): a pair there is missed with probability 0.001. Distinct texts are the nodes, told
apart by two 64-bit hashes of the whole text, and nodes that share a band are candidates:

1. In each bucket the most central node (most bucket mates over all bands) is the leader, and each other
   member is verified against it: as many pairs as members. A leader of many pairs is salted.
2. In a bucket whose members still lie in several components only pairs of different components count: members
   outside the largest component are compared with each other and with it, in blocks bounded in rows and bytes. The
   largest component is not compared with itself, so that its rows are sent once for each block of the others. A
   block gives the edges of a spanning forest, not pairs.

A pair is verified on the whole texts: the weighted Jaccard similarity of the TF-IDF weights, or of the counts alone
(so that the idf damping of a frequent passage cannot lose a copy), is at least ``SIMILARITY``.
Classes are connected components.

Cases: a null text is a class of its own; empty texts are equal to each other; texts without words that differ
stay apart. Each row is judged by its own text: rows that share a doc_id but not a text may be in different classes,
and of a class one row stays, with the least doc_id (of rows that repeat doc_id and text, one). A null doc_id is a
class of its own. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.llm.common import (
    as_documents,
    boxed,
    broadcast_if_small,
    components,
    offsets,
    prepared,
    summed_vector,
    text_slices,
    with_facts,
    write_table,
)
from turnwright.llm.tokens import word_hashes
from turnwright.llm.vectors import forest

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
CELLS = 1 << 18
#: Most rows of a block, and most bytes of its texts beyond which a larger share of rows waits in other blocks.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Pairs of one leader, and rows of one text, beyond which a join deals them out by a salt.
HOT = 4096
BITS = np.uint64(44)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def keyed(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64(seed * _GOLD & (1 << 64) - 1))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) from 64 bits."""
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return (low + 0.5) * 2.0**-32, ((x >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


def gamma2(x: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) numbers from 64 bits."""
    a, b = halves(x)
    return -np.log(a * b)


def fresh_draws(sh: np.ndarray, log_weight: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, levels) of improved consistent weighted sampling, one column a seed, in single precision.

    Each column has numbers of its own: with a shared r one shingle of a large r would win in most columns."""
    x = mix(sh[:, None] + seeds[None, :])
    y = mix(x + np.uint64(_GOLD))
    unit = lambda v, bits: ((v >> np.uint64(bits)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25)
    r = -np.log(unit(x, 0) * unit(x, 24))
    beta = (x >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
    level = np.floor(log_weight.astype(np.float32)[:, None] / r + beta)
    return np.log(-np.log(unit(y, 0) * unit(y, 24))) - r * (level - beta + 1), level


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle of 44 bits, count) of each text's distinct shingles, sorted."""
    h, lengths = word_hashes(texts)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix(h)
    starts = offsets(lengths)[:-1]
    # A text of n words has max(1, n - 4) shingles, of min(n, 5) words each.
    count = np.where(lengths > 0, np.maximum(lengths - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    at = np.arange(count.sum()) - np.repeat(offsets(count)[:-1], count) + starts[doc]
    key = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = k < lengths[doc]
        key = np.where(inside, mix(key * np.uint64(3) + h[np.minimum(at + k, len(h) - 1)]), key)
    packed = (doc.astype(np.uint64) << BITS) | (key >> np.uint64(20))
    packed.sort()
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    times = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return (packed >> BITS).astype(np.int64), packed & np.uint64((1 << 44) - 1), times


def cells(sh: np.ndarray) -> np.ndarray:
    return (keyed(sh, 99) >> np.uint64(46)).astype(np.int64)


def signatures(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys, one row a text; texts without shingles have zeros."""
    bins = bands * rows
    out = np.zeros((n, bins), np.uint64)
    r = gamma2(keyed(sh, 1))
    beta, _ = halves(keyed(sh, 2))
    log_weight = np.log(weight)
    level = np.floor(log_weight / r + beta)
    value = np.log(gamma2(keyed(sh, 3))) - r * (level - beta + 1)
    sample = mix(sh ^ keyed(level.astype(np.int64).astype(np.uint64), 4))
    # Bins follow the order of the shingles, so that each is a run.
    slot = doc * bins + ((sh * np.uint64(bins)) >> BITS).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    if len(begin):
        least = np.minimum.reduceat(value, begin)
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(slot))))
        hit = np.flatnonzero(value == least[run])
        _, one = np.unique(run[hit], return_index=True)
        out.reshape(-1)[slot[hit[one]]] = sample[hit[one]] | np.uint64(1)
    spans = np.searchsorted(doc, np.arange(n + 1))
    seeds = np.array([(100 + b) * _GOLD & (1 << 64) - 1 for b in range(bins)], np.uint64)
    for d in np.flatnonzero((out == 0).any(1)):
        a, b = spans[d], spans[d + 1]
        if a == b:
            continue
        empty = np.flatnonzero(out[d] == 0)
        step = max(1, 200_000 // (b - a))
        for i in range(0, len(empty), step):
            part = empty[i : i + step]
            value, found = fresh_draws(sh[a:b], log_weight[a:b], seeds[part])
            win = value.argmin(0)
            chosen = found[win, np.arange(len(part))].astype(np.int64).astype(np.uint64)
            out[d, part] = mix(sh[a:b][win] ^ keyed(chosen, 4)) | np.uint64(1)
    by = out.reshape(n, bands, rows)
    key = np.zeros((n, bands), np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(5) + by[:, :, k])
    return key


class Weights:
    """idf of the hashed cells, from 1 to 2."""

    def __init__(self, df: np.ndarray, documents: int):
        rare = np.log((documents + 1.0) / (np.minimum(df, documents) + 1.0)) / np.log(CELLS)
        self.idf = (1.0 + np.minimum(rare, 1.0)).astype(np.float32)

    def of(self, sh: np.ndarray) -> np.ndarray:
        return self.idf[cells(sh)].astype(np.float64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each cell's shingles occur."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for pdf in batches:
            all_texts = list(pdf["text"])
            for s in text_slices(all_texts):
                total += np.bincount(cells(shingles(all_texts[s])[1]), minlength=CELLS)
        return total

    return summed_vector(texts, count, CELLS)


def similar(a: tuple, b: tuple, weights: Weights, threshold: float = SIMILARITY) -> bool:
    """Whether two texts' (shingles, counts), sorted, are near duplicates."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j])
    for idf in (lambda x: weights.of(x), lambda x: np.ones(len(x))):
        inter = float((low * idf(both)).sum())
        total = float((a[1] * idf(a[0])).sum() + (b[1] * idf(b[0])).sum()) - inter
        if total > 0 and inter >= threshold * total - 1e-9:
            return True
    return False


def block_edges(texts: list[str], comp: np.ndarray, left: np.ndarray, right: np.ndarray, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """Forest edges among texts of a block: pairs (left, right) of different components that are near duplicates."""
    doc, sh, times = shingles(texts)
    # Each occurrence is an element of its own, so that sums of minima are sums over common elements.
    row = np.repeat(np.arange(len(sh)), times)
    nth = np.arange(len(row)) - np.repeat(offsets(times)[:-1], times)
    element = mix(sh[row] + np.uint64(1 << 50) * nth.astype(np.uint64))
    who, idf = doc[row], weights.of(sh[row])
    n = len(texts)
    size = np.stack([np.bincount(who, idf, n), np.bincount(who, minlength=n)])
    _, place, df = np.unique(element, return_inverse=True, return_counts=True)
    shared = df[place] > 1
    who, idf, place = who[shared], idf[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    who, idf, place = who[order], idf[order], place[order]
    side = np.full((2, n), -1)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    inter = np.zeros((2, len(left), len(right)), np.float32)
    last = int(place[-1]) + 1 if len(place) else 0
    for a in range(0, last, 4096):
        i, j = np.searchsorted(place, [a, a + 4096])
        m = np.zeros((2, n, min(4096, last - a)), np.float32)
        m[0, who[i:j], place[i:j] - a] = np.sqrt(idf[i:j])
        m[1, who[i:j], place[i:j] - a] = 1.0
        inter += m[:, left] @ m[:, right].transpose(0, 2, 1)
    total = size[:, left, None] + size[:, None, right] - inter
    near = ((inter >= (threshold - 1e-6) * total) & (total > 0)).any(0)
    near &= comp[left][:, None] != comp[right][None, :]
    i, j = np.nonzero(near)
    return forest(n, left[i], right[j])


def text_keys(text: Column, usable: Column) -> list[Column]:
    """Two 64-bit hashes of the whole text, null where a row is not ``usable``."""
    return [F.when(usable, F.xxhash64(text)).alias("h1"), F.when(usable, F.xxhash64(F.lit(7), text)).alias("h2")]


def verdicts(base: DataFrame, ids: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Written table of the texts that have a twin: h1, h2, n rows, class_id, and where the class's row has this text its
    doc_id (keep_id), one row's uid (keep_uid) and how often the row is repeated (again).

    ``base`` has doc_id, text, h1, h2; ``ids`` is a written table of uid, doc_id, h1, h2 and bytes."""
    spark = prepared(base.sparkSession)
    text = ["h1", "h2"]
    # By text and id first: what a frequent text sends to one task is one row a task and id.
    exact = ids.where("h1 is not null").groupBy(*text, "doc_id").agg(F.count(F.lit(1)).alias("again"), F.min("uid").alias("uid"), F.first("bytes").alias("bytes"))
    first = F.min(F.struct("doc_id", "again", "uid")).alias("f")
    exact = exact.groupBy(*text).agg(first, F.sum("again").alias("n"), F.first("bytes").alias("bytes"))
    exact = exact.select(*text, "n", "bytes", F.col("f.doc_id").alias("rep"), "f.again", F.col("f.uid").alias("node"))
    exact = write_table(exact, "minhash-exact")
    usable = base.where("h1 is not null").select(*text, "text")
    documents = exact.agg(F.sum("n")).first()[0] or 0
    weights = spark.sparkContext.broadcast(Weights(document_frequencies(usable.select("text")), documents))

    def sign(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            names = list(zip(b.column("h1").to_pylist(), b.column("h2").to_pylist()))
            # One of each text that this task has met of late; the rest are told apart later.
            fresh = [i for i, k in enumerate(names) if k not in seen and not seen.add(k)]
            if len(seen) > 20_000:
                seen = set()
            for s in text_slices([texts[i] for i in fresh]):
                part = fresh[s]
                doc, sh, times = shingles([texts[i] for i in part])
                made = signatures(doc, sh, times * weights.value.of(sh), len(part))
                full = np.flatnonzero(np.bincount(doc, minlength=len(part)))
                row = pa.array(np.repeat(np.array(part, np.int64)[full], BANDS))
                key = made[full] ^ keyed(np.arange(BANDS, dtype=np.uint64), 5)  # a bucket's name, its band included
                yield pa.RecordBatch.from_arrays([b.column("h1").take(row), pa.array(mix(key).reshape(-1).view(np.int64))], names=["h1", "key"])

    banded = write_table(usable.mapInArrow(sign, "h1 long, key long"), "minhash-bands")
    # Buckets of two or more texts. Texts go by one of their hashes here: two of one hash would both be members.
    sizes = banded.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("key")
    sizes = write_table(sizes, "minhash-buckets")
    members = banded.join(broadcast_if_small(sizes, sizes.count()), "key", "left_semi").groupBy("key", "h1").agg(F.lit(1).alias("_")).drop("_")
    members = write_table(members.join(exact.select("h1", "node", "bytes"), "h1").drop("h1"), "minhash-joined")
    # Buckets of the same members are one.
    seen = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *seen)
    sizes = sizes.groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key", "size")
    bucket = ["key"]
    members = write_table(members.join(broadcast_if_small(sizes, sizes.count()), bucket), "minhash-members")
    central = members.groupBy("node").agg(F.sum("size").alias("mates"))
    led = members.select(*bucket, "node").join(central, "node").groupBy(*bucket)
    leaders = led.agg(F.max(F.struct("mates", (-F.col("node")).alias("minus"))).alias("m")).select(
        *bucket, (-F.col("m.minus")).alias("leader")
    )
    pairs = members.join(leaders, bucket).where("node <> leader").groupBy("leader", "node").agg(F.lit(1).alias("_")).drop("_")
    pairs = write_table(pairs, "minhash-pairs")
    involved = write_table(central.select("node").join(exact, "node").select(*text, "node"), "minhash-involved")
    texts = usable.join(broadcast_if_small(involved, involved.count()), text).groupBy("node").agg(F.first("text").alias("text"))
    texts = write_table(texts, "minhash-texts")

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            a, c = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            good: list[int] = []
            for s in text_slices([x + y for x, y in zip(a, c)]):
                distinct = {t: i for i, t in enumerate(dict.fromkeys(a[s] + c[s]))}
                doc, sh, times = shingles(list(distinct))
                spans = np.searchsorted(doc, np.arange(len(distinct) + 1))
                of = lambda t: (sh[(x := slice(spans[distinct[t]], spans[distinct[t] + 1]))], times[x])  # noqa: B023, E731
                good += [s.start + i for i, (x, y) in enumerate(zip(a[s], c[s])) if similar(of(x), of(y), weights.value, similarity)]
            row = pa.array(np.array(good, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("leader").take(row), b.column("node").take(row)], names=["a", "b"])

    # A leader of more than HOT pairs has its text in several parts of the join.
    hot = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1")
    hot = write_table(hot, "minhash-hot")
    hot = broadcast_if_small(hot, hot.count())
    parts = F.coalesce("parts", F.lit(1))
    many = pairs.join(hot, "leader", "left").select("leader", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"))
    one = texts.toDF("leader", "text_a").join(pairs.select("leader").distinct(), "leader", "left_semi").join(hot, "leader", "left")
    one = one.select("leader", "text_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    near = many.join(texts.toDF("node", "text_b"), "node").join(one, ["leader", "salt"]).select("leader", "node", "text_a", "text_b")
    edges = write_table(near.mapInArrow(verify, "a long, b long"), "minhash-edges")
    roots = components(edges, "minhash-components")

    # What is left: buckets of several components. Side 0 is outside the largest one.
    placed = members.join(roots.toDF("node", "root"), "node", "left").select(*bucket, "node", "bytes", F.coalesce("root", "node").alias("comp"))
    comps = placed.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b"))
    most = F.max(F.struct("c", "comp", "b"))
    whole = comps.groupBy(*bucket).agg(most.alias("m"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("k"))
    cuts = lambda c, b: F.ceil(F.greatest(c / BLOCK, b / BLOCK_BYTES)).cast("int")
    mixed = whole.where("k > 1").select(
        *bucket,
        F.col("m.comp").alias("main"),
        cuts(F.col("c") - F.col("m.c"), F.col("b") - F.col("m.b")).alias("others"),
        cuts(F.col("m.c"), F.col("m.b")).alias("mains"),
    )
    rest = placed.join(mixed, bucket).withColumn("inner", F.col("comp") == F.col("main"))
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # Block (0, i, j): parts i and j of the others; block (1, i, j): part i of the others with part j of the largest.
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("lo"), j.alias("hi"))
    mine = F.col("mine")
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: block(0, F.least(mine, j), F.greatest(mine, j)))
    across = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: block(1, mine, j))
    inside = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: block(1, i, mine))
    rest = rest.withColumn("x", F.explode(F.when(F.col("inner"), inside).otherwise(F.concat(among, across))))
    rest = rest.select(*bucket, "node", "comp", "inner", "mine", "x.kind", "x.lo", "x.hi").join(texts, "node")

    def compare(table):
        import pyarrow as pa

        mine, names = table.column("mine").to_numpy(), table.column("node").to_numpy()
        kind, lo, hi = (table.column(c)[0].as_py() for c in ("kind", "lo", "hi"))
        inner = table.column("inner").to_numpy(zero_copy_only=False)
        left = np.flatnonzero(~inner) if kind else np.flatnonzero(mine == lo)
        right = np.flatnonzero(inner) if kind else np.flatnonzero(mine == hi)
        tree = block_edges(table.column("text").to_pylist(), table.column("comp").to_numpy(), left, right, weights.value, similarity)
        a = np.array([names[i] for i, _ in tree], np.int64)
        b = np.array([names[j] for _, j in tree], np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    more = write_table(rest.groupBy(*bucket, "kind", "lo", "hi").applyInArrow(compare, "a long, b long"), "minhash-more")
    roots = write_table(components(edges.union(more), "minhash-components"), "minhash-roots")
    # The class's row is the one of the least doc_id; texts alone in their class have their own.
    together = roots.union(roots.select("root", "root").distinct())
    classed = exact.join(together.toDF("node", "class"), "node")
    best = classed.groupBy("class").agg(F.min(F.struct("rep", "node")).alias("best"))
    classed = classed.join(best, "class")
    alone = exact.where("n > 1").join(together.select("node"), "node", "left_anti")
    alone = alone.withColumn("best", F.struct("rep", "node"))
    out = classed.drop("class").unionByName(alone)
    won = F.col("best.node") == F.col("node")
    out = out.select(*text, "n", F.col("best.rep").alias("class_id"), *[F.when(won, F.col(c)).alias(k) for c, k in (("rep", "keep_id"), ("node", "keep_uid"), ("again", "again"))])
    return write_table(out, "minhash-verdicts")


def _base(docs: DataFrame) -> DataFrame:
    usable = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return as_documents(docs, "doc_id", "text").select("doc_id", "text", *text_keys(F.col("text"), usable))


def _ids(base: DataFrame) -> DataFrame:
    size = F.octet_length("text").cast("long").alias("bytes")
    return write_table(base.select("doc_id", "h1", "h2", size, F.monotonically_increasing_id().alias("uid")), "minhash-ids")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and kept of every row."""
    base = _base(docs)
    ids = _ids(base)
    out = with_facts(ids, verdicts(base, ids, similarity), ["h1", "h2"], "n", HOT)
    kept = F.col("class_id").isNull() | F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(False))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), kept.alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns: a row of the least doc_id."""
    base = _base(docs)
    found = verdicts(base, _ids(base))
    usable = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    rows = boxed(docs, "doc_id", "text").select("_row", "doc_id", *text_keys(F.col("text"), usable))
    rows = with_facts(rows, found, ["h1", "h2"], "n", HOT)
    out = rows.where(F.col("class_id").isNull() | (F.col("keep_id") == F.col("doc_id")))
    if found.where("again > 1").limit(1).count():
        # Rows that repeat id and text: the first of each in a task goes on, so that frequent ones are few.
        again = F.coalesce("again", F.lit(1)) > 1
        once = out.where(again).groupBy("h1", "h2").agg(F.first("_row").alias("_row"))
        return out.where(~again).select("_row.*").unionByName(once.select("_row.*"))
    return out.select("_row.*")
