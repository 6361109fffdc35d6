"""Sharding, near duplicates of texts and vectors, components and the pipeline, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from turnwright.llm import minhash, sharding, vectors
from turnwright.llm.common import components, ranked


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(500, edges)
    assert all(got.get(i, i) == want[i] for i in range(500))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "g int, i int")
    out = ranked(df, ["g"], ["i"], 500, target=20).toPandas()
    assert all(sorted(x["rank"]) == list(range(len(x))) for _, x in out.groupby("g"))


def test_sharding(spark, docs, no_docs):
    rng = random.Random(4)
    texts = [f"single {i}" for i in range(150)] + ["hot"] * 120 + [f"group {i % 20}" for i in range(100)] + [None] * 5
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = sharding.assign(df).toPandas()
    counts = out.groupby("shard").size().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1 and len(out) == len(texts)
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("shard"))
    out["text"] = [texts[i] for i in out.doc_id]
    spread = out[out.text.notna()].groupby("text").shard.nunique()
    assert (spread[spread.index.str.startswith("group")] == 1).mean() >= 0.9
    assert spread["hot"] <= -(-120 // counts.min()) + 3
    assert out[out.text.isna()]["size"].eq(8).all() and out.grown_shard.isna().all()
    some = sharding.assign(docs).toPandas()
    assert len(some) == docs.count() and some.groupby("shard").size().max() == 1
    assert sharding.assign(no_docs).count() == 0


def test_sharding_keeps_groups_together(spark):
    """Hot groups take no more shards than their rows need; small ones stay whole, by rounds and by the driver."""
    texts = ["hot"] * 320 + ["warm"] * 100 + [f"pair {i // 2}" for i in range(240)] + [f"single {i}" for i in range(300)]
    random.Random(5).shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for few in (sharding.FEW, 0):
        out = sharding.assign(df, few=few).toPandas()
        assert sorted(out.doc_id) == list(range(960)) and set(out.groupby("shard").size()) == {40}
        assert all(sorted(x.slot) == list(range(40)) for _, x in out.groupby("shard"))
        spread = out.assign(text=[texts[i] for i in out.doc_id]).groupby("text").shard.nunique()
        assert spread["hot"] == 8 and spread["warm"] == 3
        assert (spread[spread.index.str.startswith("pair")] == 1).all()


def test_sharding_splits_what_fits_nowhere(spark):
    """Groups of five and nothing else: each shard has room for four whole ones, the others fill the gaps."""
    df = spark.createDataFrame([(i, f"text {i // 5}") for i in range(575)], "doc_id long, text string").repartition(3)
    out = sharding.assign(df, few=0).toPandas()
    counts = out.groupby("shard").size()
    assert sorted(out.doc_id) == list(range(575)) and len(counts) == 24 and counts.max() - counts.min() <= 1
    assert (out.assign(text=out.doc_id // 5).groupby("text").shard.nunique() == 1).sum() == 96


def least_cut(sizes, caps):
    """Fewest pairs of equal texts on different shards, by trying all placements; the rest of the room is for single rows."""
    best = [10**9]

    def go(i, room, cut):
        if cut >= best[0]:
            return
        if i == len(sizes):
            best[0] = cut
            return

        def deal(left, s, parts):
            if s == len(room):
                if not left:
                    here = sum(a * b for k, a in enumerate(parts) for b in parts[:k])
                    go(i + 1, [r - p for r, p in zip(room, parts)], cut + here)
                return
            for p in range(min(left, room[s]) + 1):
                deal(left - p, s + 1, [*parts, p])

        deal(sizes[i], 0, [])

    go(0, caps, 0)
    return best[0]


@pytest.mark.parametrize("few", [2000, 0])
@pytest.mark.parametrize("sizes, single", [([4, 3, 3, 2], 3), ([9, 2, 2], 2), ([5, 5, 5], 0), ([2, 2, 2, 2, 2], 5), ([7, 4], 4)])
def test_sharding_cuts_as_few_links_as_any_placement(spark, sizes, single, few):
    texts = [f"g{i}" for i, k in enumerate(sizes) for _ in range(k)] + [f"s{i}" for i in range(single)]
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    out = sharding.assign(df, shards=3, few=few).toPandas()
    out["text"] = [texts[i] for i in out.doc_id]
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(out) == len(texts)
    cut = sum((len(g) ** 2 - sum(len(x) ** 2 for _, x in g.groupby("shard"))) // 2 for _, g in out.groupby("text"))
    n = len(texts)
    assert cut <= least_cut(sizes, [n // 3 + (i < n % 3) for i in range(3)]) + (few == 0)


def test_sharding_renews_labels(spark):
    """Many groups for little room: refused ones look for other shards, round after round, and all but a few stay whole."""
    texts = [f"group {i // 3}" for i in range(24 * 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = sharding.assign(df, few=0).toPandas()
    assert set(out.groupby("shard").size()) == {60}
    assert (out.assign(text=out.doc_id // 3).groupby("text").shard.nunique() == 1).all()


def brute_vectors(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base, base[:4] + 0.03 * rng.standard_normal((4, 16)), np.repeat(base[:1], 30, 0), base[5] + 0.02 * rng.standard_normal((60, 16))])
    labels = np.array([0] * len(x))
    labels[3] = 1
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, base[0].tolist(), None), (1004, [], 0), (1005, [None] * 16, 0), (1006, base[0].tolist()[:8], 0), (1007, (1e200 * base[0]).tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    near = brute_vectors(x, labels)
    for block in (1024, 16):
        out = {r.vec_id: r for r in vectors.link(df, block=block).collect()}
        extra = (near[0].sum() + 1) * 0
        for i in range(len(x)):
            scaled = int(x[i] @ base[0] / np.linalg.norm(x[i]) / np.linalg.norm(base[0]) >= 0.98 and labels[i] == 0)
            assert out[i].n_links == near[i].sum() + scaled + extra
        want = roots(len(x), np.argwhere(near))
        assert [out[i].component_id for i in range(len(x))] == want
        assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(1000, 1007))
        assert out[1007].component_id == 0
    none = df.where("vec_id < 0")
    assert vectors.link(none).count() == 0


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choices(words, k=rng.choice([3, 30, 80, 300])) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[5:25]:
        for _ in range(rng.randrange(1, 4)):
            c = list(b)
            for _ in range(max(1, len(c) // 60)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    template = base[30] + base[31]
    for _ in range(60):
        c = list(template)
        for _ in range(rng.randrange(0, 6)):
            c[rng.randrange(len(c))] = rng.choice(words)
        texts.append(" ".join(c))
    return texts + [texts[0]] * 7 + ["", "", "tiny", "tiny", "   "]


def test_near_duplicates(spark, docs, no_docs):
    texts = near_texts()
    sets = [Counter(zip(*[w[k:] for k in range(5)])) if len(w := t.split()) >= 5 else Counter([tuple(w)] if w else []) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            inter = (a & sets[j]).total()
            total = a.total() + sets[j].total() - inter
            if texts[i] == texts[j] or (total and inter >= 0.8 * total):
                links.append((i, j))
    want = roots(len(texts), links)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = [r.class_id for r in minhash.classes(df).orderBy("doc_id").collect()]
    assert got == want
    some = {r.doc_id: r for r in minhash.classes(docs).collect()}
    assert some[1].class_id == 1 and some[6].class_id == 5 and some[8].class_id == 7 and some[None].kept
    kept = minhash.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11]
    assert minhash.classes(no_docs).count() == 0 and minhash.filter_documents(no_docs).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """No text is lost by its id; of equal rows one stays, also where one text holds most rows."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(500)], k=n))
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(3, b), (7, a), (7, b), (7, a), (8, c), (8, d), (8, c), (2, d), (None, a), (9, None), (9, None), (9, "")] + [(50, "hot text of few words")] * 40 + [(60 + i, "hot text of few words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in minhash.filter_documents(df).collect()), key=repr)
    want = [(3, b), (7, a), (8, c), (2, d), (None, a), (9, None), (9, None), (9, ""), (50, "hot text of few words")]
    assert kept == sorted(want, key=repr)
    out = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.classes(df).where("doc_id < 50").collect()))
    assert out == [(2, 2, True), (3, 3, True), (7, 3, False), (7, 7, False), (7, 7, True), (8, 2, False), (8, 8, False), (8, 8, True), (9, 9, True), (9, 9, True), (9, 9, True)]
    for hot in (1, 4096):
        old, minhash.HOT = minhash.HOT, hot
        try:
            got = minhash.classes(df.where("doc_id >= 50")).collect()
        finally:
            minhash.HOT = old
        assert {r.class_id for r in got} == {50} and sum(r.kept for r in got) == 1


def test_blocks_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    """The same classes whatever the size of blocks, and with salted leaders."""
    texts = near_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = [r.class_id for r in minhash.classes(df).orderBy("doc_id").collect()]
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "HOT", 4)
    assert [r.class_id for r in minhash.classes(df).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    assert [r.class_id for r in minhash.classes(df).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("size", [18, 90, 900])
def test_signature_agreement_estimates_similarity(size):
    """On average and pair by pair, for texts with fewer and with more shingles than bins."""
    rng = np.random.default_rng(3)
    hits = []
    for t in range(40):
        common = rng.integers(0, 1 << 44, size, dtype=np.uint64)
        pair = [np.unique(np.concatenate([common, rng.integers(0, 1 << 44, size // 9, dtype=np.uint64)])) for _ in range(2)]
        doc = np.repeat([0, 1], [len(p) for p in pair])
        key = minhash.signatures(doc, np.concatenate(pair), np.ones(len(doc)), 2, bands=120, rows=1)
        hits.append((key[0] == key[1]).mean())
    assert abs(np.mean(hits) - 90 / 110) < 0.03 and np.std(hits) < 0.12 and min(hits) > 0.5


def test_pipeline(spark, docs, tmp_path):
    docs.drop("score", "_row", "queue").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = at
        at = stage(spark, at, str(tmp_path))
        assert at.columns == before.columns and at.count() <= before.count(), name
    assert set(out.doc_id.dropna().astype(int)) == {r.doc_id for r in at.collect() if r.doc_id is not None}
