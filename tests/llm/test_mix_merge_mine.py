"""Curriculum mixing, branch merge and hard negatives against plain Python and their SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from turnwright.llm import branches, curriculum, negatives
from turnwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_curriculum_mix", "op12_branch_merge", "op13_hard_negatives"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    sql = con.execute(ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in sql.description)
    at = [[d[0] for d in sql.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())


# Branch merge


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 7


def merged(doc_id, text, lang, source):
    """One row merged by hand: (its result, the row that is added under another id or None)."""
    text, base = text or "", {"lang": lang or "", "source": source or ""}
    lines = text.split("\n")
    state = {}
    for b in "LR":
        mark = lambda c: "!" if c in (1, 3) else "?"
        cols = {k: "" if code(b, doc_id, k) == 0 else v + mark(code(b, doc_id, k)) if code(b, doc_id, k) in (1, 2) else v for k, v in base.items()}
        codes = [code(b, doc_id, i) for i in range(len(lines))]
        own = [None if c == 0 else x + mark(c) if c in (1, 2) else x for c, x in zip(codes, lines)]
        gaps = [mark(c) if c in (3, 4) else None for c in codes]
        row = code(b, doc_id, "row")
        state[b] = cols, own, gaps, row, mark(row) if row in (3, 4) else None
    cells = [(base[k], state["L"][0][k], state["R"][0][k]) for k in ("lang", "source")]
    cells += list(zip(lines, state["L"][1], state["R"][1])) + [(None, x, y) for x, y in zip(state["L"][2], state["R"][2])]
    count, out = [0, 0, 0, 0], []
    for was, x, y in cells:
        if x != was and y != was and x != y:
            count[3 if was is None else 2 if None in (x, y) else 1] += 1
        elif x != was or y != was:
            count[0] += 1
        out.append(x if y == was else y)
    right = [c[2] for c in cells]
    n = len(lines)
    whole = lambda c: (c[0], c[1], "\n".join(v for i in range(n) for v in (c[2 + i], c[2 + n + i]) if v is not None))
    l_drop, r_drop = state["L"][3] == 0, state["R"][3] == 0
    if l_drop or r_drop:
        edits = any(c[2 if l_drop else 1] != c[0] for c in cells) and not (l_drop and r_drop)
        kept = whole(right) if l_drop and edits else (None, None, None)
        result = (doc_id, *kept, *((0, 0, 1, 0) if edits else (1, 0, 0, 0)))
    else:
        result = (doc_id, *whole(out), *count)
    x, y = state["L"][4], state["R"][4]
    if not (x or y):
        return result, None
    clash = bool(x and y and x != y)
    return result, (None if doc_id is None else -1 - doc_id, base["lang"], base["source"], y or x, int(not clash), 0, 0, int(clash))


def test_branch_merge(spark, docs, no_docs):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["", "a", "b b", "ö\t", "x" * 3]) for _ in range(rng.randrange(1, 9))), rng.choice(["en", "", None]), rng.choice(["s", None, 'q"\\\n'])) for i in range(600)]
    rows += [(700 + i, None, None, None) for i in range(30)] + [(5, "twice\nthere", "en", "s")] * 3 + [(None, "no\nid", "en", "s"), (-5, "below", "en", "s")]
    rows += [(9_999, "\n".join(f"line {i}" for i in range(30_000)), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = branches.merge(branches.cells(df)).collect()
    want = [x for r in rows for x in merged(*r) if x]
    assert Counter(map(tuple, out)) == Counter(want)
    assert {k for x in want for k in range(4) if x[4 + k]} == {0, 1, 2, 3}
    digests = branches.merged(df).select("doc_id", "text_sha256").collect()
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, digests)) == Counter((x[0], sha(x[3])) for x in want)
    some = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert Counter(map(tuple, branches.merge(branches.cells(docs)).collect())) == Counter(x for r in some for x in merged(*r) if x)
    assert branches.merged(no_docs).count() == 0


def test_branch_merge_of_other_edits(spark):
    """Cells that a branch lists though they equal base are no changes; other rules for edits are taken."""
    df = spark.createDataFrame([(1, "a\nb", "en", "s")], "doc_id long, text string, lang string, source string")
    base = branches.cells(df, lambda b, i, n: i * 0 + 6)
    again = base.selectExpr("row", "doc_id", "place", "'L' as version", "there", "added", "gap", "value")
    edit = base.where("place = 1").selectExpr("row", "doc_id", "place", "'R' as version", "there", "added", "gap", "'B' as value")
    assert [tuple(r) for r in branches.merge(base.unionByName(again).unionByName(edit)).collect()] == [(1, "en", "s", "a\nB", 1, 0, 0, 0)]


# Curriculum


def mix(rows):
    """doc_id, size, source_size, target, taken by hand: targets step by step, documents by digest."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        share = {s: weight[s] * (sum(total.values()) - sum(3 * total[x] for x in full)) / max(1, sum(weight[x] for x in rest)) for s in rest}
        more = {s for s in rest if share[s] > 3 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * total[s] if s in full else share[s] for s in names}
    return {s: (total[s], target[s]) for s in names}, size


def test_curriculum(spark, docs, no_docs, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["b", "c", "d", "é", "zz", "", None, None])
        rows.append((i if i % 5 else 77, " ".join(["w"] * rng.randrange(0, 40)) if i % 11 else None, source))
    rows += [(4, "the same row", "hot")] * 700 + [(5, "another row", "hot")] * 300 + [(2_000, "tiny", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sources, size = mix(rows)
    plain = curriculum.plan(df)
    monkeypatch.setattr(curriculum, "CELL", 20)
    small = curriculum.plan(df)
    for out in (plain, small):
        got = out.select("doc_id", "size", "source_size", "target", "taken").toPandas()
        assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
        for s, (z, t) in sources.items():
            alike = got[(got.source_size == z) & np.isclose(got.target, t)]
            same = [x for x, v in sources.items() if v[0] == z and math.isclose(v[1], t)]
            assert abs(alike.taken.sum() - len(same) * t) <= len(same), s
    keep = lambda p: Counter(map(repr, map(tuple, p.select("doc_id", "size", "taken").collect())))
    assert keep(small) == keep(curriculum.plan(df.repartition(7)))
    assert {r.copies for r in plain.selectExpr("size(copies) as copies").collect()} == {0, 1, 2, 3}
    assert len(curriculum.mixed(docs).collect()) == docs.count() and curriculum.mixed(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in curriculum.mixed(blank).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0, None), (2, 0, 0, 0.0, 0, 0, None)]


def test_curriculum_order(spark):
    """Positions fill training without gaps worth a document, and sources follow their schedules over time."""
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), "abcdef"[i % 6], "kept") for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position string").repartition(4)
    out = curriculum.arrange(df).select("row.doc_id", "row.source", "row.position", "position", "words").collect()
    at = [r[3] for r in out]
    assert at == sorted(at) and {r[2] for r in out} == {"kept"}
    total = sum(r.words for r in out)
    assert abs(total - sum(len(r[1].split()) for r in rows)) <= 6
    # What was taken before a position is about the position, whatever the mixture at that time.
    before = np.cumsum([0] + [r.words for r in out])[:-1]
    assert np.abs(before - np.array(at)).max() <= 6 * 8
    third = lambda k, n: sum(r.words for r in out if r.source in k and (n - 1) * total / 3 <= r[3] < n * total / 3)
    assert third("ad", 1) > 1.2 * third("ad", 3) and third("cf", 3) > 1.5 * third("cf", 1)


def test_schedule():
    rates, demand = curriculum.schedule([0.6, 0.3, 0.1])
    assert all(abs(sum(s * r[j] for s, r in zip([0.6, 0.3, 0.1], rates)) - 1) < 1e-12 for j in range(3))
    assert all(d[0] == 0 and d[-1] == 1 and d == sorted(d) for d in demand) and min(map(min, rates)) > 0
    with pytest.raises(ValueError):
        curriculum.schedule([0.5, 0.5], [(4.0, 0.0, 0.0), (0.0, 0.0, 4.0)])


# Hard negatives


def hard_negatives(rows):
    good = [(i, label, v) for i, (vec, label, v) in enumerate(rows) if vec is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ids = [r[0] for r in rows]
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, _, v in good}
    kind = {i: (label + 1) % 10 if ids[i] % 7 == 0 else label for i, label, _ in good}
    out = []
    for a in q:
        if ids[a] % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(q[a], q[b])), ids[b], b) for b in q if b != a and len(q[a]) == len(q[b])]
        pos = sorted(s for s in scores if kind[s[2]] == kind[a])[:5]
        for p in pos:
            far = sorted(s[:2] for s in scores if kind[s[2]] != kind[a] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:10]
            out += [(ids[a], p[1], i + 1, n[1], -p[0], -n[0]) for i, n in enumerate(far)]
    return Counter(out)


VECTORS = "vec_id long, label int, embedding array<float>"


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 10)), (rng.normal(0.3, 1, 6)).tolist()) for i in range(500)]
    same = [0.5, 0.5, 0.5, 0.25, 0.0, 0.25]
    rows += [(1_000 + i * 3, int(rng.integers(0, 4)), same) for i in range(400)]  # ties of scores
    rows += [(5_001, 3, same)] * 150 + [(100, 2, same)] * 3  # rows that repeat an id
    rows += [(600, None, same), (None, 1, same), (700, 1, None), (800, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (900, 1, [float("nan")] * 6), (902, 1, [float("inf")] * 6)]
    rows += [(1 << 62, 5, same), (-100, 5, same), (-(1 << 62) - 4, 5, [-x for x in same])]
    rows += [(1_100_000 + i, i % 3, [0.5, float(i)]) for i in range(0, 300, 20)] + [(1_200_000 + i, 1, []) for i in range(3)]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "LABEL").selectExpr("*", "1 as n", "2 as q").repartition(4)
    got = Counter(map(tuple, negatives.mine(df).collect()))
    want = hard_negatives(rows)
    assert got == want and len(want) > 500
    monkeypatch.setattr(negatives, "FEW", 2)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "SENT", 0)
    assert Counter(map(tuple, negatives.mine(df).collect())) == want
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    """Integers beyond what doubles hold, and vectors that are too long for integer scores."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [float(x) for x in np.float32(rng.normal(1, 1, 4) * 300_000)]) for i in range(0, 400, 2)]
    got = Counter(map(tuple, negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == hard_negatives(rows)
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(100, 1, [1e30])], VECTORS))
