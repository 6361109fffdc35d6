"""Packing, wavelet shards and BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from turnwright.llm import bpe, packing, wavelet
from turnwright.llm.tokens import ChunkEncoder, Store, distinct, production_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(production_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def hard_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCÄÖÜéèñ .,'!?<|>09\n\t\x1c ́日ſİΣ"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(300)]
    return texts + ["", " ", "don't 'S 'RE x''s", "<|startoftext|>a<|endoftext|>b", "Å é", "ß ẞ ǅ", "a" * 61, "A" * 60 + "!!", "x" * 61 + "."]


def test_encoder_equals_library(library):
    texts = hard_texts()
    small = ChunkEncoder(production_path(), limit=300)  # starts anew many times
    for enc in (ChunkEncoder(production_path()), small):
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of(library, t).tolist() for t in texts]
    assert enc.encode([]) == []


def test_distinct_and_store():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 4000)]
    one, code = distinct(keys, bits=6)
    assert len(one) == len(np.unique(keys)) and (keys[one][code] == keys).all()
    store = Store(1000)
    place = store.find(keys[one])
    assert (place < 0).all()
    ids = [np.array([i, i + 1], "<u4").tobytes() for i in range(len(one))]
    place = store.add(keys[one], place, ids)
    assert (store.find(keys[one]) == place).all() and store.flat[store.begin[place[7]]] == 7


def test_other_tokenizers_go_to_the_library(library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, other = ChunkEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_chunk
    texts = ["Hello  world\n", "", "ünï"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    codec = bpe.Codec(path)
    for t, n, a, b in zip(texts, *codec.digest(texts)):
        ids = other.encode(t, add_special_tokens=False).ids
        assert n == len(ids) and b == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("leaf", [8, 64])
def test_tree_concatenation(library, leaf):
    rng = random.Random(leaf)
    codec = bpe.Codec(production_path(), leaf=leaf)
    texts = ["".join(rng.choices(al, k=n)) for al in ("abcdethinores", "ab", "a", "éàüabß", "!?.,", "日本語", "aA1!é") for n in (leaf, leaf + 1, 5 * leaf, 1000)]
    texts += ["x " + "hello" * 300 + " y <|endoftext|>" + "w" * 500, "internationalization" * 100]
    for t, n, a, b in zip(texts, *codec.digest(texts)):
        ids = ids_of(library, t)
        assert (n, a) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), t[:30]
        assert b == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_tree_concatenation_around_special_tokens(library, monkeypatch):
    """Runs with tokens cut out of them, by several threads."""
    monkeypatch.setattr(bpe, "SHARE", 2)
    rng = random.Random(9)
    run = lambda n: "".join(rng.choices("abcdethinores<|>", k=n))
    texts = [run(3000), "a" + run(900) + "<|endoftext|>" + run(900), "<|startoftext|><|endoftext|>" + "z" * 700, "<|endoftext|" + "q" * 700]
    codec = bpe.Codec(production_path(), leaf=32)
    for t, n, a, b in zip(texts, *codec.digest(texts)):
        ids = ids_of(library, t)
        assert (n, a) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), t[:30]
        assert b == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_are_encoded_in_pieces(library, monkeypatch):
    from turnwright.llm import minhash, tokens

    text = " ".join(random.Random(1).choices("the quick Brown, fox über \x0b jumps日 x" .split(" "), k=3000))
    whole = tokens.word_hashes([text, "a b"])
    shingled = minhash.shingles([text, "", "a b"])
    enc = ChunkEncoder(production_path())
    want = [ids_of(library, t).tolist() for t in (text, "", "a" * 900)]
    monkeypatch.setattr(tokens, "SLICE", 100)
    assert list(tokens.cut_at_space("aa bb", 3)) == ["aa bb"] and "".join(tokens.cut_at_space(text, 100)) == text
    sizes: list[int] = []
    arrays = enc.arrays
    monkeypatch.setattr(enc, "arrays", lambda part: sizes.append(sum(map(len, part))) or arrays(part))
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([text, "", "a" * 900])] == want and sorted(sizes)[-2] < 220
    again = tokens.word_hashes([text, "a b"])
    assert all((a == b).all() for a, b in zip(whole, again))
    assert all((a == b).all() for a, b in zip(shingled, minhash.shingles([text, "", "a b"])))


def test_round_trip_rows(docs, no_docs, library):
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.round_trip(docs).collect())
    assert got == sorted((r.doc_id or 0, len(ids_of(library, r.text))) for r in docs.collect())
    assert bpe.round_trip(no_docs).count() == 0


def test_packing(docs, no_docs, library):
    out = packing.pack(docs, size=256).toPandas()
    for r in docs.collect():
        if r.doc_id in (None, 6):
            continue
        want = np.append(ids_of(library, r.text), np.uint32(2)).astype("<u4")
        mine = out[out.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(want) and (mine.doc_tokens == len(want)).all()
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
        assert [zlib.crc32(want[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    fill = out.groupby("sequence_id").length.sum()
    assert (fill.iloc[:-1] == 256).all() and fill.iloc[-1] <= 256
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist()
    assert packing.pack(no_docs).count() == 0


def walked(rows, library, size, targets=None, unit=None):
    """Deficit round-robin served round by round, a queue at a time: (doc_id, start, length, sequence, offset) of all pieces."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    unit = unit or size // 4
    queues = {}
    for doc, text, source in rows:
        n = len(ids_of(library, text)) + 1
        name = packing.queue_name(source)
        queues.setdefault(name, []).extend((doc, at, min(unit, n - at)) for at in range(0, n, unit))
    names = SparkSession.getActiveSession().createDataFrame([(q,) for q in queues], "queue string")
    part = {r.queue: r.c for r in names.select("queue", packing.covered().alias("c")).collect()}
    total = {q: sum(n for _, _, n in units) for q, units in queues.items()}
    aim = {packing.queue_name(s): t for s, t in (targets or {}).items()}
    first = [q for q in queues if aim.get(q, 0) > 0]
    order = []
    for group in (first, [q for q in queues if q not in first]):
        weight = {q: aim[q] if q in first else total[q] for q in group}
        turn, left, spent = 0, {q: list(queues[q]) for q in group}, dict.fromkeys(group, 0)
        while any(left.values()):
            turn += 1
            for q in sorted(group):
                # Credit is what the queue has earned in all rounds, less what it has served.
                credit = turn * (size * weight[q] / sum(weight.values())) - spent[q]
                while left[q] and part[q] * left[q][0][2] < credit:
                    doc, at, n = left[q].pop(0)
                    order.append((turn, q, doc, at, n))
                    spent[q] += n
                    credit -= n
    out, position, last = [], 0, None
    for turn, q, doc, at, n in order:
        while n:
            sequence, offset = divmod(position, size)
            take = min(n, size - offset)
            if last == (turn, doc, at, sequence) and at:
                out[-1][2] += take
            else:
                out.append([doc, at, take, sequence, offset])
            position, at, n = position + take, at + take, n - take
            last = (turn, doc, at, sequence)
    return sorted(map(tuple, out))


def pieces(out):
    return sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in out.collect())


@pytest.mark.parametrize("size, unit", [(128, None), (64, 5), (300, 300), (4096, None)])
@pytest.mark.parametrize("targets", [None, {"hot": 0.5, None: 0.5}, {"s1": 1.0, "nobody": 3.0}])
def test_packing_equals_rounds_one_by_one(spark, library, size, unit, targets):
    rows = [(i, "word " * (1 + i * 7 % 90), ["hot", "hot", None, f"s{i % 7}"][i % 4]) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert pieces(packing.pack(df, size=size, targets=targets, unit=unit)) == walked(rows, library, size, targets, unit)


def test_every_window_keeps_the_mixture(spark):
    """What a source has got by the end of any sequence is its share, but for one unit of it and of each other source."""
    rows = [(i, "word " * (20 + i % 13), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for unit in (1, 32):
        out = packing.pack(df, size=128, unit=unit).toPandas()
        share = out.groupby("queue").length.sum() / out.length.sum()
        table = out.pivot_table(index="sequence_id", columns="queue", values="length", aggfunc="sum", fill_value=0)
        away = abs(table.iloc[:-1].cumsum() - np.outer(np.arange(1, len(table)), 128 * share[table.columns]))
        assert (away <= unit * (len(share) + 1) + 128 * share[table.columns]).all().all()


def test_documents_are_whole_where_a_sequence_has_room(spark):
    rows = [(i, "word " * (20 + i % 50), ["hot", f"s{i % 40}"][i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = packing.pack(df).toPandas()
    assert len(out) <= 2000 + out.sequence_id.nunique()


def test_targets_hold_while_sources_last(spark):
    rows = [(i, "word " * 30, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, size=100, targets={"a": 0.8, "b": 0.2}).toPandas()
    first = out[out.sequence_id < 20].groupby("queue").length.sum()
    assert abs(first["=a"] - 1600) <= 2 * 31 and abs(first["=b"] - 400) <= 2 * 31 and out.length.sum() == 200 * 31


def test_targets_hold_among_many_sources(spark):
    rows = [(i, "word " * 30, ["a", None, f"s{i % 97}"][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, size=4096, targets={"a": 0.75, None: 0.25}).toPandas()
    first = out[out.sequence_id < 2].groupby("queue").length.sum()
    assert abs(first["=a"] - 6144) <= 2 * 31 and abs(first["null"] - 2048) <= 2 * 31 and out.length.sum() == 900 * 31


def test_many_sources(spark):
    """20,000 sources: queues are rows, not numbers that the driver or a task goes through."""
    rows = [(i, "word " * (1 + i % 4), f"s{i % 20000}") for i in range(24000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, size=4096).toPandas()
    assert out.length.sum() == sum(2 + i % 4 for i in range(24000)) and out.queue.nunique() == 20000
    assert (out.groupby("sequence_id").length.sum().iloc[:-1] == 4096).all()
    middle = out[out.sequence_id < out.sequence_id.max() // 2]
    assert 0.45 < middle.length.sum() / out.length.sum() < 0.5 and middle.queue.nunique() > 8000
    more = packing.pack(df, size=4096, targets={"s7": 0.5, "s9": 0.5}).toPandas()
    first = more[more.queue.isin(["=s7", "=s9"])]
    assert set(first.sequence_id) == {0} and more.length.sum() == out.length.sum()


def test_wavelet_matrix_queries():
    ids = (np.random.default_rng(2).zipf(1.5, 4000) % 700).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, np.array([1, 2]), np.array([1000, 3000])))
    assert (w.decode() == ids).all() and [w.access(i) for i in range(0, 4000, 61)] == ids[::61].tolist()
    for token in (0, 1, 2, 55, 699, 70000):
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at) and w.rank(token, 1234) == (at < 1234).sum()
        for k in (0, len(at) // 2, len(at) - 1):
            assert w.select(token, k) == (at[k] if 0 <= k < len(at) else -1)
        assert w.select(token, len(at)) == -1
    with pytest.raises(IndexError):
        w.access(4000)


def test_wavelet_files_open_few_chunks(monkeypatch):
    """Queries on several chunks, at their edges too; one needs a chunk or two a plane, not the file."""
    monkeypatch.setattr(wavelet, "CHUNK", 1024)
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 1024, 5000, 8192):
        ids = rng.integers(0, 40, n).astype(np.uint32) * 7
        data = wavelet.build(ids, np.array([5]), np.array([n]))
        w = wavelet.WaveletMatrix(data)
        assert (w.decode() == ids).all() and w.opened == 0
        for i in {0, 1, 511, 512, 1023, 1024, n // 2, n - 1} & set(range(n)):
            w = wavelet.WaveletMatrix(data)
            assert w.access(i) == ids[i] and w.opened <= 2 * w.levels
        for token in (0, 7, 273, 280):
            at = np.flatnonzero(ids == token)
            assert w.count(token) == len(at) and all(w.rank(token, i) == (at < i).sum() for i in (0, 1, 512, 1024, 1500, n))
            assert [w.select(token, k) for k in range(len(at))] == at.tolist() and w.select(token, len(at)) == -1


def test_wavelet_shards_of_one_id(spark, library):
    """Nulls and one id on most rows lie in several ranges; starts have no gaps."""
    rows = [(None, f"none {i}") for i in range(40)] + [(3, "the same text")] * 60 + [(3, f"text {i}") for i in range(60)] + [(i, "x y z") for i in range(4, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old, wavelet.RANGE_ROWS = wavelet.RANGE_ROWS, 16
    try:
        files = wavelet.write_shards(df)
        out = wavelet.read_shards(files).toPandas().sort_values("start")
    finally:
        wavelet.RANGE_ROWS = old
    assert files.count() > 6 and len(out) == len(rows)
    assert out.start.tolist() == (out.n_tokens.cumsum() - out.n_tokens).tolist()
    names = [-1 if x != x else int(x) for x in out.doc_id]
    assert names == sorted(-1 if i is None else i for i, _ in rows)
    crc = lambda t: zlib.crc32(np.append(ids_of(library, t), np.uint32(1)).astype("<u4").tobytes())
    assert sorted(out.ids_crc32) == sorted(crc(t) for _, t in rows)


def test_wavelet_shards(docs, no_docs, library):
    for most in (1 << 22, 100):
        out = wavelet.read_shards(wavelet.write_shards(docs, most=most)).toPandas()
        want = {r.doc_id: np.append(ids_of(library, r.text), np.uint32(1)).astype("<u4") for r in docs.collect()}
        out = out.sort_values("start")
        assert len(out) == docs.count() and out.start.tolist() == (out.n_tokens.cumsum() - out.n_tokens).tolist()
        names = [None if x != x else int(x) for x in out.doc_id]
        assert names == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11]
        assert [zlib.crc32(want[i].tobytes()) for i in names] == out.ids_crc32.tolist()
    assert wavelet.read_shards(wavelet.write_shards(no_docs)).count() == 0
