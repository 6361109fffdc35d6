"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Texts are sentences of windows. A window is a white-space chunk without its marks, two neighbouring chunks put together
or three short ones (up to WINDOW letters), or a run of chunks of one or two letters; of a longer one every WINDOW letters.
So an insult is met with marks or blanks between its letters. The kernel of two windows sums over their common
subsequences of three characters (the first may be the window's beginning), each occurrence weighted by DECAY to the power
of the span it covers, up to SPAN characters: an insult with inserted characters keeps most of its subsequences.
The kernel is normalised by the weight of all subsequences of a window's length.

A sentence scores as its highest window, a text as its highest sentence. Labels are given for texts, so training
is by multiple instances: a toxic text stands for its highest-scoring sentences, a clean one for all of its
sentences, each by its highest window; witnesses and hard negatives are chosen anew in each round. Windows of both
kinds are learned with characters inserted, too, so that the machine need not guess how much an insertion changes.
As the machine is linear in the landmarks' kernels, and these are linear in subsequences, its weights fold into one
table of subsequences.

The classifier is fitted on a bounded sample: at most MAX_TOXIC and MAX_CLEAN labelled rows of at most
MAX_CHARS characters. All texts are scored whole.

Cases: null and empty texts get the score of a text without any subsequence. Without labels of both kinds
every score is 0. Conflicting labels of a doc_id count as toxic. Repeated rows get equal scores."""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.llm.common import Lexicon, append, as_documents, held_out, offsets, prepared, text_slices, worker_state

MAX_TOXIC = 1500
MAX_CLEAN = 3000
MAX_CHARS = 20_000
LANDMARKS = 512
DECAY = 0.7
SPAN = 6
WINDOW = 12
ROUNDS = 4
PENALTY = 1e-4
CELLS = 32**3
#: Windows that are scored at once.
BATCH = 20_000
#: A sentence ends after a chunk with one of these at its end, closing marks aside.
STOP = re.compile(r"[.!?…][\"'»”)\]]*\Z")
_MARKS = re.compile(r"[\W_]+")
#: Digits that stand for letters they look like.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


def letter_code(c: str) -> int:
    """1 to 26 for Latin letters without their accents, 27 to 29 other letters, 30 digits and the rest; 31 is a beginning."""
    c = LOOKALIKE.get(c, c)
    base = unicodedata.normalize("NFKD", "ss" if c == "ß" else c)[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(base) % 3 if base.isalpha() else 30


_CODES = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _CODES[_i] = letter_code(chr(_i))


def coded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows, each after a 31 and followed by a 0, and where each begins."""
    points = np.frombuffer("\n".join(["", *windows, ""]).encode("utf-32-le"), "<u4")
    small = np.minimum(points, 0x24F)
    codes = np.where(points < 0x250, _CODES[small], 27 + points % 3).astype(np.int64)
    # The line end before a window is its beginning; a 0 is put in after each window.
    ends = np.flatnonzero(points == 10)
    codes[ends] = 31
    out = np.insert(codes[: ends[-1]], ends[1:-1], 0) if len(ends) > 1 else codes[:0]
    return np.append(out, 0) if len(ends) > 1 else out, offsets([len(w) + 2 for w in windows])


def triples(codes: np.ndarray):
    """(start, cell, weight) arrays of all subsequences of three characters, by their two gaps."""
    gap = codes == 0
    clear = [~gap]  # clear[d]: no end within d characters
    for d in range(1, SPAN):
        clear.append(clear[-1][: len(codes) - d] & ~gap[d:])
    for d2 in range(2, SPAN):
        at = np.flatnonzero(clear[d2])
        for d1 in range(1, d2):
            yield at, (codes[at] * 32 + codes[at + d1]) * 32 + codes[at + d2], DECAY ** (d2 + 1)


def _norms(most: int = 512) -> np.ndarray:
    """By length: root of the summed squared weights of all subsequences."""
    out = np.ones(most + 1)
    for n in range(3, most + 1):
        out[n] = np.sqrt(sum((d2 - 1) * (n - d2) * DECAY ** (2 * d2 + 2) for d2 in range(2, SPAN) if n > d2))
    return out


NORM = _norms()


def norms(windows: list[str]) -> np.ndarray:
    return NORM[np.minimum([len(w) + 1 for w in windows], 512)]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel values of all windows of ``a`` with the landmarks ``b``."""
    fb = np.zeros((CELLS, len(b)), np.float32)
    for i, row in enumerate(b):
        fb[:, i] = features([row])[0]
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(a), 500):
        part = a[i : i + 500]
        codes, begin = coded(part)
        total = np.zeros((len(part), len(b)), np.float32)
        for at, cell, weight in triples(codes):
            # Subsequences come in the order of their windows: each window's are a run.
            edge = np.searchsorted(at, begin)
            some = np.flatnonzero(np.diff(edge))
            if len(some):
                total[some] += np.float32(weight) * np.add.reduceat(fb[cell], edge[some], axis=0)
        out[i : i + len(part)] = total / norms(part)[:, None]
    return out


def features(windows: list[str]) -> np.ndarray:
    """Dense normalised subsequence weights, one row a window."""
    codes, begin = coded(windows)
    owner = np.repeat(np.arange(len(windows)), np.diff(begin))
    out = np.zeros((len(windows), CELLS), np.float32)
    for at, cell, weight in triples(codes):
        np.add.at(out, (owner[at], cell), weight)
    return out / norms(windows)[:, None].astype(np.float32)


def window_scores(windows: list[str], table: np.ndarray) -> np.ndarray:
    """The highest score of each window's runs of WINDOW characters under a folded table; 0 without subsequences."""
    if len(windows) > BATCH:
        return np.concatenate([window_scores(windows[i : i + BATCH], table) for i in range(0, len(windows), BATCH)])
    out = np.zeros(len(windows), np.float32)
    if not windows:
        return out
    codes, begin = coded(windows)
    gain = np.zeros(len(codes), np.float32)
    for at, cell, weight in triples(codes):
        gain[at] += np.float32(weight) * table[cell]
    lengths = np.diff(begin) - 1
    # Sums by window, so that a window's score does not depend on the ones beside it.
    short = lengths <= WINDOW + 1
    total = np.add.reduceat(gain, begin[:-1])
    out[short] = total[short] / NORM[lengths[short]]
    for i in np.flatnonzero(~short):
        sums = np.concatenate([[0.0], np.cumsum(gain[begin[i] : begin[i + 1]].astype(np.float64))])
        out[i] = (sums[WINDOW:-1] - sums[: -WINDOW - 1]).max() / NORM[WINDOW]
    return out


def clean(chunk: str) -> str:
    return _MARKS.sub("", chunk.lower())


def joins(names: np.ndarray, size: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of neighbouring chunks, place of the first chunk of each) of consecutive cleaned chunks.

    ``size`` has their lengths, ``stop`` where a sentence ends and ``first`` where a text begins: nothing crosses these."""
    keep = np.flatnonzero(size > 0)
    if len(keep) < len(size):  # chunks of marks alone lie between no others
        ends = np.add.reduceat(stop.astype(np.int64), keep) > 0 if len(keep) else stop[:0]
        begins = np.concatenate([[0], np.cumsum(first)])
        begins = np.diff(begins[np.concatenate([[0], keep + 1])]) > 0
        windows, place = joins(names[keep], size[keep], ends, begins)
        return windows, keep[place]
    n = len(names)
    after = np.ones(n, bool)  # whether the next chunk is of the same sentence
    after[-1:] = False
    after[:-1] &= ~stop[:-1] & ~first[1:]
    two = after[:-1] & (size[:-1] + size[1:] <= WINDOW) & (size[:-1] + size[1:] >= 4)
    at2 = np.flatnonzero(two)
    small = size <= 3
    three = small[:-2] & small[1:-1] & small[2:] & after[:-2] & after[1:-1] if n > 2 else np.zeros(0, bool)
    at3 = np.flatnonzero(three)
    found = [names[at2] + names[at2 + 1], names[at3] + names[at3 + 1] + names[at3 + 2]]
    place = [at2, at3]
    # Runs of four or more chunks of one or two letters.
    tiny = size <= 2
    linked = tiny[:-1] & tiny[1:] & after[:-1]
    edge = np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 3
    runs = np.array(["".join(names[i : j + 1]) for i, j in zip(begin[long], end[long])], object)
    return np.concatenate([*found, runs]), np.concatenate([*place, begin[long]])


def parsed(chunks: list[str]) -> list[np.ndarray]:
    """(cleaned chunks, their lengths, whether a sentence ends with them) of raw chunks."""
    names = np.empty(len(chunks), object)
    names[:] = [clean(c) for c in chunks]
    size = np.fromiter(map(len, names), np.int32, len(chunks))
    return [names, size, np.fromiter((STOP.search(c) is not None for c in chunks), bool, len(chunks))]


def sentences(text: str) -> list[list[str]]:
    """Windows of each sentence."""
    chunks = text.split()
    if not chunks:
        return []
    names, size, stop = parsed(chunks)
    first = np.zeros(len(chunks), bool)
    windows, place = joins(names, size, stop, first)
    number = np.concatenate([[0], np.cumsum(stop)[:-1]])
    out: list[list[str]] = [[] for _ in range(number[-1] + 1)]
    for w, i in zip([*names, *windows], [*number, *number[place]]):
        if w:
            out[i].append(w)
    return [s for s in out if s]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights and bias of a squared-hinge support vector machine, by Newton steps."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    ridge = penalty * weight.sum() * np.eye(n)
    ridge[-1, -1] *= 1e-3
    for _ in range(steps):
        square, side = np.zeros((n, n)), np.zeros(n)
        for i in range(0, len(x), 2000):  # so that no copy of all rows is held
            part = np.hstack([x[i : i + 2000], np.ones((len(x[i : i + 2000]), 1))])
            inside = y[i : i + 2000] * (part @ w) < 1
            xs, c = part[inside], weight[i : i + 2000][inside]
            square += xs.T @ (xs * c[:, None])
            side += xs.T @ (c * y[i : i + 2000][inside])
        new = np.linalg.solve(square + ridge, side)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float
    slope: float
    shift: float

    def lexicon(self) -> Lexicon:
        def compute(chunks):
            names, size, stop = parsed(chunks)
            return [window_scores(list(names), self.table), names, size, stop]

        return Lexicon(compute)

    def margins(self, lexicon: Lexicon, texts: list[str]) -> np.ndarray:
        """The highest window score of each text."""
        lists = [t.split() for t in texts]
        ids = lexicon.lookup(lists)
        starts = offsets([len(x) for x in lists])
        out = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            score, names, size, stop = lexicon.rows
            out[full] = np.maximum.reduceat(score[ids], starts[full])
            first = np.zeros(len(ids), bool)
            first[starts[full]] = True
            windows, place = joins(names[ids], size[ids], stop[ids], first)
            distinct = {w: i for i, w in enumerate(dict.fromkeys(windows))}
            if distinct:
                best = window_scores(list(distinct), self.table)[np.fromiter(map(distinct.__getitem__, windows), np.int64, len(windows))]
                np.maximum.at(out, np.searchsorted(starts, place, side="right") - 1, best)
        return out + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def changed(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word of four letters or more with one or two letters put in."""
    out = []
    for w in words:
        for _ in range(int(rng.integers(1, 3))):
            i = int(rng.integers(1, len(w))) if len(w) > 1 else 1
            w = w[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + w[i:]
        out.append(w)
    return out


def learn(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    """Fit on (text, label) rows."""
    label = np.array([int(y) for _, y in rows], np.int64)
    n1 = int(label.sum())
    n0 = len(label) - n1
    if not n1 or not n0:
        return None
    # Windows by number; sentences are runs of numbers, so that the driver holds each window's text once.
    place: dict[str, int] = {}
    flat, cuts, owner = array("i"), [0], []
    for d, (text, _) in enumerate(rows):
        for sentence in sentences(text):
            flat.extend(place.setdefault(w, len(place)) for w in sentence)
            cuts.append(len(flat))
            owner.append(d)
    vocabulary = list(place)
    idx, starts, owner = np.array(flat, np.int64), np.array(cuts[:-1], np.int64), np.array(owner, np.int64)

    def in_texts(number: np.ndarray, count: int) -> list[np.ndarray]:
        """In how many toxic and in how many clean texts each number is."""
        both = np.unique(np.repeat(owner, np.diff(cuts)) * (count + 1) + number[idx])
        document, name = both // (count + 1), both % (count + 1)
        return [np.bincount(name[label[document] == y], minlength=count + 1) for y in (1, 0)]

    in_toxic, in_other = (x[:-1] for x in in_texts(np.arange(len(vocabulary)), len(vocabulary)))
    stem_number: dict[str, int] = {}
    stem = np.array([stem_number.setdefault(w[:5], len(stem_number)) if len(w) > 5 else -1 for w in vocabulary], np.int64)
    stem[stem < 0] = len(stem_number)  # a window without stem counts for none
    stem_toxic, stem_other = in_texts(stem, len(stem_number))

    def odds(a, b):
        """Log odds of toxic texts, less about two standard errors."""
        return np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 2.0 / np.sqrt(a + 0.5)

    stems = np.where(stem < len(stem_number), odds(stem_toxic, stem_other)[stem], -9.0)
    start = np.maximum(odds(in_toxic, in_other), stems)
    # A window that more clean than toxic texts have is no witness.
    common = (in_other > in_toxic) | (np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) < 3)
    start[common] = -9.0
    rng = np.random.default_rng(4)
    # At first a witness must be in so many toxic texts, and in no clean one or few, that by chance less than one
    # window of the vocabulary would be.
    least = int(np.ceil(np.log(2 * len(vocabulary) + 2) / np.log((n1 + n0) / n1)))
    scores, floor = start, min(float(odds(least, 0)) - 1e-9, float(start.max(initial=-9.0)) - 1e-9)
    by_name = np.array(sorted(range(len(vocabulary)), key=vocabulary.__getitem__))
    clean_words = by_name[in_other[by_name] > 0]
    frequent = clean_words[np.argsort(-in_other[clean_words], kind="stable")][:2000]
    table, bias = np.zeros(CELLS, np.float32), 0.0
    mined: list[int] = []
    for turn in range(rounds):
        value = np.where(common, -9.0, scores)
        # The highest window of each sentence.
        top = highest(value[idx], starts, idx)
        strength = np.where(label[owner] == 1, value[top], -np.inf)
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, owner, strength)
        # All of a toxic text's sentences that stand out as clearly as its best one bear witness; none where none does.
        bear = (strength > floor) & (strength > best[owner] - (1.5 if turn == 0 else 0.5))
        witness = np.bincount(top[bear], minlength=len(vocabulary))
        if not witness.any():
            return None
        # Clean sentences stand for their highest window; the highest of all rounds, the most frequent ones, and some by chance.
        clean = highest(scores[idx], starts, idx)[label[owner] == 0]
        hard = np.unique(clean)
        mined = list(dict.fromkeys([*mined, *hard[np.argsort(-scores[hard], kind="stable")][:2000]]))
        easy = clean_words[rng.permutation(len(clean_words))[:3000]]
        negative = [i for i in dict.fromkeys([*mined, *frequent, *easy]) if not witness[i]]
        # Witnesses that clean texts have at least as often are no insults.
        positive = [i for i in by_name[np.argsort(-witness[by_name], kind="stable")] if witness[i] and in_other[i] <= in_toxic[i]][:4000]
        words = [[vocabulary[i] for i in part] for part in (positive, negative)]
        if not words[0]:
            return None
        half = landmarks // 2
        marks = words[0][:half] + words[1][: half // 2] + words[1][-(half - half // 2) :]
        marks = list(dict.fromkeys(marks))
        mm = kernel(marks, marks)
        values, vectors = np.linalg.eigh((mm + mm.T) / 2 + 1e-6 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        # With letters put in: the most frequent witnesses, and clean windows of both kinds.
        some = [w for w in words[0][:400] if len(w) >= 4]
        extra = [changed(some + some, rng), changed([w for w in words[1][:1500] + words[1][-1500:] if len(w) >= 4], rng)]
        heft = [witness[positive].astype(float) ** 0.5, np.maximum(1, in_other[negative]) ** 0.5]
        heft_extra = [np.array([witness[place[w]] for w in some + some], float) ** 0.5 * 0.5, np.ones(len(extra[1]))]
        x = kernel([*words[0], *extra[0], *words[1], *extra[1]], marks) @ root.astype(np.float32)
        ups, downs = (np.concatenate([heft[k], heft_extra[k]]) for k in (0, 1))
        y = np.concatenate([np.ones(len(ups)), -np.ones(len(downs))])
        w = fit_svm(x, y, np.concatenate([ups * (downs.sum() / ups.sum()), downs]))
        table = np.zeros(CELLS, np.float32)
        for mark, share in zip(marks, root @ w[:-1]):
            table += np.float32(share) * features([mark])[0]
        bias = float(w[-1])
        scores, floor = window_scores(vocabulary, table) + bias, 0.0
    # A logistic curve over the texts' scores, with its middle where the fewest texts are on the wrong side.
    m = np.full(len(rows), bias)
    if len(idx):
        inner = np.full(len(rows), -np.inf)
        np.maximum.at(inner, owner, np.maximum.reduceat(scores[idx], starts))
        m = np.where(np.isinf(inner), bias, inner)
    slope, _ = platt(m, label)
    return Model(table, bias, slope, -slope * best_cut(m, label))


def highest(value: np.ndarray, starts: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Of each run (beginning at ``starts``) the first item of the highest value."""
    top = np.maximum.reduceat(value, starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(value))))
    hit = np.flatnonzero(value == top[run])
    _, one = np.unique(run[hit], return_index=True)
    return idx[hit[one]]


def best_cut(m: np.ndarray, y: np.ndarray) -> float:
    """The margin of fewest errors on both sides; in the middle of its gap, the widest of equal ones."""
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y)])[-1] - np.concatenate([[0], np.cumsum(1 - y)])
    left, right = np.concatenate([[m[0] - 1], m]), np.concatenate([m, [m[-1] + 1]])
    gap = right - left
    best = int(np.lexsort((-gap, errors + len(m) * (gap <= 0)))[0])
    return float((left[best] + right[best]) / 2)


def platt(m: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones(len(m))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-3, 1e-6])
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + np.array([1e-3, 0]) * w), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, held: Column) -> Model | None:
    """Fit on labelled rows that are not held out, up to the bounds above, chosen by a hash of doc_id."""
    prepared(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, MAX_TOXIC).union(pick(0, MAX_CLEAN))
    texts = as_documents(docs, "doc_id", "text").where(F.length("text").between(1, MAX_CHARS))
    # Bounded: MAX_TOXIC + MAX_CLEAN ids, and one text of at most MAX_CHARS of each to the driver, however many rows have
    # the id; the text is chosen by its hash, before the shuffle.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one, F.first("toxic").alias("toxic")).collect()
    rows = sorted((r.doc_id, r.text, r.toxic) for r in rows)
    return learn([(t, y) for _, t, y in rows])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from rows that are not held out."""
    held = held_out(0, 5)
    model = train(docs, labels, held)
    shared = prepared(docs.sparkSession).sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(texts):
        m = shared.value
        out = np.zeros(len(texts))
        if m:
            lexicon = worker_state(key, m.lexicon)
            texts = [t or "" for t in texts]
            for s in text_slices(texts):
                out[s] = m.probability(m.margins(lexicon, texts[s]))
        return (out,)

    found = append(as_documents(docs, "doc_id", "text"), "_score double", run, "text")
    return found.select(
        "doc_id",
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )

