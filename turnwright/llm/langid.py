"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of each lower-cased white-space chunk with a space before and after it.
Document frequencies cover every document that may be learned from; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded, documented sample of those
rows, and a temperature is fitted on a part of the sample that the weights did not see. The languages are those of the
sample, which has about as many rows of each: all of them up to the sample's size. Every fifth row of a language goes to
the temperature, so that a language of few rows keeps them for its weights. With more than MAX_WEIGHTS / WIDTH languages
several cells share a weight, so that the model's size is bounded.

Cases: a null text, or one without a letter (number signs such as "²" or "Ⅷ" are none), is ``und`` with score 0. Where
nothing can be learned (no language given) every text is ``und``. Repeated rows get equal predictions, and count once
in the sample."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.llm.common import Lexicon, append, as_documents, boxed, broadcast_if_small, forget, held_out, offsets, prepared, summed_vector, text_slices, worker_state

WIDTH = 1 << 15
ORDERS = (2, 3, 4)
#: Most rows that the classifier is fitted on, as many of each language as there are.
MAX_TRAIN_ROWS = 3000
#: Most weights (cells times languages) of a model; and most numbers in a worker's store of chunks.
MAX_WEIGHTS = 1 << 24
MAX_STORE = 1 << 23
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; the pattern alone would take number signs for letters."""
    found = _WORD.search(text)
    return found is not None and (found[0].isalpha() or any(c.isalpha() for c in text[found.end() :]))


def gram_cells(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, chunk number) of every n-gram of the chunks."""
    flat = np.frombuffer((" " + " ".join(chunks).lower() + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    space = flat == 32
    owner = np.cumsum(space) - 1
    cells, owners = [], []
    key = flat.copy()
    inner = np.zeros(len(flat), bool)
    for n in range(2, max(ORDERS) + 1):
        key = key[: len(flat) - n + 1] * np.uint64(0x9E3779B1) + flat[n - 1 :]
        if n > 2:
            inner = inner[: len(key)] | space[n - 2 : n - 2 + len(key)]
        else:
            inner = inner[: len(key)]
        if n in ORDERS:
            # No space inside; a gram that starts at the last space, or is two spaces, has no chunk.
            good = ~inner & (owner[: len(key)] < len(chunks))
            k = key[good]
            k = k ^ (k >> np.uint64(29))
            cells.append(((k * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64))
            owners.append(owner[: len(key)][good])
    return np.concatenate(cells), np.concatenate(owners)


def text_cells(text: str) -> np.ndarray:
    chunks = text.split()
    return gram_cells(chunks)[0] if chunks else np.zeros(0, np.int64)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    width: int = WIDTH,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression by FTRL-proximal steps."""
    z, n = np.zeros((width, classes)), np.zeros((width, classes))
    bias = np.zeros(classes)
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for epoch in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            w = weights(z[i], n[i])
            logit = x @ w + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[r]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias -= 0.05 / (1 + epoch) * p
    return weights(z, n), bias


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a grid refined twice."""

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]))

    if not len(labels):
        return 1.0
    low, high = -2.0, 2.0
    for _ in range(3):
        grid = np.linspace(low, high, 21)
        best = grid[int(np.argmin([loss(10.0**g) for g in grid]))]
        low, high = best - (high - low) / 10, best + (high - low) / 10
    return float(np.clip(10.0**best, 0.5, 20.0))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # width x languages: idf times weight; the weight alone where cells share it
    bias: np.ndarray
    temperature: float
    shared_idf: np.ndarray | None = None  # the cells' idf where they share weights

    def lexicon(self) -> Lexicon:
        def compute(chunks):
            cells, owner = gram_cells(chunks)
            n = len(chunks)
            at, factor = cells, 1.0
            if self.shared_idf is not None:
                at, factor = cells & (len(self.table) - 1), self.shared_idf[cells]
            logit = np.stack(
                [np.bincount(owner, self.table[at, c] * factor, minlength=n) for c in range(len(self.languages))], 1
            )
            return [logit.astype(np.float32), np.bincount(owner, minlength=n).astype(np.int32)]

        return Lexicon(compute, limit=max(2000, min(120_000, MAX_STORE // len(self.languages))))

    def probabilities(self, lexicon: Lexicon, texts: list[str]) -> np.ndarray:
        """One row a text; a text without n-grams gets equal shares."""
        lists = [t.split() for t in texts]
        ids = lexicon.lookup(lists)
        out = np.full((len(texts), len(self.languages)), 1.0 / len(self.languages))
        starts = offsets([len(x) for x in lists])
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            logit, grams = lexicon.rows
            total = np.maximum(np.add.reduceat(grams[ids], starts[full]), 1)
            s = np.add.reduceat(logit[ids].astype(np.float64), starts[full], axis=0) / total[:, None] * SCALE + self.bias
            s /= self.temperature
            s = np.exp(s - s.max(1, keepdims=True))
            out[full] = s / s.sum(1, keepdims=True)
        return out


#: Term frequencies are shares of a text's n-grams, times this.
SCALE = 20.0


def fifths(labels: np.ndarray) -> np.ndarray:
    """Which rows are a fifth, tenth and so on of their label."""
    order = np.argsort(labels, kind="stable")
    starts = offsets(np.bincount(labels))[:-1]
    out = np.zeros(len(labels), bool)
    out[order] = (np.arange(len(labels)) - starts[labels[order]]) % 5 == 4
    return out


def train(docs: DataFrame, held: Column, max_rows: int = MAX_TRAIN_ROWS, max_weights: int = MAX_WEIGHTS) -> Model | None:
    """Fit on rows that are not held out and have a language; None if there are none."""
    prepared(docs.sparkSession)
    known = as_documents(docs, "doc_id", "text", "lang").where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("k", F.xxhash64("doc_id", "text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total, languages = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not languages:
        return None
    df = summed_vector(known.select("text"), document_frequencies, WIDTH)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    # Distinct rows in the order of a hash, each language's hash scaled by its count: near equal numbers of each.
    order = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 40)).cast("double") * F.col("n")
    distinct = known.groupBy("lang", "k").agg(F.lit(1).alias("_")).join(broadcast_if_small(sizes, languages), "lang")
    chosen = distinct.select("lang", "k", order.alias("o")).orderBy("o", "k", "lang").limit(max_rows).select("lang", "k")

    def features(batches):
        forget()
        for pdf in batches:
            out = []
            for k, text, lang in zip(pdf["k"], pdf["text"], pdf["lang"]):
                counts = np.bincount(text_cells(text), minlength=WIDTH)
                at = np.flatnonzero(counts)
                x = (counts[at] / max(1, counts.sum())).astype("<f4")
                out.append((k, lang, at.astype("<u2").tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["k", "lang", "at", "x"])

    # At most max_rows keys, and one text of each: however often a row is repeated, one of it goes on.
    texts = known.join(F.broadcast(chosen), ["lang", "k"]).groupBy("lang", "k").agg(F.first("text").alias("text"))
    rows = texts.select("k", "text", "lang").mapInPandas(features, "k long, lang string, at binary, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.k, r.lang))
    names = tuple(sorted({r.lang for r in rows}))
    number = {name: i for i, name in enumerate(names)}
    width = WIDTH
    while width > 1 and width * len(names) > max_weights:
        width //= 2
    data = []
    for r in rows:
        at = np.frombuffer(bytes(r.at), "<u2").astype(np.int64)
        x = np.frombuffer(bytes(r.x), "<f4").astype(np.float64) * idf[at] * SCALE
        if width < WIDTH:
            cells, place = np.unique(at & (width - 1), return_inverse=True)
            at, x = cells, np.bincount(place, x, minlength=len(cells))
        data.append((at, x))
    y = np.array([number[r.lang] for r in rows])
    tune = fifths(y)
    fit = np.flatnonzero(~tune)
    w, bias = fit_ftrl([data[i] for i in fit], y[fit], len(names), width)
    logits = np.array([data[i][1] @ w[data[i][0]] + bias for i in np.flatnonzero(tune)]).reshape(-1, len(names))
    temperature = fit_temperature(logits, y[tune])
    if width < WIDTH:
        return Model(names, w.astype(np.float32), bias, temperature, idf.astype(np.float32))
    return Model(names, (idf[:, None] * w).astype(np.float32), bias, temperature)


def document_frequencies(batches) -> np.ndarray:
    """Document frequencies of the n-gram cells, each chunk's cells worked out once."""
    total = np.zeros(WIDTH, np.int64)

    def compute(chunks):
        cells, owner = gram_cells(chunks)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(chunks))
        found = np.empty(len(chunks), object)
        for i, part in enumerate(np.split(cells[order].astype(np.uint16), np.cumsum(counts)[:-1])):
            found[i] = part
        return [found]

    lexicon = Lexicon(compute, limit=80_000)
    for pdf in batches:
        texts = [t or "" for t in pdf["text"]]
        for part in text_slices(texts):
            lists = [list(set(t.split())) for t in texts[part]]
            ids = lexicon.lookup(lists)
            cells = lexicon.rows[0] if lexicon.rows else None
            at = 0
            for x in lists:
                if x:
                    seen = np.zeros(WIDTH, bool)
                    seen[np.concatenate(list(cells[ids[at : at + len(x)]]))] = True
                    total += seen
                at += len(x)
    return total


def identify(frame: DataFrame, model: Model | None) -> DataFrame:
    """``frame`` with _lang and _score in place of its column text, which need not come back from Python."""
    shared = prepared(frame.sparkSession).sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def predict(texts):
        m = shared.value
        texts = [t if t and has_letter(t) else "" for t in texts]
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if m:
            lexicon = worker_state(key, m.lexicon)
            for part in text_slices(texts):
                p = m.probabilities(lexicon, texts[part])
                good = np.array([bool(t) for t in texts[part]])
                best = p.argmax(1)
                lang[part] = np.where(good, np.array(m.languages, object)[best], "und")
                score[part] = np.where(good, p[np.arange(len(p)), best], 0.0)
        return lang, score

    return append(frame, "_lang string, _score double", predict, "text", drop=True)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows that are not held out."""
    held = held_out(2, 4)
    model = train(docs, held)
    found = identify(as_documents(docs, "doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def filter_documents(docs: DataFrame, floor: float = 0.5) -> DataFrame:
    """Rows whose language is recognised with a score of at least ``floor``; their own columns."""
    found = identify(boxed(docs, "text"), train(docs, F.lit(False)))
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= floor)).select("_row.*")
