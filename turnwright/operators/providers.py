"""External models as providers: plain functions called in batches on the executors, with offline defaults.

A provider takes a list of request dicts and returns a list of reply texts (or None). It is built once in each
worker by a factory, so that clients and models need not be pickled. A failing call gives None, never a failed job."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, as_completed, wait

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwright.sources.io import write_parts

Provider = Callable[[list[dict]], list[str | None]]

#: Answered rows go back to Spark so many at a time, or what a second has brought: a batch costs as much as many rows.
GATHER = 1000

#: Scorers and reward managers by name: functions of a DataFrame, key columns and options that return a DataFrame.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Offer a scorer under a name; a name is taken once."""

    def add(f):
        if REGISTRY.setdefault(name, f) is not f:
            raise ValueError(f"the scorer {name!r} is registered already")
        return f

    return add


def scorer(name: str) -> Callable[..., DataFrame]:
    """The scorer of a name; raises for an unknown one."""
    from turnwright.operators import reward  # noqa: F401 - registers its scorers

    if name not in REGISTRY:
        raise ValueError(f"no scorer {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def no_provider() -> Provider:
    """Answers nothing."""
    return lambda requests: [None] * len(requests)


def rule_labeller() -> Provider:
    """An offline labeller: one annotation from markers in the prompt's last line."""

    def one(request: dict) -> str:
        text = request["prompt"].rsplit("\n", 1)[-1].lower()
        label = "D" if "sorry" in text else "C" if "?" in text else "A"
        return json.dumps({"annotations": [{"turn_idx": 0, "gt_action": label}]})

    return lambda requests: [one(r) for r in requests]


def calls(df: DataFrame, prompt: str, factory: Callable[[], Provider] = no_provider, column: str = "reply", workers: int = 8, batch: int = 32) -> DataFrame:
    """Add each row's reply, in the order in which the calls end.

    A pool of ``workers`` threads asks for ``batch`` rows at once. At most twice as many requests as workers are
    under way, over the whole partition and not by Arrow batch: a slow request holds up no others, and a task holds no
    more rows than these and the GATHER rows that go back to Spark together. Other columns pass as Arrow data."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.StringType())])
    at, kind, names = df.columns.index(prompt), to_arrow_type(T.StringType()), schema.names

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        provider = factory()

        def ask(rows: pa.RecordBatch) -> pa.RecordBatch:
            requests = [{"prompt": p} for p in rows.column(at).to_pylist()]
            try:
                replies = provider(requests)
            except Exception:  # noqa: BLE001 - one failed request must not lose the rows
                replies = [None] * len(requests)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(replies, type=kind, from_pandas=True)], names=names)

        def together(answered: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: list[pa.RecordBatch] = []
            began = time.monotonic()
            for rows in answered:
                ready.append(rows)
                if sum(r.num_rows for r in ready) >= GATHER or time.monotonic() > began + 1:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, began = [], time.monotonic()
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

        def answered() -> Iterator[pa.RecordBatch]:
            slices = (b.slice(i, batch) for b in parts for i in range(0, b.num_rows, batch))
            with ThreadPoolExecutor(workers) as pool:
                flight: set[Future] = set()
                for rows in slices:
                    flight.add(pool.submit(ask, rows))
                    if len(flight) >= 2 * workers:
                        done, flight = wait(flight, return_when=FIRST_COMPLETED)
                        yield from (f.result() for f in done)
                yield from (f.result() for f in as_completed(flight))

        yield from together(answered())

    return df.mapInArrow(run, schema)


def saved_calls(df: DataFrame, key: str, prompt: str, path: str, factory: Callable[[], Provider] = no_provider, every: int = 100_000, column: str = "reply", **options) -> DataFrame:
    """``calls`` whose replies are saved below ``path`` after about ``every`` rows each, so that a new start asks for the rest only.

    Rows whose key has a saved reply are not asked about; those without a reply are, again. They are written once, a
    folder a part, and a part's replies are saved when all of it is done. ``df`` may have repeated keys: they share a reply. The result is
    ``df`` with the saved replies, null where there is none."""
    spark = df.sparkSession

    def saved() -> DataFrame:
        try:
            return spark.read.schema(f"{key} {dict(df.dtypes)[key]}, {column} string").parquet(f"{path}/replies/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return df.select(key, F.lit(None).cast("string").alias(column)).where("false")

    asked = df.select(key, prompt).where(F.col(key).isNotNull()).dropDuplicates([key])
    open_ = asked.join(saved(), key, "left_anti")
    count = open_.count()
    if count:
        run = f"{path}/pending-{uuid.uuid4().hex}"
        parts = -(-count // every)
        rows = write_parts(open_, F.pmod(F.xxhash64(key), F.lit(parts)), run)
        for number in range(parts):
            mine = calls(rows.where(F.col("part") == number).drop("part"), prompt, factory, column, **options)
            mine.where(F.col(column).isNotNull()).select(key, column).write.parquet(f"{path}/replies/{uuid.uuid4().hex}")
    return df.join(saved().groupBy(key).agg(F.min(column).alias(column)), key, "left")


def judged(df: DataFrame, known: str, prompt: str, factory: Callable[[], Provider] = no_provider) -> DataFrame:
    """Rows whose ``known`` column is null are asked about; two branches, so that no call is made for the others."""
    rest = calls(df.where(F.col(known).isNull()), prompt, factory)
    return df.where(F.col(known).isNotNull()).withColumn("reply", F.lit(None).cast("string")).unionByName(rest)


def rule_judge() -> Provider:
    """An offline judge of turns: an apology is a refusal, a question mark a request; else an empty reply."""

    def one(request: dict) -> str:
        text = (request["prompt"] or "").strip()
        label = "D" if "sorry" in text.lower() else "C" if "?" in text else None
        name = {"D": "cannot_answer", "C": "request_for_info"}.get(label)
        return json.dumps({"pred_label": label, "pred_action": name, "pred_answer": text} if label else {})

    return lambda requests: [one(r) for r in requests]


def length_scorer() -> Provider:
    """An offline scorer: negative log-likelihoods from word lengths, as JSON."""
    return lambda requests: [json.dumps([-len(w) / 10 for w in r["prompt"].split()]) for r in requests]


def token_ranges(text: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every decoded token in the text, looked for from the end of the one before.

    A token that is not found (half a character, say) is taken to stand where the search is."""
    at, first, end = 0, [], []
    for piece in pieces:
        found = text.find(piece, at) if piece else at
        at = max(found, at) if found >= 0 else at
        first.append(at)
        at += len(piece)
        end.append(at)
    return np.array(first, np.int64), np.array(end, np.int64)


def sentence_perplexities(df: DataFrame, key: str, text: str, pieces: str, nlls: str) -> DataFrame:
    """(key, sentence, ppl, nll, token_count) of each sentence of ``text`` that a token overlaps.

    ``pieces`` are the texts of its tokens and ``nlls`` their negative log-likelihoods; the shorter list counts. A
    token that runs over the end of a sentence belongs to both. Sentences run from the end of the one before, white space
    included, and are numbered from 0 without empty ones."""
    from turnwright.functions.text import raw_sentences

    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(text).alias("_t"), F.col(pieces).alias("_p"), F.col(nlls).alias("_n"), raw_sentences(F.col(text)).alias("_s"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, t, p, n, s in zip(*[pdf[c] for c in (key, "_t", "_p", "_n", "_s")]):
                if p is None or n is None or not t:
                    continue
                use = min(len(p), len(n))
                first, end = token_ranges(t, list(p[:use]))
                upto = np.concatenate([[0.0], np.cumsum(np.asarray(n[:use], float))])
                begin = 0
                number = 0
                for raw in s:
                    stop = begin + len(raw["raw"])
                    low, high = np.searchsorted(end, begin, "right"), np.searchsorted(first, stop, "left")
                    if raw["body"]:
                        if high > low:
                            nll = float(upto[high] - upto[low]) / int(high - low)
                            out.append((k, number, float(np.exp(nll)), nll, int(high - low)))
                        number += 1
                    begin = stop
            yield pd.DataFrame(out, columns=[key, "sentence", "ppl", "nll", "token_count"])

    return rows.mapInPandas(run, f"{key} {kind}, sentence int, ppl double, nll double, token_count long")
