"""Hooks for models: one model a Python worker, calls that are repeated, and deterministic defaults.

A factory makes the model (a client, a network) in the worker that uses it, once for all its tasks.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

DIM = 256
_TERM = re.compile(r"[a-z0-9]+")
_made: dict[tuple[str, str], object] = {}


def once(factory: Callable):
    """The model of this worker."""
    name = (factory.__module__, factory.__qualname__)
    if name not in _made:
        _made[name] = factory()
    return _made[name]


def checked_key(key: str | None, placeholder: str = "") -> str:
    """For factories of clients: a missing key, or the placeholder of a template, is an error at once."""
    if not key or key == placeholder:
        raise RuntimeError("the key of the model's service is missing, or still the placeholder")
    return key


def repeated(call: Callable, attempts: int, pause: float):
    """call(), repeated after growing pauses (pause, 2 * pause, ...); the last error goes on."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            time.sleep(pause * n)


class HashedTerms:
    """The default embedding: numbers of the terms by hash, of length one. The same for documents and questions."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            at = [zlib.crc32(t.encode()) % DIM for t in _TERM.findall((text or "").lower())]
            v = np.bincount(at, minlength=DIM).astype(np.float32) if at else np.zeros(DIM, np.float32)
            out.append(v / max(1.0, float(np.sqrt((v * v).sum()))))
        return out


def embed(text: Column, factory: Callable = HashedTerms, attempts: int = 4, pause: float = 60.0) -> Column:
    """Vectors of texts, by Arrow batches; a failing batch is repeated."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(repeated(lambda: once(factory)(s.tolist()), attempts, pause)))

    return vectors(text)


def pair_scorer(factory: Callable) -> Callable[[Column, Column], Column]:
    """A scorer for rerank from a model that takes lists of questions and texts."""

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(once(factory)(question.tolist(), text.tolist()), dtype=float)

    return score


class FirstSentence:
    """The default generator of attempts(): the first sentence of the context that shares a term with the question."""

    def __call__(self, question: str, context: str) -> str:
        asked = set(_TERM.findall((question or "").lower()))
        told = re.split(r"(?<=[.!?])\s+", context or "")
        return next((s.strip() for s in told if asked & set(_TERM.findall(s.lower()))), T.REFUSAL)


class Slots:
    """Times at which one of workers may call, so that all together call at most rpm times a minute.

    Worker i has the slots start + (i + n * workers) * 60 / rpm, n = 0, 1, ...: no slot is another worker's,
    whenever a worker begins. Repeated calls take slots too.
    """

    def __init__(self, worker: int, workers: int, rpm: float, start: float, clock=time.time, sleep=time.sleep):
        self.step, self.first, self.n, self.clock, self.sleep = workers * 60.0 / rpm, start + worker * 60.0 / rpm, -1, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        self.n = max(self.n + 1, int(-(-(now - self.first) // self.step)))
        self.sleep(max(0.0, self.first + self.n * self.step - now))


def attempts(work: DataFrame, factory: Callable = FirstSentence, tries: int = 5, pause: float = 30.0, rpm: float | None = None, workers: int = 4) -> DataFrame:
    """work (with question and context) with answer, error and generation_ms.

    A call that fails is repeated tries times; then its row has the error instead of an answer, and
    the others go on. With rpm, workers tasks make at most so many calls a minute together. An empty
    context is refused without a call.
    """
    schema, start = StructType(list(work.schema.fields)).add("answer", "string").add("error", "string").add("generation_ms", "double"), time.time()

    def run(batches):
        context = TaskContext.get()
        slots = Slots(context.partitionId(), workers, rpm, start) if rpm else None
        for pdf in batches:
            made = [answered(slots, q, c) for q, c in zip(pdf["question"], pdf["context"])]
            yield pdf.assign(**{c: pd.Series([m[i] for m in made], index=pdf.index, dtype=object if i < 2 else float) for i, c in enumerate(("answer", "error", "generation_ms"))})

    def answered(slots, question, context):
        def call():
            if slots:
                slots.wait()
            return once(factory)(question, context)

        began = time.perf_counter()
        if not context:
            return T.REFUSAL, None, (time.perf_counter() - began) * 1000
        try:
            answer, error = repeated(call, tries, pause).strip(), None
        except Exception as e:  # a service may raise anything; the row says what
            answer, error = None, f"{type(e).__name__}: {e}"[:500]
        return answer, error, (time.perf_counter() - began) * 1000

    return (work.repartition(workers) if rpm else work).mapInPandas(run, schema)
