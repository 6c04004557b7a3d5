"""Language ID by multilingual mixture inference.

Training counts the letter trigrams of labelled texts by language. A document is then a mixture of
languages: expectation-maximisation estimates the proportions that make its trigrams likeliest, and
a penalised likelihood (one parameter a language) says how many languages it has. The prediction is
the language with the largest proportion, the score is that proportion.

The model is fitted on at most about MAX_TRAIN labelled rows, chosen by a hash of id and text (copies of one text do not stand or fall together), a bound
that does not grow with the table; predictions are made for every row and read whole texts. What
is sent to the executors has a fixed size: 2 MB at most for 8 languages of 65,536 trigram buckets.

Defined cases: a text that is null or has no letter is "und" with score 0; so is every text if there
is no labelled row. Rows that repeat, or tie between languages, get the first language in code-point
order. Null labels and ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

BUCKETS, MAX_TRAIN, PENALTY = 1 << 16, 20_000, 3.0
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[codes]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the letter trigrams, words framed by a blank; all other characters are blanks."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.concatenate(([0], np.where(_is_letter(codes), codes, 0), [0])).astype(np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    h = a[inner] * np.uint32(0x9E3779B1) ^ b[inner] * np.uint32(0x85EBCA77) ^ c[inner] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    return np.unique(h, return_counts=True)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class LanguageModel:
    """languages in code-point order and the probability of each trigram bucket in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts.astype(np.float64) + 0.5
        self.probs = (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if languages else counts

    def proportions(self, p: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
        """Expectation-maximisation over the languages (rows of p): (proportions, log-likelihood)."""
        w, total = np.full(len(p), 1 / len(p)), n.sum()
        for _ in range(rounds):
            mixed = w @ p
            new = w * (p @ (n / mixed)) / total
            done = np.abs(new - w).max() < 1e-3
            w = new
            if done:
                break
        return w, float(n @ np.log(w @ p))

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, n = trigrams(text)
        if not len(buckets) or not self.languages:
            return "und", 0.0
        p, n = self.probs[:, buckets].astype(np.float64), n.astype(np.float64)
        alone = np.log(p) @ n
        order = np.argsort(-alone, kind="stable")
        best, share, like = [int(order[0])], np.ones(1), float(alone[order[0]])
        if len(self.languages) > 1:
            full, top = self.proportions(p, n)
            price = PENALTY * math.log(n.sum() + 1)
            if top - like > price:  # else no set can be better
                ranked = np.argsort(-full, kind="stable")
                for k in range(2, len(ranked) + 1):
                    chosen = np.sort(ranked[:k])
                    w, more = self.proportions(p[chosen], n)
                    if more - like <= price:
                        break
                    best, share, like = list(chosen), w, more
        i = int(np.argmax(share))
        return self.languages[best[i]], min(1.0, float(share[i]))


def train(labelled: DataFrame, text="text", lang="lang", max_rows: int = MAX_TRAIN, key="doc_id") -> LanguageModel:
    """Fit on rows with a non-null label. Counts are made in the tasks and summed by Spark; what
    comes to the driver has a row a language and bucket at most."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where("lang is not null and text is not null")
    n = labelled.where(F.col(lang).isNotNull()).count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for words, name in zip(pdf["text"], pdf["lang"]):
                buckets, k = trigrams(words)
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, dtype=np.int64)
                sums[name][buckets] += k
        for name, table in sums.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": table[at]})

    got = rows.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = got.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").collect()
    table = np.zeros((len(got), BUCKETS), dtype=np.int64)
    for i, r in enumerate(got):
        pairs = np.array(r["c"], dtype=np.int64)
        table[i, pairs[:, 0]] = pairs[:, 1]
    return LanguageModel([r["lang"] for r in got], table)


def predict_column(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text; the model's size is fixed by the languages and BUCKETS."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(s: pd.Series) -> pd.DataFrame:
        made = [shared.value.predict(x) for x in s]
        return pd.DataFrame({"lang_pred": [x[0] for x in made], "score": [x[1] for x in made]})

    return predict(text)


def identify(docs: DataFrame, key="doc_id", text="text", lang="lang") -> DataFrame:
    """docs' rows as struct row, with held_out, lang_pred and score."""
    model = train(docs.where(~held_out(F.col(key))), text, lang, key=key)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), held_out(docs[key]).alias("held_out"), predict_column(docs.sparkSession, model, docs[text]).alias("p"))
    return held.select("row", "held_out", "p.lang_pred", "p.score")


def keep_known_languages(docs: DataFrame, min_score: float = 0.5, **columns) -> DataFrame:
    """docs whose language is known and makes up at least min_score of the text."""
    return identify(docs, **columns).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("row.doc_id", "held_out", "lang_pred", "score")
