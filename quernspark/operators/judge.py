"""Judging runs: the judge's input, its verdicts as rows, scores as aggregates over them, and scores of changed golds.

The judge is a hook, a function of Columns. The default judges by terms: a sentence holds if at least
half of its distinct terms are in the contexts; a context is relevant if it has at least half of the
reference's. That measures nothing a person would call faithful; it is the same everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import text as T
from ..sources.tables import patch, read_or_empty
from . import evaluate
from .evaluate import METRICS, REF_DEPENDENT, golds

LEAST = 0.5
RUN_KEYS = ("mode", "id", "gold_idx")
KEYS = (*RUN_KEYS, "metric", "input")
VERDICT = "mode string, id string, gold_idx int, metric string, input long, position int, verdict double"


def judge_input(runs: DataFrame, examples: DataFrame, every: bool = True) -> DataFrame:
    """A row for each answerable run and accepted gold. The reference is the example's, not the run's.

    Unless every gold is wanted, golds of an example with the same reference are one, the first: a judge
    would see the same texts again, and of equal scores the best is any. Many files may hold one passage.
    """
    gold = golds(examples).select("id", "gold_idx", "reference")
    if not every:
        gold = gold.groupBy("id", "reference").agg(F.min("gold_idx").alias("gold_idx"))
    rows = runs.select("mode", "id", "query_type", F.col("question").alias("user_input"), F.col("answer").alias("response"), F.col("contexts").alias("retrieved_contexts"))
    return rows.where("query_type <> 'unanswerable'").join(gold, "id")


def _terms(text: Column) -> Column:
    return F.array_distinct(T.tokenize(text))


def _share(part: Column, whole: Column) -> Column:
    """The share of part's terms (an array) that are in whole; null without any."""
    return F.try_divide(F.size(F.array_intersect(part, whole)), F.size(part))


def _holds(parts: Column, whole: Column) -> Column:
    """1 for each sentence that holds, 0 for each other."""
    return F.transform(parts, lambda s: F.coalesce((_share(_terms(s), whole) >= LEAST).cast("double"), F.lit(0.0)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def by_terms(question: Column, response: Column, contexts: Column, reference: Column) -> dict[str, Column]:
    """The verdicts of each metric: an array of numbers from 0 to 1, in the order of what is judged."""
    seen, wanted, asked, told = _terms(F.array_join(contexts, " ")), _terms(reference), _terms(question), _terms(response)
    relevant = F.transform(contexts, lambda c: F.coalesce((_share(wanted, _terms(c)) >= LEAST).cast("double"), F.lit(0.0)))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, told)), F.size(F.array_union(asked, told))), F.lit(0.0))
    return dict(zip(METRICS, (_holds(sentences(response), seen), F.array(overlap), relevant, _holds(sentences(reference), seen))))


def judged_input() -> Column:
    """A hash of all that a judge sees: a changed answer or gold is judged anew."""
    return F.xxhash64("user_input", "response", F.array_join("retrieved_contexts", "\0"), "reference")


def verdicts(rows: DataFrame, judge: Callable | dict[str, Callable] = by_terms, metrics=METRICS) -> DataFrame:
    """VERDICT rows: one for each claim, sentence or context that a metric judges.

    judge: one for all metrics, or one for each (a strong one, a light one). Where there is nothing to
    judge one row says 0.0; a verdict that the judge owes is NaN.
    """
    seen = [F.col(c) for c in ("user_input", "response", "retrieved_contexts", "reference")]
    parts = []
    for m in metrics:
        told = (judge[m] if isinstance(judge, dict) else judge)(*seen)[m]
        if not isinstance(rows.select(told.alias("v")).schema["v"].dataType, ArrayType):
            told = F.array(told)  # a judge that gives one number
        told = F.when(told.isNull(), F.array(F.lit(float("nan")))).when(F.size(told) == 0, F.array(F.lit(0.0))).otherwise(told)
        one = rows.where(F.col("metric") == m) if "metric" in rows.columns else rows
        one = one.select("mode", "id", F.col("gold_idx").cast("int").alias("gold_idx"), F.lit(m).alias("metric"), judged_input().alias("input"), F.posexplode(told).alias("position", "verdict"))
        parts.append(one.withColumn("verdict", F.coalesce(F.col("verdict").cast("double"), F.lit(float("nan")))))
    return reduce(DataFrame.unionByName, parts)


def scores(told: DataFrame, metrics=METRICS) -> DataFrame:
    """One row (mode, id) a run from verdict rows: shares and average precision for each reference, of which the best counts."""
    out, told = None, told.repartition(*RUN_KEYS)  # all that follows is grouped by these, or by more
    for m in metrics:
        one = told.where(F.col("metric") == m)
        if m == "context_precision":
            made = evaluate.average_precision(one.select(*RUN_KEYS, (F.col("position") + 1).alias("rank"), F.col("verdict").alias("relevant")), RUN_KEYS)
        else:
            made = evaluate.verdict_share(one.select(*RUN_KEYS, F.col("verdict").alias("holds")), m, RUN_KEYS)
        out = made if out is None else out.join(made, list(RUN_KEYS), "full")
    return evaluate.collapse_references(out, metrics)


def judged(rows: DataFrame, judge: Callable | dict[str, Callable] = by_terms, metrics=METRICS) -> DataFrame:
    """One row (mode, id) a run: metrics by the judge for each reference, of which the best counts."""
    return scores(verdicts(rows, judge, metrics), metrics)


def missing(rows: DataFrame, stored: DataFrame, metrics=METRICS) -> DataFrame:
    """rows, each with every metric whose verdicts are not stored, or were given for other texts."""
    wanted = rows.withColumn("metric", F.explode(F.array(*map(F.lit, metrics)))).withColumn("input", judged_input())
    return wanted.join(stored.where("not isnan(verdict)").select(*KEYS).distinct(), list(KEYS), "left_anti")


def stored_verdicts(rows: DataFrame, path: str, judge: Callable | dict[str, Callable] = by_terms, metrics=METRICS) -> DataFrame:
    """The verdicts of rows, of which only those that path lacks are asked for and appended, a metric at a time:
    a job that is lost keeps the metrics that were written. A verdict that the judge owed is asked for again."""
    spark = rows.sparkSession
    for m in metrics:
        todo = missing(rows, read_or_empty(spark, path, VERDICT), (m,))
        made = verdicts(todo, judge, (m,))
        if not made.isEmpty():
            made.write.mode("append").partitionBy("metric").parquet(path)
    told = read_or_empty(spark, path, VERDICT).join(rows.withColumn("input", judged_input()).select(*RUN_KEYS, "input").distinct(), [*RUN_KEYS, "input"], "left_semi")
    told = told.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS, "position").orderBy(F.isnan("verdict"))))  # an answer counts before NaN
    return told.where("nth = 1").drop("nth")


def rescore(old: DataFrame, runs: DataFrame, examples: DataFrame, changed: DataFrame, judge: Callable | dict[str, Callable] = by_terms) -> DataFrame:
    """old with the two metrics that see references judged again for the ids of changed (id).

    A missing score is an error, and nothing is patched.
    """
    asked = judge_input(runs.join(changed.select("id").distinct(), "id", "left_semi"), examples, every=False)
    return patch(old, judged(asked, judge, REF_DEPENDENT), REF_DEPENDENT, ("mode", "id"))
