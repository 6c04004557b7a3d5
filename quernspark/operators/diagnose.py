"""What went wrong, and where: the failure report's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import METRICS, number

FAITHFUL, TERSE, SHOWN, WORST = 0.5, 12, 0.01, 8


def with_facts(judged: DataFrame, facts: DataFrame) -> DataFrame:
    return judged.join(facts.drop("query_type"), ["mode", "id"], "left")


def diagnosis():
    """Unknown facts or scores have a label of their own instead of counting as hits."""
    hit, refused, faithful = F.col("passage_hit"), F.col("refused"), number("faithfulness")
    return (
        F.when(hit.isNull() | faithful.isNull(), "unknown").when(~hit & refused, "retrieval miss").when(~hit, "adjudicate")
        .when((faithful < FAITHFUL) & (T.word_count(F.col("answer")) <= TERSE), "suspected judge artifact").when(faithful < FAITHFUL, "grounding failure").otherwise("ok")
    )


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode", "diagnosis").agg(F.count("*").alias("n"))


def abstention(facts: DataFrame, modes: DataFrame) -> DataFrame:
    rate = facts.where(~F.col("answerable")).groupBy("mode").agg(F.sum(F.col("refused").cast("int")).alias("refused"), F.count("*").alias("n"))
    return modes.join(rate, "mode", "left")


def hit_rates(facts: DataFrame) -> DataFrame:
    return facts.groupBy("mode").agg(*[F.bround(F.avg(F.col(c).cast("int")), 3).alias(c) for c in ("file_hit", "passage_hit")])


def right_file_wrong_passage(facts: DataFrame) -> DataFrame:
    return facts.where("file_hit and not passage_hit").groupBy("mode").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("diagnosis <> 'ok'").select("mode", "id", "diagnosis", F.substring("answer", 1, 200).alias("answer"))


def failure_details(rows: DataFrame) -> DataFrame:
    """What a reader needs to see of each failure, by diagnosis: question, golds, sources, the answer's beginning, scores."""
    scores = [F.round(m, 2).alias(m) for m in METRICS]
    bad = rows.where("diagnosis <> 'ok'").orderBy("diagnosis", "mode", "id")
    return bad.select("mode", "id", "query_type", "diagnosis", "user_input", "gold_source", "gold_passage", "sources", "passage_hit", F.substring("answer", 1, 200).alias("answer"), *scores)


def row_mean():
    got = F.filter(F.array(*[number(m) for m in METRICS]), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got))


def worst(rows: DataFrame, n: int = WORST) -> DataFrame:
    rated = rows.withColumn("mean", F.round(row_mean(), 6)).where("mean is not null")
    return rated.orderBy("mean", "mode", "id").limit(n).select("mode", "id", "mean")


def rerank_delta(rows: DataFrame, least: float = SHOWN) -> DataFrame:
    """hybrid_rerank minus hybrid on the union of ids; rows that move in any metric or in passage_hit."""
    side = lambda mode, s: rows.where(F.col("mode") == mode).select("id", *[number(m).alias(f"{m}_{s}") for m in METRICS], F.col("passage_hit").alias(f"hit_{s}"))
    both = side("hybrid", "a").join(side("hybrid_rerank", "b"), "id", "full")
    moved = [F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6).alias(m) for m in METRICS]
    out = both.select("id", *moved, (F.col("hit_b") & ~F.col("hit_a")).alias("gained"), (F.col("hit_a") & ~F.col("hit_b")).alias("lost"))
    return out.where(F.exists(F.array(*METRICS), lambda x: F.abs(x) > least) | F.col("gained") | F.col("lost"))


def summary(judged: DataFrame, facts: DataFrame, modes: DataFrame) -> DataFrame:
    means = judged.groupBy("mode").agg(*[F.bround(F.avg(number(m)), 4).alias(m) for m in METRICS])
    return modes.join(means, "mode", "left").join(hit_rates(facts), "mode", "left").join(abstention(facts, modes).drop("ord"), "mode", "left")
