"""Context, prompt and answer of retrieved chunks. The model is a hook with a deterministic default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SYSTEM = f"Answer from the context alone. If the context does not hold the answer, reply exactly: {T.REFUSAL}"


def contexts(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, chunks in rank order, sources, context)."""
    rows = ranked.join(docs.select("chunk_id", "source", "text"), "chunk_id")
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source", "text"))).alias("chunks"), T.sources_set(F.col("source")).alias("sources"))
    return packed.withColumn("context", T.context_block(F.col("chunks")))


def extractive(question, chunks):
    """The sentence with the largest share of the question's terms, or the refusal below a half."""
    words = F.array_distinct(T.tokenize(question))
    sentences = F.flatten(F.transform(chunks, lambda c: F.split(c["text"], r"(?<=[.!?])\s+")))
    rated = F.transform(sentences, lambda s, i: F.struct(F.try_divide(F.size(F.array_intersect(words, T.tokenize(s))), F.size(words)).alias("share"), (-i).alias("order"), s.alias("s")))
    best = F.array_max(rated)
    return F.when(best["share"] >= 0.5, F.trim(best["s"])).otherwise(T.REFUSAL)


def answer(questions: DataFrame, found: DataFrame, model=extractive) -> DataFrame:
    """One row a question; without chunks the answer is the refusal and the model is not asked."""
    rows = questions.join(found, "query_id", "left")
    asked = F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, T.REFUSAL).otherwise(model(F.col("question"), F.col("chunks")))
    return rows.withColumn("prompt", T.prompt(SYSTEM, F.col("context"), F.col("question"))).withColumn("answer", asked)
