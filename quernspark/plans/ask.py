"""Whole jobs: build the indices, answer questions, run all modes, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, diagnose, evaluate, generate, judge, models, postings, retrieve, validate
from ..sources import tables


def build_index(spark: SparkSession, corpus: str, index: str, embedding=models.HashedTerms, sections: bool = False, tokens=None) -> None:
    """Chunks, postings, statistics and vectors as tables that are replaced as a whole.

    Chunks are pieces of the pages' texts or, with sections, the pages' sections under their headers (kind and
    member then stay with a chunk). tokens is the hook for token counts.
    """
    pages = tables.read_corpus(spark, corpus)
    if sections:
        chunks = chunk.chunk_sections(pages.select("source", "title", "raw"), html="raw", tokens=tokens)
    else:
        chunks = chunk.chunk_documents(pages.select("source", "title", "text"), tokens=tokens)
    tables.rebuild(chunks, f"{index}/chunks")
    chunks = spark.read.parquet(f"{index}/chunks")
    stats = retrieve.doc_stats(chunks).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tables.rebuild(stats, f"{index}/stats")
    n, avgdl = spark.read.parquet(f"{index}/stats").first()
    tables.rebuild(postings.blocks(postings.impacts(chunks, avgdl or 1.0, retrieve.K1, retrieve.B)), f"{index}/postings", "bucket")
    bounds = postings.term_bounds(spark.read.parquet(f"{index}/postings"), retrieve.term_stats(chunks, n))
    tables.rebuild(bounds, f"{index}/terms", "bucket")
    tables.rebuild(chunks.select("chunk_id", models.embed(F.col("text"), embedding).alias("v")), f"{index}/vectors")


@dataclass
class Index:
    """A stored index: what retrieval reads instead of the texts."""

    chunks: DataFrame
    vectors: DataFrame
    stored: dict
    embedding: Callable = models.HashedTerms

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedding=models.HashedTerms) -> Index:
        n, avgdl = spark.read.parquet(f"{path}/stats").first()
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("chunks"), read("vectors"), {"stats": (n, avgdl or 1.0), "terms": read("terms"), "postings": read("postings")}, embedding)

    def queries(self, questions: DataFrame) -> DataFrame:
        """Question vectors by the embedding that made the index."""
        return questions.select("query_id", models.embed(F.col("question"), self.embedding).alias("q"))

    def candidates(self, mode: str, questions: DataFrame) -> DataFrame:
        return retrieve.candidates(mode, self.chunks, questions, self.vectors, self.queries(questions), **self.stored)

    def retrieve(self, mode: str, questions: DataFrame, scorer=retrieve.coverage) -> DataFrame:
        return retrieve.retrieve(mode, self.chunks, questions, self.vectors, self.queries(questions), scorer=scorer, **self.stored)

    def side_by_side(self, questions: DataFrame) -> DataFrame:
        return retrieve.side_by_side(self.chunks, questions, self.vectors, self.queries(questions), **self.stored)


def ask_one(index: Index, question: str, mode: str = "hybrid_rerank", model=generate.extractive, scorer=retrieve.coverage) -> dict:
    """question, mode, answer, sources, chunks (in rank order) and the milliseconds of each step and of all."""
    spark, marks = index.chunks.sparkSession, [time.perf_counter()]
    asked = spark.createDataFrame([(1, question)], "query_id long, question string")

    def step(df: DataFrame) -> DataFrame:
        rows = df.collect()  # 20 candidates at most
        marks.append(time.perf_counter())
        return spark.createDataFrame(rows, df.schema)

    found = step(index.candidates(mode, asked).select("query_id", "chunk_id", "score", "rank"))
    ranked = step(retrieve.rerank(found, index.chunks, asked, scorer=scorer).select("query_id", "chunk_id", "score", "rank") if mode == "hybrid_rerank" else found.where(F.col("rank") <= retrieve.TOP_N))
    row = step(generate.answer(asked, generate.contexts(ranked, index.chunks), model)).first()
    names = ("retrieval_ms", "rerank_ms", "generation_ms")
    timings = {name: (b - a) * 1000 for name, a, b in zip(names, marks, marks[1:])}
    return {"question": question, "mode": mode, "answer": row["answer"], "sources": row["sources"] or [], "chunks": row["chunks"] or [], "timings": timings | {"total_ms": sum(timings.values())}}


ATTEMPT = f"{tables.RUN}, error string"


def run_modes(index: Index, examples: DataFrame, runs_path: str, errors_path: str, modes=evaluate.MODES, factory=models.FirstSentence, first: int | None = None, batch: int = 50, scorer=retrieve.coverage, **how) -> None:
    """Run what is not stored yet of modes x examples (of the first examples by id, if asked).

    A mode's contexts are found in one job and stored; its questions are then asked in batches of about
    batch, and each batch is appended to a journal as soon as it is done: a job that is lost loses the calls
    of one batch. What the journal has is never asked again, also if the job ended before it came to
    the runs. Questions whose calls fail stand in the journal with the reason, and in the errors; a
    later run tries them again. Times of retrieval and reranking are those of the mode's job, a question.
    """
    spark, journal = examples.sparkSession, f"{errors_path}/journal"
    examples = examples.orderBy("id").limit(first) if first else examples
    for mode in modes:
        publish(spark, journal, runs_path, mode)
        one = spark.createDataFrame([(mode,)], "mode string")
        todo = examples.join(evaluate.worklist(one, examples, tables.read_or_empty(spark, runs_path, tables.RUN)), "id")
        todo = todo.select("mode", F.col("id").alias("query_id"), "query_type", "question")
        if not (many := todo.count()):
            continue
        marks = [time.perf_counter()]
        found = tables.kept(index.candidates(mode, todo), "candidates")
        marks.append(time.perf_counter())
        if mode == "hybrid_rerank":
            found = tables.kept(retrieve.rerank(found, index.chunks, todo, scorer=scorer), "reranked")
        marks.append(time.perf_counter())
        told = generate.contexts(found.where(F.col("rank") <= retrieve.TOP_N), index.chunks)
        told = told.select("query_id", "context", "sources", F.transform("chunks", lambda c: c["text"]).alias("contexts"))
        batches = -(-many // batch)
        work = tables.kept(todo.join(told, "query_id", "left").withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches))), "work")
        spent = [F.lit((b - a) * 1000 / many).alias(name) for a, b, name in zip(marks, marks[1:], ("retrieval_ms", "rerank_ms"))]
        for n in range(batches):
            made = models.attempts(work.where(F.col("batch") == n), factory, **how).withColumnRenamed("query_id", "id")
            times = F.struct(*spent, "generation_ms", (F.lit((marks[-1] - marks[0]) * 1000 / many) + F.col("generation_ms")).alias("total_ms"))
            made.select("id", "mode", "query_type", "question", "answer", "contexts", "sources", times.alias("timings"), "error").write.mode("append").partitionBy("mode").parquet(journal)
        publish(spark, journal, runs_path, mode)
        failed = tables.read_or_empty(spark, journal, ATTEMPT).where((F.col("mode") == mode) & F.col("error").isNotNull())
        left = failed.join(tables.read_or_empty(spark, runs_path, tables.RUN).select("mode", "id"), ["mode", "id"], "left_anti")
        left.groupBy("mode", "id").agg(F.max("error").alias("error")).write.mode("overwrite").parquet(f"{errors_path}/failed_{mode}")


def publish(spark: SparkSession, journal: str, runs_path: str, mode: str) -> None:
    """Append what the journal has of a mode, and the runs have not, to the runs."""
    made = tables.read_or_empty(spark, journal, ATTEMPT).where((F.col("mode") == mode) & F.col("error").isNull()).drop("error").dropDuplicates(["mode", "id"])
    new = made.join(tables.read_or_empty(spark, runs_path, tables.RUN).select("mode", "id"), ["mode", "id"], "left_anti")
    rows = tables.kept(new.select(*made.columns), "published")
    if not rows.isEmpty():
        tables.append_runs(rows, runs_path)


def score_runs(spark: SparkSession, examples: DataFrame, out: str, modes=evaluate.MODES, judges=judge.by_terms) -> dict[str, str]:
    """Judge the stored runs mode by mode: verdicts that are stored already are not asked for again. Each mode's
    scores go to judged_{mode}.csv; with one missing they go to .PARTIAL, and the job stops there with an error."""
    runs, written = tables.read_or_empty(spark, f"{out}/runs", tables.RUN), {}
    for mode in modes:
        mine = runs.where(F.col("mode") == mode)
        rows = judge.judge_input(mine, examples, every=False)
        if rows.isEmpty():
            continue
        told = judge.scores(judge.stored_verdicts(rows, f"{out}/verdicts", judges))
        written[mode] = tables.write_judged(as_judged(mine, examples, told), f"{out}/judged_{mode}.csv")
    return written


def as_judged(runs: DataFrame, examples: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of a judgement file: what was asked and answered, the first reference, the scores."""
    first = evaluate.golds(examples).where("gold_idx = 0").select("id", "reference")
    rows = runs.select("mode", "id", "query_type", F.col("question").alias("user_input"), F.col("answer").alias("response")).join(first, "id").join(told, ["mode", "id"])
    return rows.select("id", "query_type", "user_input", "response", "reference", *evaluate.METRICS)


def rescore_runs(spark: SparkSession, examples: DataFrame, out: str, ids: list[str], modes=evaluate.MODES, judges=judge.by_terms) -> DataFrame:
    """Judge the metrics that see references again for some ids, patch the judgement files, and return the changes.
    The files before are kept as judged_{mode}.csv.BEFORE."""
    runs, changed = tables.read_or_empty(spark, f"{out}/runs", tables.RUN), spark.createDataFrame([(i,) for i in ids], "id string")
    moved = []
    for mode in modes:
        old = tables.read_judged(spark, out, (mode,))
        if old.isEmpty():
            continue
        new = tables.kept(judge.rescore(old, runs.where(F.col("mode") == mode), examples, changed, judges), "rescored")
        moved.append(tables.kept(evaluate.rescored(old, new), "moved"))
        old.drop("mode").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/judged_{mode}.csv.BEFORE")
        tables.write_judged(new.drop("mode"), f"{out}/judged_{mode}.csv")
    if not moved:
        raise ValueError("nothing is judged yet")
    return reduce(DataFrame.unionByName, moved)


def ask(questions: DataFrame, docs: DataFrame, vectors: DataFrame, queries: DataFrame, mode: str = "hybrid_rerank", model=generate.extractive) -> DataFrame:
    """(query_id, question, answer, sources, chunks, prompt) for a batch of questions in one job."""
    ranked = retrieve.retrieve(mode, docs, questions, vectors, queries)
    return generate.answer(questions, generate.contexts(ranked, docs), model)


def all_modes(questions: DataFrame, docs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(mode, query_id, chunk_id, rank) of the four modes. Both candidate lists, and what is made of them, are
    stored: they are as many rows as the questions have candidates, and every later plan starts from them."""
    sparse = tables.kept(retrieve.bm25(docs, questions).select("query_id", "chunk_id", "score", "rank"), "sparse")
    near = tables.kept(retrieve.dense(vectors, queries).select("query_id", "chunk_id", "score", "rank"), "dense")
    hybrid = tables.kept(retrieve.rrf(near, sparse), "hybrid")
    lists = {"dense_only": near, "sparse_only": sparse, "hybrid": hybrid, "hybrid_rerank": retrieve.rerank(hybrid, docs, questions)}
    cut = [x.where(F.col("rank") <= retrieve.TOP_N).select(F.lit(m).alias("mode"), "query_id", "chunk_id", "rank") for m, x in lists.items()]
    return tables.kept(reduce(DataFrame.unionByName, cut), "ranked")


def report(judged: DataFrame, facts: DataFrame, modes: DataFrame, worst: int = diagnose.WORST) -> str:
    rows = diagnose.with_facts(judged, facts).withColumn("diagnosis", diagnose.diagnosis())
    parts = {"Abstention": diagnose.abstention(facts, modes), "Hits": diagnose.hit_rates(facts), "Right file, wrong passage": diagnose.right_file_wrong_passage(facts), "Diagnosis": diagnose.histogram(rows).orderBy(F.desc("n")), "Failures": (diagnose.failure_details if {"gold_source", "user_input"} <= set(rows.columns) else diagnose.failures)(rows), "Worst": diagnose.worst(rows, worst), "Reranking": diagnose.rerank_delta(rows), "Summary": diagnose.summary(judged, facts, modes).orderBy("ord")}
    return "\n".join(tables.markdown(k, v) for k, v in parts.items())


def validate_eval_set(spark: SparkSession, path: str, chunks: DataFrame) -> bool:
    examples = tables.read_eval_set(spark, path)
    return validate.passes(examples, chunks)
