"""python -m quernspark index CORPUS INDEX [--sections] [--vocabulary FILE] | validate EVAL INDEX | browse INDEX WORDS [--file F] [-n N] [--chunk N]
| ask INDEX [QUESTION] [--mode M] | compare INDEX QUESTION... | run EVAL INDEX OUT | score EVAL OUT
| rescore EVAL OUT --ids ID... | report EVAL OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate, retrieve
from .operators.table_functions import FileTokens
from .plans import ask as plans
from .sources import tables

JOBS = {"index": ["corpus", "index"], "validate": ["eval_set", "index"], "browse": ["index", "words"], "ask": ["index"], "compare": ["index"], "run": ["eval_set", "index", "out"], "score": ["eval_set", "out"], "rescore": ["eval_set", "out"], "report": ["eval_set", "out"]}


def show_answer(made: dict) -> None:
    print(f"Q: {made['question']}   [mode: {made['mode']}]\n{made['answer']}\n")
    if made["answer"].strip().lower().startswith(T.REFUSAL):
        print("  (refused: the context does not hold the answer)")
    print("  sources:", *made["sources"], sep="\n    - ")
    print("  " + " | ".join(f"{k.removesuffix('_ms')} {v:.0f} ms" for k, v in made["timings"].items()))


def judged_job(spark: SparkSession, a: argparse.Namespace) -> int:
    """score, rescore and report: what is made of stored runs. A report reads the judgement files, and never judges."""
    examples = tables.read_eval_set(spark, a.eval_set)
    if a.job == "score":
        for mode, path in plans.score_runs(spark, examples, a.out, a.modes).items():
            print(f"{mode}: {path}")
        return 0
    if a.job == "rescore":
        plans.rescore_runs(spark, examples, a.out, a.ids, a.modes).orderBy("mode", "id").show(1000, False)
        return 0
    runs = tables.read_or_empty(spark, f"{a.out}/runs", tables.RUN).where(F.col("mode").isin(*a.modes))
    modes = spark.createDataFrame(list(enumerate(a.modes)), "ord int, mode string")
    scores = tables.read_judged(spark, a.out, a.modes)
    facts = evaluate.run_facts(runs, evaluate.golds(examples)).join(runs.select("mode", "id", F.col("timings.total_ms").alias("latency_ms")), ["mode", "id"])
    tables.write_table(evaluate.ablation(facts, scores, modes), f"{a.out}/ablation")
    print(plans.report(scores, facts, modes, a.worst))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernspark", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    for name, args in JOBS.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
    sub.choices["index"].add_argument("--sections", action="store_true")
    sub.choices["index"].add_argument("--vocabulary")
    sub.choices["browse"].add_argument("--file")
    sub.choices["browse"].add_argument("--chunk", type=int)
    sub.choices["browse"].add_argument("-n", type=int, default=3)
    sub.choices["ask"].add_argument("question", nargs="?")
    sub.choices["ask"].add_argument("--mode", default="hybrid_rerank", choices=evaluate.MODES)
    sub.choices["compare"].add_argument("questions", nargs="+")
    for job in ("run", "score", "rescore", "report"):
        sub.choices[job].add_argument("--modes", nargs="*", default=list(evaluate.MODES), choices=evaluate.MODES)
    sub.choices["run"].add_argument("--limit", type=int)
    sub.choices["run"].add_argument("--rpm", type=float)
    sub.choices["rescore"].add_argument("--ids", nargs="+", required=True)
    sub.choices["report"].add_argument("--worst", type=int, default=8)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quernspark").getOrCreate()
    if a.job == "index":
        plans.build_index(spark, a.corpus, a.index, sections=a.sections, tokens=FileTokens(a.vocabulary) if a.vocabulary else None)
        return 0
    if a.job == "validate":
        return 0 if plans.validate_eval_set(spark, a.eval_set, spark.read.parquet(f"{a.index}/chunks")) else 1
    if a.job in ("score", "rescore", "report"):
        return judged_job(spark, a)
    index = plans.Index.load(spark, a.index)
    if a.job == "browse":
        if a.chunk is not None:
            docs = index.chunks.where(F.contains(F.lower("source"), F.lit((a.file or "").lower())))
            retrieve.chunk_by_number(docs, a.chunk).select("chunk_id", "text").show(1, False, True)
        else:
            retrieve.browse(index.chunks, a.words, a.n, a.file, **index.stored).select("chunk_id", "score", "text").show(a.n, 300, True)
    elif a.job == "compare":
        asked = spark.createDataFrame(list(enumerate(a.questions)), "query_id long, question string")
        index.side_by_side(asked).orderBy("query_id", "list", "rank").show(100 * len(a.questions), False)
    elif a.job == "run":
        plans.run_modes(index, tables.read_eval_set(spark, a.eval_set), f"{a.out}/runs", f"{a.out}/errors", a.modes, first=a.limit, rpm=a.rpm)
    else:
        while question := a.question or input("question (empty: end): ").strip():
            show_answer(plans.ask_one(index, question, a.mode))
            if a.question:
                break
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
