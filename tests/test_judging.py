"""Runs that are saved as they go, call slots, verdict rows, and the commands that judge stored runs."""

import json
import os

import pytest

from quernspark.__main__ import main
from quernspark.functions import text as T
from quernspark.operators import evaluate, judge, models
from quernspark.plans import ask
from quernspark.sources import tables

from test_retrieval import frame

WORDS = ["a stack is a list of elements in order", "a queue takes elements at one end", "a map holds keys and values", "a set has no element twice"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("judging")
    (base / "corpus").mkdir()
    for i, t in enumerate(WORDS):
        (base / "corpus" / f"p{i}.html").write_text(f"<title>{i}</title><main><p>{(t + '. ') * 40}</p></main>")
    ask.build_index(spark, str(base / "corpus"), str(base / "index"))
    return ask.Index.load(spark, str(base / "index"))


def examples(spark, n=6):
    rows = [(f"q{i}", f"what about {WORDS[i % 4].split()[1]} {i}", WORDS[i % 4], WORDS[i % 4], f"p{i % 4}.html", "simple", None, None) for i in range(n - 1)]
    return frame(spark, [*rows, ("u", "which colour", T.REFUSAL, "", "", "unanswerable", None, None)], tables.EVAL)


def test_slots_of_workers_never_pass_the_rate():
    calls = []
    for worker in range(4):
        now = [3.0 * worker]  # workers begin when they can
        slots = models.Slots(worker, 4, 30, 0.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        for k in range(40):
            slots.wait()
            calls.append(now[0])
            now[0] += 9.0 if k == 5 else 0.2  # one call takes longer than its slot
    calls.sort()
    assert all(sum(a <= x < a + 60 for x in calls) <= 30 for a in calls) and len(set(calls)) == len(calls) == 160


def test_calls_of_a_lost_job_are_not_repeated(spark, index, tmp_path):
    log, runs, errors = str(tmp_path / "calls"), str(tmp_path / "runs"), str(tmp_path / "errors")

    def dies():
        def call(question, context):
            with open(log, "a") as f:
                f.write(question + "\n")
            if sum(1 for _ in open(log)) > 3:
                raise SystemExit("the worker is lost")
            return "an answer"

        return call

    def steady():
        def call(question, context):
            with open(log, "a") as f:
                f.write(question + "\n")
            return "an answer"

        return call

    how = {"modes": ("sparse_only",), "pause": 0.0, "tries": 1, "batch": 1}
    with pytest.raises(Exception):
        ask.run_modes(index, examples(spark), runs, errors, factory=dies, **how)
    before = open(log).read().split("\n")[:3]
    ask.run_modes(index, examples(spark), runs, errors, factory=steady, **how)
    after = open(log).read().split("\n")[:-1]
    assert all(after.count(q) == 1 for q in before) and len(set(after)) == 6
    rows = spark.read.parquet(runs).collect()
    assert sorted(r.id for r in rows) == ["q0", "q1", "q2", "q3", "q4", "u"] and all(r.timings.retrieval_ms > 0 and r.timings.total_ms >= r.timings.retrieval_ms for r in rows)
    ask.run_modes(index, examples(spark), runs, errors, factory=dies, **how)  # nothing is left to ask
    assert len(open(log).read().split("\n")[:-1]) == len(after)


def runs_of(spark, answer="a stack is a list. Nobody knows"):
    return frame(spark, [("m", "a", "simple", "what is a stack", answer, [WORDS[0], "noise"]), ("m", "b", "simple", "what is a map", "", [])], "mode string, id string, query_type string, question string, answer string, contexts array<string>")


GOLDS = [("a", "q", WORDS[0], WORDS[0], "f", "simple", [("other words", "of no use", "g")], None), ("b", "q", "keys", "", "f", "simple", None, None)]


def test_verdict_rows(spark):
    rows = judge.judge_input(runs_of(spark), frame(spark, GOLDS, tables.EVAL))
    told = judge.verdicts(rows)
    got = {(r.id, r.gold_idx, r.metric, r.position): r.verdict for r in told.collect()}
    assert [got["a", 0, "faithfulness", k] for k in range(2)] == [1.0, 0.0] and [got["a", 0, "context_precision", k] for k in range(2)] == [1.0, 0.0]
    assert got["b", 0, "faithfulness", 0] == 0.0 == got["b", 0, "context_precision", 0]  # nothing to judge
    one = {r.id: r for r in judge.scores(told).collect()}
    assert (one["a"].faithfulness, one["a"].context_precision, one["a"].context_recall) == (0.5, 1.0, 1.0) and one["b"].faithfulness == 0.0
    light = {m: (judge.by_terms if m != "answer_relevancy" else lambda *_: {"answer_relevancy": judge.F.array(judge.F.lit(0.25))}) for m in evaluate.METRICS}
    assert {r.answer_relevancy for r in judge.judged(rows, light).collect()} == {0.25}


def test_only_missing_verdicts_are_asked_for(spark, tmp_path):
    path, golds = str(tmp_path / "verdicts"), frame(spark, GOLDS, tables.EVAL)
    rows = judge.judge_input(runs_of(spark), golds)
    once = judge.stored_verdicts(rows, path).count()
    assert once == judge.verdicts(rows).count() == spark.read.parquet(path).count()
    stored = tables.read_or_empty(spark, path, judge.VERDICT)
    assert judge.missing(rows, stored).count() == 0
    assert judge.stored_verdicts(rows, path).count() == once == spark.read.parquet(path).count()
    other = judge.judge_input(runs_of(spark).where("id = 'a'").withColumn("answer", judge.F.lit("another answer")).union(runs_of(spark).where("id = 'b'")), golds)
    left = judge.missing(other, tables.read_or_empty(spark, path, judge.VERDICT))
    assert {r.id for r in left.collect()} == {"a"} and left.count() == 2 * len(evaluate.METRICS)  # both golds of a changed answer
    owes = lambda *_: {m: judge.F.lit(None).cast("array<double>") for m in evaluate.METRICS}
    assert judge.scores(judge.stored_verdicts(other, path, owes)).where("id = 'a' and faithfulness is null").count() == 1
    assert judge.scores(judge.stored_verdicts(other, path)).where("id = 'a' and faithfulness is not null").count() == 1


def test_score_rescore_and_report_commands(spark, index, tmp_path, capsys):
    out, path = str(tmp_path), str(tmp_path / "eval.json")
    with open(path, "w") as f:
        json.dump([{k: v for k, v in r.asDict(True).items() if v is not None} for r in examples(spark).collect()], f)
    ask.run_modes(index, examples(spark), f"{out}/runs", f"{out}/errors", modes=("dense_only", "hybrid"))
    assert main(["score", path, out]) == 0 and "judged_hybrid.csv" in capsys.readouterr().out
    judged = tables.read_judged(spark, out)
    assert {(r.mode, r.id) for r in judged.collect()} == {(m, f"q{i}") for m in ("dense_only", "hybrid") for i in range(5)}
    n = spark.read.parquet(f"{out}/verdicts").count()
    assert main(["score", path, out]) == 0 and spark.read.parquet(f"{out}/verdicts").count() == n
    assert main(["report", path, out]) == 0 and "## Diagnosis" in capsys.readouterr().out

    rows = json.load(open(path))
    rows[0]["source_passage"] = rows[0]["ground_truth_answer"] = "words that nothing has"
    json.dump(rows, open(path, "w"))
    assert main(["rescore", path, out, "--ids", "q0"]) == 0
    after = {(r.mode, r.id): r for r in tables.read_judged(spark, out).collect()}
    assert after["hybrid", "q0"].context_recall == 0.0 and os.path.exists(f"{out}/judged_hybrid.csv.BEFORE")

    def owes(*_):
        return {m: judge.F.lit(None).cast("array<double>") for m in evaluate.METRICS}

    with pytest.raises(ValueError, match="PARTIAL"):
        ask.score_runs(spark, examples(spark).withColumn("ground_truth_answer", judge.F.lit("changed")), out, judges=owes)
    assert os.path.exists(f"{out}/judged_dense_only.csv.PARTIAL") and not os.path.exists(f"{out}/judged_hybrid.csv.PARTIAL")


def test_golds_with_one_reference_are_judged_once(spark):
    """A passage that many files hold: as many golds, one text to judge; the scores are those of all golds."""
    held = [("x", "one two", f"f{i}") for i in range(40)]
    golds = frame(spark, [("a", "q a?", *held[0], "simple", held[1:] + [("y", "three", "g")], None)], tables.EVAL)
    runs = runs_of(spark).where("id = 'a'")
    every, once = judge.judge_input(runs, golds), judge.judge_input(runs, golds, every=False)
    assert every.count() == 41 * runs.count() and once.count() == 2 * runs.count()
    assert sorted(map(tuple, judge.judged(once).collect())) == sorted(map(tuple, judge.judged(every).collect()))
    assert [r.gold_idx for r in once.select("gold_idx").distinct().orderBy("gold_idx").collect()] == [0, 40]
