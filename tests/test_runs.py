"""Plans, stored indices, model hooks, runs with failures, judging and re-scoring, readers of judgements."""

import pyarrow as pa
import pytest

from quernspark.functions import text as T
from quernspark.functions.html import page, read_page
from quernspark.operators import chunk, diagnose, evaluate, judge, models, retrieve, validate
from quernspark.plans import ask
from quernspark.sources import tables

from test_retrieval import frame, plain_bm25

WORDS = ["stack holds elements in order", "queue takes elements at one end", "a map holds keys and values", "the stack and the queue are lists", "values may be null", "order of keys is kept"]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [(f"d::{i}", f"s{i % 2}.html", t) for i, t in enumerate(WORDS)], "chunk_id string, source string, text string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return frame(spark, [(i, q) for i, q in enumerate(["stack order", "keys and values", "queue", "nothing known", "the elements", "null null"])], "query_id long, question string").cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_in_slices_give_the_same_lists(spark, docs, asked):
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    whole = rows(retrieve.bm25(docs, asked, 4))
    assert rows(retrieve.bm25(docs, asked, 4, most=2)) == whole and len(whole) == 24
    q = frame(spark, [(i, [float(i), 1.0]) for i in range(5)], "query_id long, q array<float>")
    v = frame(spark, [(i, [float(i % 3), float(i)]) for i in range(9)], "chunk_id long, v array<float>")
    near = retrieve.dense(v, q, 3)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, retrieve.dense(v, q, 3, most_bytes=40).collect())) and near.count() == 15


def test_scores_below_zero_come_after_documents_without_one(spark):
    docs = [(i, "a b" if i < 9 else "zz") for i in range(12)]
    df = frame(spark, docs, "chunk_id int, text string")
    got = retrieve.bm25(df, frame(spark, [(1, "a b")], "query_id int, question string"), 6).orderBy("rank").collect()
    want = sorted(plain_bm25(docs, "a b").items(), key=lambda kv: (-round(kv[1], 6), kv[0]))[:6]
    assert [r.chunk_id for r in got] == [k for k, _ in want]


def test_only_questions_are_broadcast(spark, docs, asked):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        v = frame(spark, [(i, [float(i), 0.0]) for i in range(9)], "chunk_id long, v array<float>")
        near = plan_of(retrieve.dense(v, v.select(v.chunk_id.alias("query_id"), v.v.alias("q"))))
        sparse = plan_of(retrieve.bm25(docs, asked.where("query_id < 3")))
        for plan in (near, sparse):  # only the tasks' lists are shuffled and sorted
            assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_index_is_stored_and_asked(spark, tmp_path, capsys):
    pages = tmp_path / "corpus"
    pages.mkdir()
    for i, t in enumerate(WORDS):
        (pages / f"p{i}.html").write_text(f"<title>{i}</title><main><p>{(t + '. ') * 40}</p></main>")
    ask.build_index(spark, str(pages), str(tmp_path / "index"))
    index = ask.Index.load(spark, str(tmp_path / "index"))
    for mode in evaluate.MODES:
        made = ask.ask_one(index, "map of keys, values", mode)
        assert made["chunks"][0]["text"].startswith("a map holds keys") and made["sources"] and made["answer"].startswith("a map holds keys")
        assert made["timings"]["total_ms"] == pytest.approx(sum(v for k, v in made["timings"].items() if k != "total_ms"))
    with pytest.raises(ValueError):
        ask.ask_one(index, "q", "other")
    side = index.side_by_side(frame(spark, [(1, "null values")], "query_id long, question string")).collect()
    assert {r.list for r in side} == {"dense", "sparse", "hybrid", "reranked"} and sum(r.list == "dense" for r in side) == 3
    assert retrieve.browse(index.chunks, "queue", 2, **index.stored).count() == 2
    assert retrieve.browse(index.chunks, "queue", 2, file="P1.").count() == 1

    examples = frame(spark, [("a", "what is a queue", "ans", WORDS[1], "p1.html", "simple", None, None), ("b", "boom now", T.REFUSAL, "", "", "unanswerable", None, None)], tables.EVAL)
    runs, errors = str(tmp_path / "runs"), str(tmp_path / "errors")

    def shaky():
        def call(question, context):
            if "boom" in question:
                raise OSError("no service")
            return " queue takes elements at one end "
        return call

    def steady():
        return lambda question, context: T.REFUSAL

    how = {"modes": ("sparse_only", "hybrid"), "pause": 0.0, "tries": 2}
    ask.run_modes(index, examples, runs, errors, factory=shaky, **how)
    assert spark.read.parquet(runs).count() == 2
    assert {(r.id, r.error) for r in spark.read.parquet(f"{errors}/failed_hybrid").collect()} == {("b", "OSError: no service")}
    ask.run_modes(index, examples, runs, errors, factory=steady, **how)
    done = spark.read.schema(tables.RUN).parquet(runs)
    assert {(r.mode, r.id, r.answer) for r in done.collect()} == {(m, i, a) for m in how["modes"] for i, a in (("a", "queue takes elements at one end"), ("b", T.REFUSAL))}
    scores = judge.judged(judge.judge_input(done, examples)).collect()
    assert {(r.mode, r.id) for r in scores} == {(m, "a") for m in how["modes"]} and all(r.faithfulness == 1.0 and r.context_recall > 0 for r in scores)
    facts = evaluate.run_facts(done, evaluate.golds(examples)).collect()
    assert all(r.passage_hit and r.gold_source == "p1.html" for r in facts if r.answerable) and sum(r.answerable for r in facts) == 2


def test_calls_are_repeated(spark):
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert models.repeated(call, 3, 0.0) == "done" and len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        models.repeated(lambda: 1 / 0, 2, 0.0)
    for key in (None, "", "put it here"):
        with pytest.raises(RuntimeError):
            models.checked_key(key, "put it here")
    a, b, c, none = models.HashedTerms()(["a b", "B a!", "c", None])
    assert (a == b).all() and abs((a * a).sum() - 1) < 1e-6 and (a != c).any() and not none.any()
    rows = frame(spark, [("q", ""), ("q", None)], "question string, context string")
    assert [r.answer for r in models.attempts(rows).collect()] == [T.REFUSAL] * 2


def test_scorer_hook_reranks(spark, docs, asked):
    def shortest():
        return lambda questions, texts: [-float(len(t)) for t in texts]

    top = retrieve.rerank(retrieve.bm25(docs, asked), docs, asked, 1, models.pair_scorer(shortest)).collect()
    assert {r.chunk_id for r in top} == {"d::4"} and len(top) == 6


def test_judge_by_terms_and_rescore(spark):
    examples = frame(spark, [("a", "who kept it", "the cat kept it", "the cat kept it well", "f", "simple", [("dog", "a dog", "g")], None), ("u", "q", T.REFUSAL, "", "", "unanswerable", None, None)], tables.EVAL)
    runs = frame(spark, [("m", "a", "simple", "who kept it", "The cat kept it. Nobody saw that thing.", ["noise only", "the cat kept it well"]), ("m", "u", "unanswerable", "q", "x", [])], "mode string, id string, query_type string, question string, answer string, contexts array<string>")
    rows = judge.judge_input(runs, examples)
    assert sorted((r.gold_idx, r.reference) for r in rows.collect()) == [(0, "the cat kept it the cat kept it well"), (1, "dog a dog")]
    one = judge.judged(rows).first()
    assert (one.faithfulness, one.context_precision, one.context_recall) == (0.5, 0.5, 1.0)
    old = frame(spark, [("m", "a", 0.1, 0.2, 0.3, 0.4), ("m", "z", 0.1, 0.2, 0.3, 0.4)], "mode string, id string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    new = judge.rescore(old, runs, examples, examples.where("id = 'a'"))
    assert sorted(tuple(r) for r in new.collect()) == [("m", "a", 0.1, 0.2, 0.5, 1.0), ("m", "z", 0.1, 0.2, 0.3, 0.4)]
    assert [tuple(r) for r in evaluate.rescored(old, new).collect()] == [("m", "a", pytest.approx(0.2), pytest.approx(0.6))]
    failing = lambda *_: {m: judge.F.lit(float("nan")) for m in evaluate.METRICS}
    with pytest.raises(ValueError):
        judge.rescore(old, runs, examples, examples.where("id = 'a'"), failing)
    budget = evaluate.call_budget(runs.where("query_type <> 'unanswerable'")).first()
    assert tuple(budget) == (5, 1)


def test_judgements_are_read_by_name(spark, tmp_path):
    head = "id,query_type,user_input,retrieved_contexts,response,reference,faithfulness,answer_relevancy,llm_context_precision_with_reference,context_recall"
    (tmp_path / "judged_hybrid.csv").write_text(head + '\na,simple,q,"[\'x, y\']",r,ref,0.5,0.25,0.75,\n')
    turned = ",".join(reversed(head.split(",")))
    (tmp_path / "judged_dense_only.csv").write_text(turned + "\n1.0,0.1,0.2,0.3,ref,r,c,q,simple,b\n")
    got = {r.id: r for r in tables.read_judged(spark, str(tmp_path)).collect()}
    a, b = got["a"], got["b"]
    assert (a.mode, a.faithfulness, a.answer_relevancy, a.context_precision, a.context_recall) == ("hybrid", 0.5, 0.25, 0.75, None)
    assert (b.mode, b.faithfulness, b.answer_relevancy, b.context_precision, b.context_recall) == ("dense_only", 0.3, 0.2, 0.1, 1.0)
    (tmp_path / "judged_sparse_only.csv").write_text("id,query_type,faithfulness\nz,simple,1.0\n")
    with pytest.raises(KeyError):
        tables.read_judged(spark, str(tmp_path))


def test_missing_scores_are_never_patched_in(spark):
    old = frame(spark, [("a", 1.0)], "id string, m double")
    for bad in (float("nan"), None):
        with pytest.raises(ValueError):
            tables.patch(old, frame(spark, [("a", bad)], "id string, m double"), ["m"])


def test_blank_golds_and_spelling_of_the_refusal(spark):
    chunks = frame(spark, [("f1", 0, "the gold passage")], "source string, pos int, text string")
    rows = [("a", "q", " ", "gold", "f1", "simple", [("x", " ", "f1")], None), ("u", "q", "Insufficient \n Context", "", "", "unanswerable", None, None)]
    found = {(r.id, r.problem) for r in validate.violations(frame(spark, rows, tables.EVAL), chunks).collect()}
    assert found == {("a", "blank answer"), ("a", "blank passage")}
    assert validate.violations(frame(spark, [], tables.EVAL), chunks).count() == 0


def test_pages_that_are_not_well_formed(spark):
    odd = "<title>A &amp; B</title><body><nav>skip<main><p>one &#8212; two&hearts;<br>three<script>x<y</script><div>four</main> out"
    assert read_page(odd) == ("A & B", "one — two♥\nthree\nfour")
    assert read_page("<p>a</i>b<b>c") == ("", "a\nb\nc") and read_page(None) == ("", "")
    assert read_page("<html><title>T</title><p>no main</p>")[1] == "T\nno main"
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    both = rows.select(T.html_text(rows.html).alias("a"), T.html_title(rows.html, T.F.lit("")).alias("t"), page(rows.html).alias("b")).collect()
    assert both and all((r.t, r.a) == (r.b.title, r.b.text) for r in both)


def test_markdown_is_chunked_with_its_name(spark, tmp_path):
    (tmp_path / "notes.md").write_text("  some notes on how queues and stacks are kept in order  ")
    (tmp_path / "p.html").write_text("<title>P</title><main><section class='class-description'><p>what a page of this kind is for, in words</p></section></main>")
    got = chunk.chunk_sections(tables.read_corpus(spark, str(tmp_path)), html="raw").collect()
    assert {(r.source, r.title, r.kind, r.text.split("\n")[0]) for r in got} == {("notes.md", "notes", "page", "notes"), ("p.html", "P", "class-description", "p - Class description")}


def test_both_token_counts_agree(spark):
    texts = ["a_b c d", "x²½ 12٣", "é́ naïve", " tab\t!?", "日本語 テスト", "", "𝒳y 9"]
    got = frame(spark, [(t,) for t in texts], "t string").select("t", T.count_tokens(T.F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: chunk.n_tokens(t) for t in texts}


def test_report_shows_failures_in_full(spark):
    runs = frame(spark, [("hybrid", "a", "no idea", ["f"], ["x"])], "mode string, id string, answer string, sources array<string>, contexts array<string>")
    examples = frame(spark, [("a", "q", "ans", "pass", "f", "simple", None, None)], tables.EVAL)
    facts = evaluate.run_facts(runs, evaluate.golds(examples))
    scores = frame(spark, [("hybrid", "a", "simple", "q?", 0.5, 0.5, 0.5, 0.5)], "mode string, id string, query_type string, user_input string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    told = ask.report(scores, facts, frame(spark, [(0, "hybrid")], "ord int, mode string"))
    assert "adjudicate" in told and "| q? |" in told and "pass" in told
    assert "3 rows more" in tables.markdown("t", spark.range(5), 2)
    assert diagnose.right_file_wrong_passage(facts).first().ids == ["a"]


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, asked = spark.conf.get(name), []
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches)
    told = tables.kept(spark.range(100).coalesce(1).mapInArrow(sizes, "n long"), "sizes", 7)
    assert max(r.n for r in told.collect()) == 7 and sum(r.n for r in told.collect()) == 100 and spark.conf.get(name) == before
    spy = lambda df, tag, batch=None: asked.append((tag, batch)) or tables.kept(df, tag, batch)
    monkeypatch.setattr(retrieve, "kept", spy)
    monkeypatch.setattr(evaluate, "kept", spy)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(30)], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "word7")], "query_id long, question string")
    assert retrieve.bm25(docs, questions, 3).orderBy("rank").first().chunk_id == 7
    items = spark.createDataFrame([(1, "word7 common")], "item_id long, text string")
    assert [tuple(r) for r in evaluate.contained_in(items, docs.withColumnRenamed("chunk_id", "doc_id")).collect()] == [(1, 7)]
    assert asked == [("scored", tables.BATCH), ("held", tables.BATCH)] and spark.conf.get(name) == before
