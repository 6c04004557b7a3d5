"""Hand-made cases for the retrieval, chunking and evaluation operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernspark.functions import text as T
from quernspark.operators import chunk, diagnose, evaluate, generate, retrieve, validate
from quernspark.plans import ask
from quernspark.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ranked(spark, ids):
    return frame(spark, [(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")


def test_rrf_order_and_ties(spark):
    out = retrieve.rrf(ranked(spark, "abc"), ranked(spark, "cda")).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["a", "c", "b", "d"]
    assert out[0].score == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)


def plain_bm25(docs, question):
    toks = {k: T_plain(t) for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if v < 0 else v for w, v in idf.items()}
    return {k: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in T_plain(question)) for k, t in toks.items()}


def T_plain(t):
    import re

    return re.findall("[a-z0-9]+", t.lower())


def test_bm25_against_plain_and_zero_fill(spark):
    docs = [(i, t) for i, t in enumerate(["a b c", "a a d", "x y", "", "q r s t", "b b b a z"])]
    df = frame(spark, docs, "chunk_id long, text string")
    for question in ("a b b", "nothing here", "a", "z q"):
        want = sorted(plain_bm25(docs, question).items(), key=lambda kv: (-round(kv[1], 6), kv[0]))[:4]
        got = retrieve.bm25(df, frame(spark, [(1, question)], "query_id int, question string"), 4).orderBy("rank").collect()
        assert [(r.chunk_id, pytest.approx(r.score, abs=1e-6)) for r in got] == [(k, round(v, 6)) for k, v in want]


def test_dense_and_modes(spark):
    docs = frame(spark, [(i, f"word{i} common", f"s{i % 2}") for i in range(8)], "chunk_id long, text string, source string")
    asked = frame(spark, [(1, "word3 common")], "query_id long, question string")
    vectors = frame(spark, [(i, [float(i), 0.0]) for i in range(8)], "chunk_id long, v array<float>")
    q = frame(spark, [(1, [2.2, 0.0])], "query_id long, q array<float>")
    assert [r.chunk_id for r in retrieve.dense(vectors, q, 3).orderBy("rank").collect()] == [2, 3, 1]
    for mode in tables.MODES:
        assert retrieve.retrieve(mode, docs, asked, vectors, q).count() == 5
    assert retrieve.retrieve("hybrid_rerank", docs, asked, vectors, q).orderBy("rank").first().chunk_id == 3
    with pytest.raises(ValueError):
        retrieve.retrieve("other", docs, asked, vectors, q)
    assert ask.all_modes(asked, docs, vectors, q).count() == 20
    got = ask.ask(asked, docs, vectors, q).first()
    assert "word3" in got.answer and got.sources == ["s0", "s1"] and got.prompt.endswith("ANSWER:")
    empty = generate.answer(asked, generate.contexts(ranked(spark, "").selectExpr("cast(query_id as long) query_id", "cast(chunk_id as long) chunk_id", "rank"), docs)).first()
    assert empty.answer == T.REFUSAL
    assert retrieve.browse(docs, "word5", 1, "S1").first().chunk_id == 5


def test_text_functions(spark):
    html = "<html><head><title> A &amp;amp; B </title></head><body><script>x('</p>')</script><nav>n</nav><p>One <b>two</b> three.</p><!-- c --><footer>f</footer></body></html>"
    row = frame(spark, [(html, " Insufficient Context, sorry", "H: x\n\n  lower start", "no insufficient context")], "h string, a string, c string, d string")
    got = row.select(T.html_title(row.h, row.a).alias("t"), T.html_text(row.h).alias("x"), T.html_flat(row.h).alias("f"), T.is_refusal(row.a).alias("r"), T.is_refusal(row.d).alias("n"), T.starts_mid_sentence(row.c).alias("m"), T.norm(row.c).alias("norm")).first()
    assert (got.t, got.x) == ("A &amp; B", "A &amp; B\nOne\ntwo\nthree.") and got.f == "A &amp; B One two three."
    assert got.r and not got.n and got.m and got.norm == "h x lower start"
    p = frame(spark, [(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    a = p.agg(T.percentile(p.v, 0.5).alias("a"), T.percentile(p.v, 0.95).alias("b")).first()
    assert a.a == 3.0 and a.b == pytest.approx(9.1)
    assert p.where("false").agg(T.percentile(p.v, 0.5).alias("a")).first().a == 0.0
    assert T.metric_column(["id", "llm_context_precision_with_reference"], "context_precision").startswith("llm")


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n?!", max_size=400), st.integers(3, 30), st.integers(0, 3))
def test_splitter_keeps_everything(text, size, overlap):
    assert "".join(chunk.pieces(text, size, chunk.SEPARATORS)) == text
    out = chunk.split_text(text, size, overlap)
    assert all(chunk.n_tokens(c) <= size for c in out)
    if overlap == 0:
        assert "".join("".join(out).split()) == "".join(text.split())


def test_sections(spark):
    page = """<title>T</title><main><section class="class-description"><p>About <code>it</code>.</p><script>no</script></section>
    <section class="method-summary"><table><tr><td>push</td></tr></table></section>
    <section class="detail" id="push"><h3>push</h3><div class="member-signature">void push(E e)</div><p>Adds one element to the very top of it all.</p></section></main>"""
    got = chunk.page_sections(page, "a.B")
    assert [(k, m, h) for k, m, h, _ in got] == [("class-description", "", "a.B - Class description"), ("method-summary", "", "a.B - Method Summary"), ("member", "push", "a.B - Member: push\nvoid push(E e)")]
    assert got[0][3] == "About it ." and "void push(E e) Adds one" in got[2][3]
    assert chunk.page_sections("<p>plain</p>", "x") == [("page", "", "x", "plain")]
    rows = chunk.chunk_sections(frame(spark, [("a.B.html", page)], "source string, html string")).orderBy("pos").collect()
    assert rows[-1].chunk_id == f"a.B.html::{len(rows) - 1}" and rows[-1].member == "push"
    long = frame(spark, [("d", "word " * 1200)], "source string, text string")
    parts = chunk.chunk_documents(long).collect()
    assert [r.chunk_id for r in parts] == [f"d::{i}" for i in range(len(parts))] and len(parts) == 3
    texts = frame(spark, [("d", i, "w " * n) for i, n in enumerate((60, 50, 10, 200, 5))], "source string, pos int, text string")
    assert [r.batch for r in chunk.token_batches(texts, 100).orderBy("pos").collect()] == [0, 1, 1, 2, 3]


def test_average_precision(spark):
    for at, want in (((2, 3, 4), 0.638889), ((4, 5), 0.325), ((5,), 0.2), ((), 0.0)):
        v = frame(spark, [("m", "q", r, int(r in at)) for r in range(1, 6)], "mode string, id string, rank int, relevant int")
        assert evaluate.average_precision(v).first().context_precision == pytest.approx(want, abs=1e-6)


def test_diagnosis_truth_table(spark):
    nan = float("nan")
    cases = [(False, True, 0.9, 3, "retrieval miss"), (False, False, 0.9, 3, "adjudicate"), (True, False, 0.4, 12, "suspected judge artifact"), (True, False, 0.4, 13, "grounding failure"), (True, False, 0.5, 3, "ok"), (None, False, 0.9, 3, "unknown"), (True, False, nan, 3, "unknown"), (True, False, None, 3, "unknown")]
    df = frame(spark, [(h, r, f, "w " * n, want) for h, r, f, n, want in cases], "passage_hit boolean, refused boolean, faithfulness double, answer string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", diagnose.diagnosis()).collect())


def test_golds_facts_and_collapse(spark):
    examples = frame(spark, [("p1", "q", "ans", "pass one", "f1", "simple", [("a2", "pass two", "f2")], None), ("u1", "q", T.REFUSAL, "", "", "unanswerable", None, None), ("s1", "q", "a", "other", "f3", "simple", None, None)], tables.EVAL)
    gold = evaluate.golds(examples)
    assert [(r.id, r.gold_idx, r.reference) for r in gold.orderBy("id", "gold_idx").collect()] == [("p1", 0, "ans pass one"), ("p1", 1, "a2 pass two"), ("s1", 0, "a other")]
    runs = frame(spark, [("m", "p1", "x", ["f2"], ["has Pass", "TWO in it"]), ("m", "u1", " Insufficient context.", ["f1"], ["x"]), ("m", "s1", "y", ["f3"], ["nothing"])], "mode string, id string, answer string, sources array<string>, contexts array<string>")
    facts = {r.id: r for r in evaluate.run_facts(runs, gold).collect()}
    assert facts["p1"].file_hit and facts["p1"].passage_hit and facts["s1"].file_hit and not facts["s1"].passage_hit
    assert facts["u1"].file_hit is None and facts["u1"].refused and not facts["u1"].answerable
    nan = float("nan")
    judged = frame(spark, [("m", "a", 0, 0.5, 0.1, nan, 0.3), ("m", "a", 1, 0.9, 0.2, 0.7, nan)], "mode string, id string, gold_idx int, faithfulness double, answer_relevancy double, context_precision double, context_recall double")
    one = evaluate.collapse_references(judged).first()
    assert (one.faithfulness, one.context_precision, one.context_recall) == (0.5, 0.7, 0.3)
    assert tuple(evaluate.poison(judged).first()) == (0, 0, 1, 1)
    work = evaluate.worklist(frame(spark, [("m",), ("n",)], "mode string"), examples, frame(spark, [("m", "p1")], "mode string, id string"))
    assert work.count() == 5


def test_containment_against_plain(spark):
    docs = [(1, "The quick brown fox jumps over it"), (2, "quick brown"), (3, "a the QUICK, brown fox! jumps over"), (4, "")]
    items = [(1, "the quick brown fox jumps over"), (2, "brown fox"), (3, "brow"), (4, ""), (5, "fox")]
    got = {tuple(r) for r in evaluate.contained_in(frame(spark, items, "item_id long, text string"), frame(spark, docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3), (5, 1), (5, 3)}  # a passage may begin and end inside words
    items = [(1, "rown fox jump"), (2, "uick brown"), (3, "own fox jumps over i"), (4, "brown jumps over")]
    got = {tuple(r) for r in evaluate.contained_in(frame(spark, items, "item_id long, text string"), frame(spark, docs, "doc_id long, text string"), most_bytes=30).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)}


def test_validator(spark):
    chunks = frame(spark, [("f1", 0, "the gold  pas"), ("f1", 1, "sage")], "source string, pos int, text string")
    rows = [("a", "q", "x", "Gold pas Sage", "f1", "simple", None, None), ("a", " ", "x", "no", "f1", "simple", None, None), ("b", "q", "x", "p", "gone", "odd", None, None), ("c", "q", "wrong", "p", "", "unanswerable", None, None), ("d", None, "x", "gold", "f1", "simple", None, None)]
    found = {(r.id, r.problem) for r in validate.violations(frame(spark, rows, tables.EVAL), chunks).collect()}
    assert found == {("d", "missing question"), ("a", "duplicate id"), ("b", "unknown type"), ("a", "blank question"), ("c", "answer of an unanswerable question"), ("c", "source of an unanswerable question"), ("b", "file not in corpus"), ("a", "passage not in file")}
    assert not validate.passes(frame(spark, rows[:1], tables.EVAL), chunks)
    assert validate.passes(frame(spark, rows[:1], tables.EVAL), chunks, {"simple": (1, 1)})


def test_files(spark, tmp_path):
    (tmp_path / "b.html").write_bytes(b"<title>B</title><main><p>body \xff text</p></main>")
    (tmp_path / "a.html").write_text("<p></p>")
    (tmp_path / "c.md").write_text(" note ")
    got = tables.read_corpus(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.source, r.title, r.text) for r in got] == [("b.html", "B", "body  text"), ("c.md", "c", "note")]
    old = frame(spark, [("a", 1.0), ("b", 2.0)], "id string, m double")
    assert {tuple(r) for r in tables.patch(old, frame(spark, [("a", 5.0)], "id string, m double"), ["m"]).collect()} == {("a", 5.0), ("b", 2.0)}
    bad = frame(spark, [("a", float("nan"))], "id string, faithfulness double")
    with pytest.raises(ValueError):
        tables.write_judged(bad, str(tmp_path / "out.csv"), ("faithfulness",))
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0


def test_missing_ids_are_no_duplicates(spark):
    row = ("q", "insufficient context", "", "", "unanswerable", [])
    rows = [(None, *row), (None, *row), ("a", *row), ("a", *row)]
    examples = spark.createDataFrame(rows, "id string, question string, ground_truth_answer string, source_passage string, source_file string, query_type string, alt_golds array<struct<ground_truth_answer: string, source_passage: string, source_file: string>>")
    chunks = spark.createDataFrame([("f", 0, "text")], "source string, pos int, text string")
    found = sorted((r.id or "", r.problem) for r in validate.violations(examples, chunks).collect())
    assert found == [("", "missing id"), ("", "missing id"), ("a", "duplicate id")]


def test_facts_compare_a_text_once_for_each_passage(spark):
    """A passage that many files hold is looked for once; null files, null and blank passages count as in a row-wise or."""
    many = [("x", "the Pass", f"f{i}") for i in range(30)]
    odd = {"n1": ("x", "pass", None), "n2": ("x", None, "f1"), "n3": ("x", " ", "f1"), "n4": ("x", "gone", "zz")}
    rows = [("p", "q", *many[0], "simple", many[1:], None)] + [(i, "q", *g, "simple", None, None) for i, g in odd.items()]
    gold = evaluate.golds(frame(spark, rows, tables.EVAL))
    runs = frame(spark, [("m", i, "x", ["f1"], ["has the", "pass"]) for i in ("p", *odd)], "mode string, id string, answer string, sources array<string>, contexts array<string>")
    facts = evaluate.run_facts(runs, gold)
    told = {r.id: r for r in facts.collect()}
    assert {i: (r.file_hit, r.passage_hit) for i, r in told.items()} == {"p": (True, True), "n1": (None, True), "n2": (True, None), "n3": (True, False), "n4": (False, False)}
    assert told["p"].gold_source.split(" | ") == [f"f{i}" for i in range(30)] and told["p"].gold_passage.count("the Pass") == 30
    assert "exists(passages" in facts._jdf.queryExecution().executedPlan().toString()  # no row a gold with a text
