"""Chunking and batching as table functions, and exact token counts."""

import random

import pytest

from quernspark.operators import chunk, table_functions as tf

from test_retrieval import frame

PAGE = """<title>T</title><nav>menu</nav><main><section class="class-description"><p>About <code>it</code> and what it is for, in some words.</p></section>
<section class="field-summary"><p>fields are not taken at all by the splitter of pages</p></section>
<section class="constructor-summary"><p>Stack() makes an empty stack for you to use</p></section>
<section class="method-summary"><table><tr><td>push</td><td>pop</td></tr></table><p>Two methods and nothing else to see</p></section>
<section class="detail" id="push"><h3>push</h3><div class="member-signature">void push(E e)</div><p>Adds one element to the very top of it all.</p></section>
<section class="detail" id="pop"><p>A member that has no heading is named by its id here.</p></section></main><footer>end</footer>"""


def test_sql_has_the_table_functions(spark):
    tf.register(spark)
    frame(spark, [(1, "a.html", PAGE), (2, "b.md", "# plain text of a page in ten words or a few more"), (3, "c.html", None)], "id int, name string, page string").createOrReplaceTempView("pages_of_kinds")
    rows = spark.sql("SELECT p.id, c.* FROM pages_of_kinds p, LATERAL chunk_page(p.name, p.page) c ORDER BY id, pos").collect()
    assert [(r.id, r.pos, r.kind, r.member) for r in rows] == [(1, 0, "class-description", ""), (1, 1, "constructor-summary", ""), (1, 2, "method-summary", ""), (1, 3, "member", "push"), (1, 4, "member", "pop"), (2, 0, "page", "")]
    assert rows[3].text.startswith("a - Member: push\nvoid push(E e)\n\n") and "fields" not in " ".join(r.text for r in rows)
    frame(spark, [(1, "word " * 1200), (2, "short"), (3, None)], "id int, text string").createOrReplaceTempView("long_texts")
    rows = spark.sql("SELECT d.id, c.pos, length(c.text) AS n FROM long_texts d, LATERAL chunk_text(d.text) c ORDER BY ALL").collect()
    assert [(r.id, r.pos) for r in rows] == [(1, 0), (1, 1), (1, 2)]
    frame(spark, [("s", i, n) for i, n in enumerate((60, 50, 10, 20_000, 5_000, 5))], "part string, at long, n_tokens long").createOrReplaceTempView("sized")
    rows = spark.sql("SELECT * FROM token_batches(TABLE(sized) PARTITION BY part ORDER BY (at), 100) ORDER BY at").collect()
    assert [r.batch for r in rows] == [0, 1, 1, 2, 3, 4]


def test_batches_do_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i, "w " * rng.randrange(0, 120)) for i in range(300)]
    table = frame(spark, rows, "source string, pos int, text string")
    a, b = (sorted(map(tuple, chunk.token_batches(t, 200).collect())) for t in (table.coalesce(1), table.repartition(7)))
    want, held, number = [], {}, {}
    for source, pos, text in rows:
        n = len(text.split())
        if held.get(source, 0) and held[source] + n > 200:
            held[source], number[source] = 0, number.get(source, 0) + 1
        held[source] = held.get(source, 0) + n
        want.append((source, pos, n, number.get(source, 0)))
    assert a == b == sorted(want)


def test_exact_counts_are_the_librarys(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain, count = Tokenizer.from_file(path), tf.FileTokens(path)()
    texts = ["", "a b", "naïve Übung; 12345 <code>", "x" * 3000, "\n\n tabs\tand 日本語 🙂"]
    assert [count(t) for t in texts] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = frame(spark, [("d", "unbelievably internationalised words. " * 300)], "source string, text string")
    exact = [r.text for r in chunk.chunk_documents(docs, tokens=tf.FileTokens(path)).collect()]
    assert exact == [c for c in chunk.split_text("unbelievably internationalised words. " * 300, count=count) if count(c) >= chunk.LEAST]
    assert all(count(t) <= chunk.SIZE for t in exact) and exact != [r.text for r in chunk.chunk_documents(docs).collect()]
