"""Pages with cut and unknown references, by the queries that parse them, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

PAGES = [
    (1, "<html><title>one &amp;&amp;&amp</title><p>two &amp; three &amp&ltb &copy 1</p><p>R&D &amp;lt; &eacute; x&nbsp;y</p></html>"),
    (2, "<html><title>a &lt;b&gt; &am</title><p>" + "word &amp;&amp&amp; " * 300 + "&amp</p></html>"),
]


@pytest.mark.parametrize("name", ["page_texts", "section_chunks"])
def test_cut_references(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = list(want.columns)
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(want.fetchall()) and len(got) > 1
