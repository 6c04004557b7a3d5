"""Ids beyond 2 ** 53 stay what they are in every operator, beside a null id and repeated rows."""

import hashlib

import pytest

from quernspark.llm import imatch, langid, linededup, mixing, neardup, packing, sharding, simhash, urlfilter, vectordedup, warc

from test_operators import documents

BIG = 1 << 60
IDS = [BIG + 1, BIG + 3, None, BIG + 3, 5, -BIG - 7]
TEXT = " ".join(f"w{i * i}" for i in range(70))


def ids_of(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is not None, x or 0))


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, [(i, TEXT, "s") for i in IDS])


SAME = sorted(IDS, key=lambda x: (x is not None, x or 0))


def test_one_row_each(spark, docs):
    slim, plan = mixing.plan_mix(docs)
    assert ids_of(mixing.mix_plan_rows(slim, plan).collect(), "key") == SAME
    assert ids_of(packing.pack_documents(docs, packing.default_vocabulary()).where("start = 0").collect()) == SAME
    assert ids_of(langid.identify(docs).select("row.doc_id").collect()) == SAME
    assert ids_of(imatch.fingerprint_with_next(docs).collect()) == SAME
    got = sharding.shuffle_into_shards(docs.selectExpr("doc_id", "length(text) AS size"), "doc_id", "size", 4).select("row.doc_id").collect()
    assert ids_of(got) == SAME


def test_groups_are_named_by_the_least_id(spark, docs):
    for rows in (simhash.simhash_components(docs).collect(), neardup.near_components(docs).collect()):
        assert ids_of(rows, "key") == SAME and {r.component for r in rows} == {-BIG - 7}


def test_line_dedup_keeps_the_first(spark, docs):
    got = linededup.dedup_lines(docs).select("row.doc_id", "text").collect()
    assert ids_of(got) == SAME and [r.doc_id for r in got if r.text] == [None]
    got = linededup.dedup_lines(docs.where("doc_id is not null")).select("row.doc_id", "text").collect()
    assert [r.doc_id for r in got if r.text] == [-BIG - 7]


def test_archives_lose_no_payload(spark):
    rows = [(BIG + 3, "u", "x" * 200), (BIG + 1, "u", "x" * 200), (None, "u", "y" * 200), (7, "u", "z" * 300), (BIG + 1, "v", "q" * 150)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert ids_of(got, "key") == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    kept = {r.payload_digest for r in got if r.payload is not None}
    assert kept == {hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows}
    assert [(r.key, r.refers_to) for r in got if r.record_type == "revisit"] == [(BIG + 3, BIG + 1)]


def test_urls_and_vectors(spark):
    pages = spark.createDataFrame([(i, "http://a.net/x") for i in IDS], "page_id long, url string")
    assert ids_of(urlfilter.judge_urls(pages).collect(), "key") == SAME
    rows = [(i, [1.0, 2.0], 1) for i in (BIG + 1, BIG + 3, None, -BIG - 7)]
    got = {r.key: (r.n_links, r.component) for r in vectordedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {BIG + 1: (2, -BIG - 7), BIG + 3: (2, -BIG - 7), -BIG - 7: (2, -BIG - 7), None: (0, None)}
