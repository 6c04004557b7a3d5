"""The k best in blocks, and the stored keyword index, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quernspark.operators import postings, retrieve, topk
from quernspark.sources import tables

from test_retrieval import frame, plain_bm25


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 4, size=(5, 300)).astype(float), rng.permutation(1000)[:300]
    best = topk.Best(5, 7)
    for lo in range(0, 300, 40):
        order = np.argsort(ids[lo : lo + 40])
        best.take(0, scores[:, lo : lo + 40][:, order], ids[lo : lo + 40][order])
    question, got, value = best.rows()
    for q in range(5):
        want = sorted(zip(-scores[q], ids.tolist()))[:7]
        assert list(zip(-value[question == q], got[question == q].tolist())) == want


def test_best_of_words_as_ids_and_short_blocks():
    best = topk.Best(1, 3)
    for block in (["b", "é"], ["a::10", "a::9", "zz"], []):
        ids = topk.id_array(pa.array(sorted(block, key=str.encode), pa.string())) if block else None
        if block:
            best.take(0, np.array([[np.nan if x == "zz" else 1.0 for x in sorted(block, key=str.encode)]]), ids)
    assert topk.id_column(best.rows()[1]).to_pylist() == ["a::10", "a::9", "b"]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_nearest_against_all_pairs(spark, ids):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(3000, 8)), np.ones((1500, 8))]).astype(np.float32)  # a third are copies
    q = np.concatenate([rng.normal(size=(60, 8)), np.ones((3, 8))]).astype(np.float32)
    name = (lambda i: i) if ids == "long" else (lambda i: f"doc::{i}")
    vectors = frame(spark, [(name(i), x.tolist()) for i, x in enumerate(v)] + [(name(9999), None)], f"chunk_id {ids}, v array<float>")
    asked = frame(spark, [(i, x.tolist()) for i, x in enumerate(q)], "query_id int, q array<float>")
    got = retrieve.dense(vectors, asked, 10)
    assert dict(got.dtypes)["query_id"] == "int"
    lists = {}
    for r in got.collect():
        lists.setdefault(r.query_id, []).append((r["rank"], r.distance, r.chunk_id))
    for i, x in enumerate(q.astype(float)):
        d = np.round(((v.astype(float) - x) ** 2).sum(axis=1), 6)
        want = sorted((d[j], name(j)) for j in range(len(v)))[:10]
        assert [(b, c) for _, b, c in sorted(lists[i])] == want


def test_nearest_refuses_other_lengths(spark):
    vectors = frame(spark, [(1, [1.0, 2.0])], "chunk_id long, v array<float>")
    with pytest.raises(Exception, match="3 numbers"):
        retrieve.dense(vectors, frame(spark, [(1, [1.0, 2.0, 3.0])], "query_id long, q array<float>")).collect()
    assert retrieve.dense(vectors, frame(spark, [(1, None)], "query_id long, q array<float>")).count() == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    made = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rng.randrange(3, 60)))) for i in range(700)]
    return [*made, (700, None), (701, ""), (702, "only w5 w5 w5")]


def stored(spark, docs, path):
    n, avgdl = retrieve.index_stats(docs)
    tables.rebuild(postings.blocks(postings.impacts(docs, avgdl, retrieve.K1, retrieve.B)), f"{path}/postings", "bucket")
    tables.rebuild(postings.term_bounds(spark.read.parquet(f"{path}/postings"), retrieve.term_stats(docs, n)), f"{path}/terms", "bucket")
    return {"stats": (n, avgdl), "postings": spark.read.parquet(f"{path}/postings"), "terms": spark.read.parquet(f"{path}/terms")}


def test_index_gives_the_lists_of_full_scoring(spark, texts, tmp_path):
    docs = frame(spark, texts, "chunk_id long, text string").repartition(4)
    index = stored(spark, docs, tmp_path)
    questions = [(1, "w1 w40"), (2, "w0 w3 w3 w59"), (3, "w58"), (4, "nothing"), (5, "only"), (6, ""), (7, None), (8, "w10 w20 w30 w50 w55")]
    asked = frame(spark, questions, "query_id long, question string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    whole, quick = rows(retrieve.bm25(docs, asked, 5)), rows(retrieve.bm25(docs, asked, 5, **index))
    assert whole == quick and len(whole) == 40
    plain = sorted(plain_bm25([(i, t or "") for i, t in texts], "w10 w20 w30 w50 w55").items(), key=lambda kv: (-round(kv[1], 6), kv[0]))[:5]
    assert [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == 8] == [i for i, _ in plain]
    assert rows(retrieve.bm25(docs, asked, 5, most=3, **index)) == whole == rows(retrieve.bm25(docs, asked, 5, most=3))


def test_index_blocks_and_what_is_left_out(spark, texts, tmp_path):
    docs = frame(spark, texts, "chunk_id long, text string")
    index = stored(spark, docs, tmp_path)
    table = index["postings"].collect()
    assert all(r.impacts == sorted(r.impacts, reverse=True) and r.most == r.impacts[0] and 0 < len(r.ids) == len(r.impacts) <= postings.BLOCK for r in table)
    held = sorted((r.term, i) for r in table for i in r.ids)
    assert held == sorted({(w, i) for i, t in texts for w in (t or "").split()})
    top = {}
    for r in table:
        top.setdefault(r.term, []).extend(r.impacts)
    for r in index["terms"].collect():
        x = sorted(top[r.term], reverse=True)
        assert r.most == x[0] and r.kth == (x[postings.DEPTH - 1] if len(x) >= postings.DEPTH else None)
    asked = retrieve.asked_terms(frame(spark, [(1, "w1 w45 w45")], "query_id long, question string"))
    found = postings.max_score(index["postings"], index["terms"], asked, ["w1", "w45"], 5).count()
    assert 5 <= found < sum(1 for _, t in texts if {"w1", "w45"} & set((t or "").split())) / 2


def test_index_reads_the_asked_folders_only(spark, texts, tmp_path):
    index = stored(spark, frame(spark, texts, "chunk_id long, text string"), tmp_path)
    part = postings.pruned(index["postings"], ["w3"])
    node = part.where("term = 'w3'")
    node.collect()
    files = {f.split("/bucket=")[1].split("/")[0] for f in node.inputFiles()}
    scan = node._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 1 and scan.metrics().apply("numFiles").value() < len(files)
