"""The queries without SQL, as they are registered, and the pipeline, stage by stage, against plain versions."""

import struct
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quernspark.llm import langid, mixing, packing, queries

from test_operators import DOC, ODD, documents, plain_components, plain_fingerprint, plain_mix, plain_repeats, plain_rule

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held_together(rows, tokens):
    """Pieces (id, start, length, doc_tokens, sequence, offset): all of each document, once, gapless, little padding."""
    by_doc, by_seq = {}, {}
    for i, start, length, total, sequence, offset in rows:
        by_doc.setdefault(i, []).append((start, length))
        by_seq.setdefault(sequence, []).append((offset, length))
        assert total == tokens[i]
    for i, parts in by_doc.items():
        count = sum(n for _, n in parts) // tokens[i]
        assert sorted(parts)[: 1] == [(0, sorted(parts)[0][1])] and sum(n for _, n in parts) == count * tokens[i]
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    return by_doc


def test_op2_ids(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: np.array(plain.encode(t, add_special_tokens=False).ids + [1], dtype="<u4") for i, t in texts.items()}
    rows = queries.QUERIES["op2_pack"](spark, SF).collect()
    held_together([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in rows], {i: len(x) for i, x in ids.items()})
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows) and {r.doc_id for r in rows} == set(texts)


def test_op3_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_urlfilter"](spark, SF).collect()
    assert {r.page_id for r in rows} == set(urls)
    assert all((r.host, r.path, r.rule) == plain_rule(urls[r.page_id]) and r.verdict in ("allow", "block") for r in rows)


def test_op4_whole(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)))
    rows = queries.QUERIES["op4_langid"](spark, SF).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in rows} == {(i, p, round(s, 9)) for i, t in texts.items() for p, s in [model.predict(t)]}


def test_op5_whole(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    rows = queries.QUERIES["op5_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


def test_op6_whole(spark, texts):
    rows = queries.QUERIES["op6_linededup"](spark, SF).collect()
    want = plain_repeats(list(texts.items()))
    for r in rows:
        gone = {n for x in r.removed for n in range(x.lo, x.hi + 1)}
        assert gone <= want[r.doc_id, texts[r.doc_id]] and r.n_removed == len(gone)
        assert r.text.split() == [w for n, w in enumerate(texts[r.doc_id].split()) if n not in gone]
    kept = [(r.doc_id, r.text) for r in rows]
    grams = {}
    for i, t in kept:
        w = t.encode().split()
        for a in range(len(w) - 49):
            assert grams.setdefault(b" ".join(w[a : a + 50]), i) == i
    assert len(rows) == len(texts) and any(r.removed for r in rows)


def test_op8_rendezvous(spark, texts):
    def shard(key, n):
        best = None
        for i in range(n):
            h = 42
            for part in (struct.pack("<q", key), struct.pack("<i", 17), struct.pack("<i", i)):
                h = xxhash.xxh64_intdigest(part, h)
            best = max(best or (-(1 << 64), 0), (h - (1 << 64) * (h >> 63), i))
        return best[1]

    rows = queries.QUERIES["op8_shard"](spark, SF).collect()
    got = {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows}
    assert got == {(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key", shard(i, 16), shard(i, 17)) for i, t in texts.items()}


def test_op10_whole(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows], dtype=object)
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & np.array([r.label is not None for r in rows])[:, None]
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in queries.QUERIES["op10_vectordedup"](spark, SF).collect()}
    n = np.array([got[r.vec_id].n_links for r in rows])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum()
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got.values())


# --- the pipeline

def stages(spark, docs):
    """Rows after each stage, by name."""
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, docs.schema) if (rows := stage(spark, docs, SF).collect()) and name != "packing" else stage(spark, docs, SF)
        out[name] = docs
    return {name: df.collect() for name, df in out.items()}


def test_stages_against_plain_versions(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(5000 + k if i is not None else None, t, "en", s, None if t is None else len(t)) for k, (i, t, s) in enumerate(ODD)]
    base = real.where("n_chars > 900").first().text
    words = base.split(" ")
    near = [(7000 + k, " ".join([*words[:k * 7], f"other{k}", *words[k * 7 + 1 :]]), "en", "near", 1) for k in range(1, 4)]
    docs = real.unionByName(spark.createDataFrame(odd + near, DOC))
    out = stages(spark, docs)
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)))
    told = {t: model.predict(t) for t in {r.text for r in out[""]}}
    assert sorted(map(str, out["language_id"])) == sorted(str(r) for r in out[""] if told[r.text][0] != "und" and told[r.text][1] >= 0.5)

    before, after = out["language_id"], out["line_dedup"]
    gone = plain_repeats([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    for r in before:
        mine = [x.text for x in after if x.doc_id == r.doc_id and x.source == r.source]
        if not gone[r.doc_id, r.text]:
            assert r.text in mine
    assert {r.doc_id for r in before if len(gone[r.doc_id, r.text]) == len(r.text.split())} & {r.doc_id for r in after} == set()

    before, after = after, out["near_dedup"]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.text.lower().split() for r in before)]
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8
    comps = plain_components(list(range(len(before))), alike)
    first = {}
    for k, r in enumerate(before):
        if r.doc_id is not None:
            first[comps[k]] = min(first.get(comps[k], r.doc_id), r.doc_id)
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for k, r in enumerate(before) if r.doc_id is None or first[comps[k]] == r.doc_id)

    before, after = after, out["mixing"]
    size, target = plain_mix([(r.doc_id, r.text, r.source) for r in before])
    taken, most = {}, {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for r in before:
        most[r.source] = max(most.get(r.source, 0), len(r.text.split()))
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert all(abs(taken.get(s, 0) - target[s]) <= 2 * most[s] for s in size)

    encoder = packing.encoder_for(packing.default_vocabulary())
    tokens = {r.doc_id: len(encoder.ids(r.text)) + 1 for r in after}
    parts = held_together([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in out["packing"]], tokens)
    copies = {i: sum(r.doc_id == i for r in after) for i in tokens}
    assert all(sum(n for _, n in parts[i]) == copies[i] * tokens[i] for i in tokens) and set(parts) == set(tokens)


def test_stages_keep_columns_and_take_empty_tables(spark):
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_run_takes_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert mixing.LEVEL_BITS == 12 and all(r.length == len(r.ids) for r in rows)
