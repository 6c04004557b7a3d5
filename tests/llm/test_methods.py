"""Whether the results come by the methods: trees that decide, a grid with many cells, fingerprints against plain I-Match."""

import math
import random

import numpy as np
import xxhash
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quernspark.llm import imatch, simhash, urlfilter, vectordedup

from test_operators import documents, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    """The share of pairs (1, 0) in the right order; ties count half."""
    ones, zeros = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])


def test_url_trees_decide(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = urlfilter.with_rates(urlfilter.labelled_urls(pages), 0.4)
    known = rows.where("label is not null")
    model = urlfilter.fit_trees(known, known.count())
    weight = model.featureImportances.toArray()
    assert weight.max() < 0.9 and (weight > 0.01).sum() >= 4
    assert {r.verdict for r in urlfilter.judge_urls(pages).where("rule is null").collect()} == {"allow", "block"}


def test_url_trees_on_hosts_they_have_not_seen(spark):
    rows = urlfilter.with_rates(urlfilter.labelled_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")), 0.4).where("label is not null")
    model = urlfilter.fit_trees(rows.where("fold > 0"), 1000)
    got = model.transform(rows.where("fold = 0")).select("label", vector_to_array("probability")[1].alias("p")).collect()
    assert len(got) > 100 and auc([r.p for r in got], [r.label for r in got]) > 0.7


def test_url_rates_leave_out_the_own_fold(spark):
    """A host that is a suffix of its own: its rows do not see each other's labels."""
    rows = [(i, f"http://h{i % 40}.bad{i % 40}/x{i}") for i in range(400)]
    rules = tuple((f"bad{k}/", "block" if k % 2 else "allow") for k in range(40))
    made = urlfilter.with_rates(urlfilter.labelled_urls(spark.createDataFrame(rows, "page_id long, url string"), rules), 0.5)
    at = urlfilter.FEATURES.index("suffix1_rate")
    assert {r[0] for r in made.select(vector_to_array("features")[at]).collect()} == {0.5}


def test_vectors_on_a_grid_of_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 24))
    x = np.concatenate([np.repeat(centres, 10, 0) + rng.normal(size=(1500, 24)) * 0.09, rng.normal(size=(500, 24)), centres[:1] + rng.normal(size=(1000, 24)) * 0.07, np.repeat(centres[5:6], 60, 0)])
    x = x.astype(np.float32).astype(np.float64)
    label = [0] * len(x)
    made, fit = [], vectordedup.fit
    monkeypatch.setattr(vectordedup, "fit", lambda *a, **b: made.append(fit(*a, **b)) or made[-1])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.key: (r.n_links, r.component) for r in vectordedup.near_vectors(df).collect()}
    assert got == {r.key: (r.n_links, r.component) for r in vectordedup.near_vectors(df, tile=100, block=150).collect()}
    assert len(made[0].first) >= 8 and len(made[0].second) >= 8 and made[0].visits < len(made[0].first) * len(made[0].second)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    n = [got[i][0] for i in range(len(x))]
    assert (np.array(n) <= link.sum(axis=1)).all() and sum(n) >= 0.99 * link.sum() > 0
    want = plain_components(list(range(len(x))), lambda a, b: bool(link[a, b]))
    assert sum(got[i][1] == want[i] for i in want) >= 0.99 * len(x)
    assert len(label) == len(got)


def test_fingerprints_linked_by_rows_without_an_id(spark):
    rng = random.Random(5)
    a = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(400))
    texts = [a, a + " one", a + " one more word", a + " one more word at the end of it"]
    fps = [plain_fingerprint(t) for t in texts]
    rows = [(7, texts[0], None), (None, texts[1], None), (9, texts[2], None), (None, texts[3], None), (None, "q", None)]
    got = simhash.simhash_components(documents(spark, rows)).collect()
    own = dict(enumerate(fps)) | {4: plain_fingerprint("q")}
    want = plain_components(list(own), lambda i, j: (own[i] ^ own[j]).bit_count() <= 3)
    by_fp = {int(r.fp.hex(), 16): r.component for r in got}
    for i, f in own.items():
        ids = [rows[j][0] for j in own if want[j] == want[i] and rows[j][0] is not None]
        assert by_fp[f] == min(ids, default=None)


def plain_imatch(texts, own):
    """(fingerprints of own) by sets and loops: lexicon from texts, subsets nested by trailing zeros."""
    words = lambda t: {xxhash.xxh64_intdigest(w.encode(), 42) for w in imatch._WORD.findall((t or "").lower())}
    df = {}
    for t in texts:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    band = {w >> 40 for w, n in df.items() if n >= 2 and imatch.IDF_LOW <= math.log(len(texts) / n) <= imatch.IDF_HIGH}
    out = []
    for t in own:
        kept = {w for w in words(t) if w >> 40 in band} or words(t)
        sig = []
        for each in range(imatch.EACH):
            def zeros(w):
                x = (w ^ (0x9E3779B97F4A7C15 * (each + 1) % 2**64)) * 0xBF58476D1CE4E5B9 % 2**64
                x ^= x >> 29
                return min(imatch.LEVELS, (x & -x).bit_length() - 1) if x else imatch.LEVELS
            for level in range(imatch.LEVELS):
                # the subset itself, in order: what is hashed
                sig.append(tuple(sorted((w for w in kept if zeros(w) > level), key=lambda w: (-zeros(w), w))))
        out.append(sig)
    return out


def test_imatch_against_plain_sets(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()] + [(9000, None), (9001, "only these"), (9002, "")]
    got = {r.doc_id: r for r in imatch.fingerprint_with_next(documents(spark, [(i, t, None) for i, t in rows])).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    after = [order[(k + 1) % len(order)][1] or "" for k in range(len(order))]
    edited = [imatch.edited_text(t or "", nxt) for (_, t), nxt in zip(order, after)]
    every = [t for _, t in order]
    sets, new = plain_imatch(every, every), plain_imatch(every, edited)
    like = lambda a, b: (lambda used: sum(x == y for x, y in used) / len(used) if used else 1.0)([(x, y) for x, y in zip(a, b) if x or y])
    names = {}
    for k, (i, _) in enumerate(order):
        assert abs(got[i].near_edited - like(sets[k], new[k])) < 1e-9
        assert abs(got[i].near_next - like(sets[k], sets[(k + 1) % len(order)])) < 1e-9
        for fingerprint, subsets in ((got[i].fingerprint, sets[k]), (got[i].edited_fingerprint, new[k])):
            for s, subset in enumerate(subsets):
                part = fingerprint[4 * s : 4 * s + 4]
                assert (part == "0000") == (not subset) and names.setdefault((s, subset), part) == part


def test_imatch_splits_one_id_that_has_all_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = documents(spark, [(5 if i % 3 else i, f"text number {i}", None) for i in range(3000)])
        dealt = imatch.with_next(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in dealt) < 3 * 3000 / len(dealt)
