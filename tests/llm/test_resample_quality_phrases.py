"""Importance resampling, quality rules and phrases against plain versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernspark.llm import phrases, quality, queries, resample

DOC = "doc_id long, text string, lang string, rank int, score string, n int, row int, words string"
LONG = "naïve " * 3 + "x" * 70_000 + " " + "pq " * 40_000
ODD = [None, "", " \t\n", "…!?", "ÄÖ é ß", "a b c a b c", LONG, "The CAT\nthe cat\n\nthe cat, sat; on. it", "0" * 127 + " " + "1" * 128 + " " + "2" * 129 + " " + "é" * 300]


def table(spark, rows):
    """Rows (doc_id, text, lang) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, 1, "s", 2, 3, "w") for i, t, g in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "of", "Cat", "dog", "tree", "ümlaut", "x1", "run"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    made = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate([*ODD, *texts])]
    return [*made, made[20], (20, "another text under the same id " * 8, "en"), (None, texts[3], "und"), (None, None, None)]


def test_span_crcs():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(60_000), dtype=np.uint8)
    lo = np.array([rng.randrange(20_000) for _ in range(600)])
    hi = lo + np.array([rng.choice([1, 2, 3, 4, 127, 128, 129, 255, 256, 257, 5000, 40_000]) for _ in range(600)])
    assert resample.span_crcs(data, lo, hi).tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(lo, hi)]
    assert len(resample.span_crcs(data, lo[:0], hi[:0])) == 0


@pytest.mark.parametrize("max_n", [1, 3])
def test_features_of_runs(max_n):
    texts = [None, "", "One two\nthree", "é" * 200 + " b"]
    bucket, owner, words = resample.feature_buckets(pa.array(texts), max_n)
    want = []
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        want += [(k, zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted(want) and words.tolist() == [0, 0, 3, 2]


def plain_resample(docs, target):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = lambda t: [zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))]
    s, t = Counter(b for _, x, _ in docs for b in found(x)), Counter(b for x in target for b in found(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000) / ((s[b] + 1.0) * (n_t + 10_000))))
    out = []
    for i, x, _ in docs:
        f = found(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_resample(spark, rows):
    target = ["the cat", None, "tree tree"]
    want = plain_resample(rows, target)
    got = resample.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    most = sum(n >= 20 for _, n, _, _ in want) * 10 // 100
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    best = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:most]
    assert [r["rank"] for r in ranked] == list(range(1, most + 1)) and [(r.score, r.doc_id) for r in ranked] == [(r[3], r[0]) for r in best]


def test_resample_ties_and_empty(spark):
    same = [(5, "a b c " * 10, "en")] * 30
    ranks = [r["rank"] for r in resample.resample(table(spark, same), spark.createDataFrame([], "text string")).collect()]
    assert sorted(x for x in ranks if x) == [1, 2, 3] and len(ranks) == 30
    assert resample.resample(table(spark, []), table(spark, same)).count() == 0
    assert {r["rank"] for r in resample.resample(table(spark, same[:9]), table(spark, [])).collect()} == {None}


def plain_statistics(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    marks = lambda p: len(re.findall(p, text))
    return (len(words), sum(map(len, words)), marks(r"[#*$%&|<>]"), dup, len(twice), marks("[A-Z]"), marks("[.,;:!?]"))


def test_statistics(rows):
    rng = random.Random(3)
    texts = [t for _, t, _ in rows] + ["".join(rng.choice("ab \n\té#\r") for _ in range(rng.randrange(90))) for _ in range(400)]
    got = quality.text_statistics(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in quality.STATISTICS])) == [plain_statistics(t) for t in texts]


def plain_score(forest, row):
    """The mean path of one row, walked node by node."""
    total = 0.0
    for column, cut, child, length in zip(forest.column, forest.cut, forest.child, forest.length):
        node = 0
        while column[node] >= 0:
            node = child[node] + int(row[column[node]] >= cut[node])
        total += length[node]
    return 2.0 ** (-total / len(forest.column) / forest.usual)


def test_forest():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(7, 1, size=(8, 3)), np.zeros((5, 3))])
    forest = quality.grow(x)
    scores = forest.scores(x)
    assert np.allclose(scores, [plain_score(forest, r) for r in x]) and scores[400:408].min() > np.quantile(scores[:400], 0.97)
    assert all(len(np.unique(c)) for c in forest.child) and quality.grow(np.ones((4, 2))).scores(np.ones((2, 2))).shape == (2,)


def test_calibrated():
    good, bad = np.zeros(11, int), np.zeros(11, int)
    good[[2, 9]], bad[[3, 8, 10]] = [99, 1], [2, 5, 3]
    assert quality.calibrated(good, bad, 0.99) == 0.3 and quality.calibrated(good, bad, 1.0) == 1.0
    assert quality.calibrated(good, np.zeros(11, int)) == 2.0


def test_op12_whole(spark):
    """The registered query against plain statistics and plain walks of its own forest; most junk goes, clean documents stay."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op12_quality"](spark, sf).collect()}
    assert set(got) == set(texts)
    stats = {i: plain_statistics(t) for i, t in texts.items()}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    assert all(tuple(got[i][c] for c in quality.STATISTICS) == stats[i] and got[i].base_failed == failed[i] for i in texts)
    train = sorted((i, *stats[i]) for i in good if i in stats and not failed[i])
    sample = {c: np.array([r[k + 1] for r in train]) for k, c in enumerate(quality.STATISTICS)}
    usual = quality.sample_shares(sample)
    forest = quality.grow(quality.features(sample, usual))
    rows = {i: quality.features({c: [s[k]] for k, c in enumerate(quality.STATISTICS)}, usual)[0] for i, s in stats.items()}
    scores = {i: plain_score(forest, rows[i]) for i in texts}
    assert all(abs(got[i].anomaly - scores[i]) < 1e-9 for i in texts)
    cut = min([scores[i] for i in texts if not failed[i] and not got[i].kept], default=2.0)
    assert all(got[i].kept == (not failed[i] and scores[i] < cut) for i in texts)
    kept = lambda q: np.mean([got[i].kept for i in good if good[i] == q and not failed[i]])
    assert kept(1) >= 0.99 and kept(0) <= 0.4


def test_quality_cases(spark, rows):
    docs = table(spark, rows)
    told = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    got = quality.judge_quality(docs, told).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, plain_statistics(t)[0]) for i, t, _ in rows)
    assert all(not r.kept for r in got if r.base_failed)
    none = quality.judge_quality(docs, told.where("quality = 1")).collect()
    assert all(r.kept == (not r.base_failed) and r.anomaly is None for r in none)
    assert quality.judge_quality(table(spark, []), told).count() == 0


def plain_phrases(docs, most=2000, least=10, deep=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for _, t, g in docs:
        g = g or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[g] += len(w)
            f.update((g, *w[i : i + n]) for n in range(1, deep + 1) for i in range(len(w) - n + 1))
    out = {}
    held = {k: n for k, n in f.items() if len(k) > 2 and n >= least}
    for k, a in held.items():
        g, w = k[0], k[1:]
        if any(100 * n >= 50 * a and m[0] == g and len(m) > len(k) and any(m[1:][i : i + len(w)] == w for i in range(len(m) - 1)) for m, n in held.items()):
            continue
        cut = min((1_000_000 * a * a // (f[g, *w[:c]] * f[g, *w[c:]]), c) for c in range(1, len(w)))
        l, r = f[g, *w[: cut[1]]], f[g, *w[cut[1] :]]
        out.setdefault(g, []).append((-cut[0], -a, " ".join(w).encode(), l, r))
    return {(g, k + 1, p.decode(), -a, l, r, total[g], -s) for g, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:most])}


@pytest.mark.parametrize("deep,top", [(3, 2000), (2, 5), (5, 40)])
def test_phrases(spark, rows, deep, top):
    docs = [(i, t if t is not LONG else LONG[:-100_000], g) for i, t, g in rows]
    got = phrases.collocations(table(spark, docs).repartition(5), max_words=deep, top=top).collect()
    want = plain_phrases(docs, most=top, deep=deep)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_phrases_empty(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_quicksort():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 6, size=(3, 500))
    codes[2, rng.random(500) < 0.3] = -1
    n = rng.integers(1, 5, size=500)
    want = Counter()
    for k in range(500):
        for d in range(1, 4):
            if codes[d - 1, k] >= 0:
                want[tuple(codes[:d, k].tolist())] += int(n[k])
    got = {tuple(codes[:d, k].tolist()): c for at, depth, count in phrases.quicksort(codes, n, 9) for k, d, c in zip(at.tolist(), depth.tolist(), count.tolist())}
    assert got == {k: c for k, c in want.items() if c >= 9}
