"""The pipeline's near-dedup stage against direct comparison of whole shingle sets."""

import random

import corpus_pipeline
from quernspark.llm import neardup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], DOC)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def copy_at(rng, words, cut):
    """words with spots changed until cut of the shingles are shared with the original (at or just below)."""
    out, old = list(words), shingles(" ".join(words))
    for spot in rng.sample(range(len(words)), len(words)):
        was, out[spot] = out[spot], f"new{rng.randint(0, 10**9)}"
        new = shingles(" ".join(out))
        if len(old & new) / len(old | new) < cut:
            out[spot] = was
            return " ".join(out)


def test_stage_at_the_required_similarity(spark):
    rng, rows = random.Random(4), []
    for i in range(120):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(200, 400))]
        rows += [(i, " ".join(words)), (1000 + i, copy_at(rng, words, (0.8, 0.85, 0.7)[i % 3]))]
    texts = dict(rows)
    like = lambda i: (lambda a, b: len(a & b) / len(a | b))(shingles(texts[i]), shingles(texts[1000 + i]))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect()}
    assert kept == {i for i, _ in rows if i < 1000 or like(i - 1000) < 0.8}
    assert sum(like(i) < 0.8 for i in range(120)) == 40


def test_groups_tiles_and_null_ids(spark):
    """A large group of edited copies, cut into small tiles, and a chain whose middle has no id."""
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(100)]
    for i in range(60):
        edit = list(words)
        for spot in rng.sample(range(100), 2):
            edit[spot] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(edit)))
    far = [f"v{i}" for i in range(100)]
    rows += [(500, " ".join(far)), (None, " ".join(far + [f"x{i}" for i in range(15)])), (501, " ".join(far + [f"x{i}" for i in range(30)]))]
    rows += [(600, "a b"), (601, "A  b"), (602, "a c"), (603, None), (604, "")]
    keys = [i for i, _ in rows]
    label, at = list(range(len(rows))), [shingles(t or "") for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if len(at[a] & at[b]) / len(at[a] | at[b]) >= 0.8:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    want = {k: min(x for x, g in zip(keys, label) if g == own and x is not None) for k, own in zip(keys, label)}
    got = {r.key: r.component for r in neardup.near_components(frame(spark, rows), tile=8).collect()}
    assert got == want and want[501] == 500 and want[604] == 603
    stays = [r.doc_id for r in neardup.keep_one_of_near(frame(spark, rows)).collect()]
    assert sorted(x for x in stays if x is not None) == sorted(set(want.values())) and stays.count(None) == 1
