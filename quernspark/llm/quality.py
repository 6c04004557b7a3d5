"""Quality rules: base rules on text statistics, then an isolation forest on them.

Every whole text gets the statistics of usual quality rules. Base rules reject short texts and texts
of repeated words. The others are judged by an isolation forest (Liu, Ting and Zhou, 2008): trees of
random splits over FEATURES, shares made from the statistics; a document that few splits isolate is
unlike the rest. Its score is 2 ** (-mean path length / usual path length). Shares are drawn towards
the sample's, by as much as PRIOR words or characters weigh, so that short documents are not odd by
chance. Repeats are left to the base rules: on short documents their shares say little.

The trees are grown from labelled documents, at most about max_train of them, chosen by a hash of
the id; each tree takes PER_TREE of those. The threshold is calibrated on the scores of all labelled
documents that pass the base rules, gathered as a histogram of N_CUTS steps: of the thresholds that
keep at least least_kept of the good ones, the one that finds the most bad ones more than good ones
(by share); of equal ones the highest. Where no threshold finds any, all are kept.

Counts are by hashes of 64 bits of words, windows and lines, within one text.

Defined cases: a null or empty text has no word, zero in each statistic, and fails the base rules;
without labelled rows of both kinds nothing beyond the base rules is rejected; labels that repeat an
id count as often as they stand there, null labels and ids do not count; repeated rows are judged
alike; an empty table gives an empty result; columns of the input may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash
from .words import BYTE, Words, run_hashes, slices, stretch_hashes, text_bytes

MIN_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
MAX_TRAIN, TREES, PER_TREE, N_CUTS, LEAST_KEPT, SEED = 20_000, 200, 64, 2000, 0.998, 12
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
FEATURES = [("n_symbols", "n_words"), ("n_upper", "word_chars"), ("word_chars", "n_words"), ("n_marks", "n_words")]
PRIOR = {"n_words": 100, "word_chars": 500}
_kinds = {"symbols": b"#*$%&|<>", "upper": bytes(range(0x41, 0x5B)), "marks": b".,;:!?"}
_is = {k: np.isin(np.arange(256), list(v)) for k, v in _kinds.items()}


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks are set in each marks[bounds[i]:bounds[i + 1]]."""
    upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _times(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each (owner, hash) is there, whether it is the first one)."""
    order = np.lexsort((hashes, owner))
    own, h = owner[order], hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    times, first = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
    times[order], first[order] = np.repeat(size, size), new  # lexsort is stable
    return times, first


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATISTICS of each text, by name."""
    n = len(texts)
    found = Words(texts)
    data, bounds = found.data, found.bounds
    starts_char = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[found.starts] += 1
    inside[found.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": np.diff(found.first), "word_chars": _sums(starts_char & inside, bounds)}
    out |= {f"n_{k}": _sums(v[data], bounds) for k, v in _is.items()}

    ends = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(bounds, ends, side="right") - 1
    lo, hi = np.concatenate([bounds[:-1], ends + 1]), np.concatenate([ends, bounds[1:]])
    lo, hi, owner = np.sort(lo), np.sort(hi), np.sort(np.concatenate([np.arange(n), owner]))
    upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = upto[hi] > upto[lo]
    lo, hi, owner = lo[full], hi[full], owner[full]
    first = _times(owner, stretch_hashes(data, lo, hi, BYTE))[1]
    out["n_dup_lines"] = np.bincount(owner[~first], minlength=n)

    window = np.flatnonzero(found.whole(WINDOW))
    times = _times(found.text[window], run_hashes(found.hashes(), WINDOW)[window])[0]
    at = window[times > 1]
    repeated = np.zeros(len(found.text), dtype=bool)
    for k in range(WINDOW):
        repeated[at + k] = True
    out["n_repeat_words"] = np.bincount(found.text[repeated], minlength=n)
    return out


def statistics(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(doc_id, STATISTICS) of every document."""
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for i, j in slices(batch["text"]):
                made = text_statistics(batch["text"].slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *[pa.array(made[c].astype(np.int64)) for c in STATISTICS]], ["doc_id", *STATISTICS])

    return base.mapInArrow(make, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATISTICS))


def sample_shares(s: dict[str, np.ndarray]) -> list[float]:
    return [float(np.sum(s[a]) / max(1, np.sum(s[b]))) for a, b in FEATURES]


def features(s: dict[str, np.ndarray], usual: list[float]) -> np.ndarray:
    """FEATURES of rows with STATISTICS, a column each, drawn towards the usual shares."""
    made = [(np.asarray(s[a], dtype=float) + PRIOR[b] * u) / (np.asarray(s[b], dtype=float) + PRIOR[b]) for (a, b), u in zip(FEATURES, usual)]
    return np.column_stack(made)


def usual_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


@dataclass
class Forest:
    """Trees as arrays of nodes: column (-1: a leaf), cut, child (the left one; the right one follows), length of the path to a leaf."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    usual: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; the higher, the fewer splits isolate it."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, cut, child, length in zip(self.column, self.cut, self.child, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := column[node] >= 0).any():
                right = x[rows, column[node]] >= cut[node]
                node = np.where(inner, child[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.column) / self.usual)


def grow(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> Forest:
    """A forest from the rows of x; each tree from per_tree of them, to a depth of log2 per_tree."""
    rng, size = np.random.default_rng(seed), min(per_tree, len(x))
    depth, grown = math.ceil(math.log2(max(size, 2))), []
    for _ in range(trees):
        nodes, work = [[-1, 0.0, 0, 0.0]], [(0, x[rng.permutation(len(x))[:size]], 0)]
        while work:
            at, rows, level = work.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if level == depth or not len(open_):
                nodes[at][3] = level + float(usual_path(len(rows)))
                continue
            column = int(rng.choice(open_))
            cut = float(rng.uniform(low[column], high[column])) or high[column]
            cut = cut if cut > low[column] else float(high[column])  # both sides have a row
            right = rows[:, column] >= cut
            nodes[at] = [column, cut, len(nodes), 0.0]
            work += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        grown.append(nodes)
    columns = [[np.array([node[k] for node in nodes], dtype=kind) for nodes in grown] for k, kind in enumerate((np.int64, float, np.int64, float))]
    return Forest(*columns, usual=max(float(usual_path(size)), 1e-9))


def calibrated(good: np.ndarray, bad: np.ndarray, least_kept: float = LEAST_KEPT) -> float:
    """The threshold from histograms of scores (steps of 1 / (len - 1)); above 1 where none is worth it."""
    over = lambda h: np.append(np.cumsum(h[::-1])[::-1], 0) / max(1, h.sum())
    lost, found = over(good), over(bad)
    worth = np.where(lost <= 1 - least_kept, found - lost, -1.0)
    best = worth.max()
    return (len(worth) - 1 - int(np.argmax(worth[::-1]))) / (len(good) - 1) if best > 0 else 2.0


def with_scores(stats: DataFrame, forest: Forest, usual: list[float]) -> DataFrame:
    """stats with column anomaly."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # at most TREES x 2 PER_TREE nodes
    names = [*stats.columns, "anomaly"]

    def score(batches):
        for batch in batches:
            x = features({c: batch[c].to_numpy() for c in STATISTICS}, usual)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x))], names)

    return stats.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label_key="doc_id", label="quality", max_train: int = MAX_TRAIN, least_kept: float = LEAST_KEPT) -> DataFrame:
    """(doc_id, STATISTICS, base_failed, anomaly, kept) of every document; label is 1 for good documents, 0 for bad ones."""
    stats = stash(statistics(docs, key, text).withColumn("base_failed", base_failed()), "quality")
    told = labels.select(F.col(label_key).alias("doc_id"), F.col(label).cast("int").alias("good")).where("good in (0, 1)")
    known = stash(stats.where("not base_failed").join(told, "doc_id"), "quality")
    n, n_good = known.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not 0 < n_good < n:
        return stats.select("*", F.lit(None).cast("double").alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    picked = known if n <= max_train else known.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    sample = picked.select("doc_id", *STATISTICS).toPandas().sort_values(["doc_id", *STATISTICS])  # about max_train rows
    sample = {c: sample[c].to_numpy() for c in STATISTICS}
    usual = sample_shares(sample)
    forest = grow(features(sample, usual))
    step = F.floor(F.col("anomaly") * N_CUTS).cast("int")
    held = np.zeros((2, N_CUTS + 1), dtype=np.int64)
    for r in with_scores(known, forest, usual).groupBy("good", step.alias("step")).count().collect():  # at most 2 x (N_CUTS + 1) rows
        held[r["good"], r["step"]] = r["count"]
    threshold = calibrated(held[1], held[0], least_kept)
    return with_scores(stats, forest, usual).select("*", (~F.col("base_failed") & (F.col("anomaly") < threshold)).alias("kept"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
