"""Embedding near-dedup with an inverted multi-index.

Two independent codebooks, one for each half of the vectors, form a product grid. A vector lies in
the cell of its nearest two codewords. To find its neighbours it visits cells in the order of the
multi-sequence traversal, i.e. by the sum of the two halves' squared distances, as many as a
calibration on the fitting sample needs for the target recall (LEAST_VISITS at least), and verifies the cosine in double
precision. Only vectors with the same label are compared.

Equal vectors of a label are one from here on, with their number. Codebooks are fitted on at most
SAMPLE of these, chosen by a hash; every vector is indexed and every vector asks. Before the codebooks
are fitted the sample is thinned: of vectors that link with each other one stays, so that a large group
of near copies takes few codewords. The number of codewords follows the number of vectors, so that a
cell's expected size stays the same (CELL), up to MAX_CODES codewords a half.

The visits are calibrated against all vectors: about ASKERS of them, chosen by a hash, are sent to every
task and held against every vector of their labels by brute force. For each link it is known how many
cells the asker visits until it comes to it; each asker has the same weight, and there is no cap on the
visits but the number of cells. As links may be rare, each asker also gets a made neighbour at the
threshold itself, in a random direction, the farthest that counts; the visits that find target_recall of
both are taken. The recall that was measured is logged.

Cells with very many vectors are cut into tiles, those with very many askers into blocks, and each block
meets each tile in a group of its own: groups are bounded and no pair is lost. A group returns counts and
a spanning forest of its links, never the pairs.

Defined cases: vectors that are null, zero, of a wrong length, or hold null or non-finite
components link with nothing, nor do those with a null label. Rows that repeat a vec_id are one vector
(the least by label and components of those that can link). Each row with a null vec_id is a vector
without links. Equal vectors link.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, min_labels, stash

SAMPLE, ASKERS, CELL, TILE, BLOCK, LEAST_CODES, MAX_CODES, LEAST_VISITS = 20_000, 1000, 16, 2048, 4096, 4, 2048, 4


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits
        self.half = first.shape[1]

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells that each row of x visits, nearest first.

        Of the v nearest cells each half's codeword has a rank of at most v, and the product of the
        ranks is at most v; sorting those few sums gives the order of the multi-sequence traversal.
        """
        v = min(visits or self.visits, len(self.first) * len(self.second))
        d1, d2 = squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)
        o1, o2 = np.argsort(d1, 1, kind="stable")[:, :v], np.argsort(d2, 1, kind="stable")[:, :v]
        ranks = [(i, j) for i in range(o1.shape[1]) for j in range(o2.shape[1]) if (i + 1) * (j + 1) <= v]
        i, j = np.array(ranks).T
        a, b = np.take_along_axis(o1, np.broadcast_to(i, (len(x), len(i))), 1), np.take_along_axis(o2, np.broadcast_to(j, (len(x), len(j))), 1)
        total = np.take_along_axis(d1, a, 1) + np.take_along_axis(d2, b, 1)
        best = np.argsort(total, 1, kind="stable")[:, :v]
        return np.take_along_axis(a * len(self.second) + b, best, 1)


def thinned(sample: np.ndarray, labels: np.ndarray, threshold: float) -> np.ndarray:
    """Of the vectors of a label that link with each other about one, in the order of the sample."""
    out = []
    for name in np.unique(labels):
        x = sample[labels == name]
        kept = x[:0]
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            part = part[~(part @ kept.T >= threshold).any(axis=1)]
            kept = np.concatenate([kept, part[~np.tril(part @ part.T >= threshold, -1).any(axis=1)]])
        out.append(kept)
    return np.concatenate(out)


def visits_until(index: MultiIndex, asker: np.ndarray, met: np.ndarray) -> np.ndarray:
    """How many cells each asker visits until it comes to the cell in which the vector met lies."""
    half, out = index.half, []
    for at in range(0, len(asker), 256):
        x, y = asker[at : at + 256], met[at : at + 256]
        d1, d2 = squared(x[:, :half], index.first), squared(x[:, half:], index.second)
        c1, c2 = nearest(y[:, :half], index.first), nearest(y[:, half:], index.second)
        rows = np.arange(len(x))
        bound = d1[rows, c1] + d2[rows, c2]
        d2.sort(axis=1)
        out += [int(np.searchsorted(b, t - a + 1e-12, side="right").sum()) for a, b, t in zip(d1, d2, bound)]
    return np.array(out, dtype=np.int64)


def fit(sample: np.ndarray, labels: np.ndarray, n: int, n_labels: int, threshold: float, seed: int = 5) -> MultiIndex:
    """Codebooks for n vectors; the visits are still to be calibrated."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    thin = thinned(sample, labels, threshold)
    codes = int(np.clip(np.ceil(np.sqrt(n / max(1, n_labels) / CELL)), LEAST_CODES, MAX_CODES))
    codes, half = min(codes, len(thin)), (dim + 1) // 2
    return MultiIndex(kmeans(thin[:, :half], codes, rng), kmeans(thin[:, half:], codes, rng), LEAST_VISITS)


def rounded_up(rank: np.ndarray) -> np.ndarray:
    """The next of few numbers (8 to each doubling), so that a histogram of ranks is small."""
    return np.ceil(2.0 ** (np.ceil(8 * np.log2(np.maximum(rank, 1)) - 1e-9) / 8)).astype(np.int64)


def enough_visits(rank: np.ndarray, weight: np.ndarray, target: float) -> int:
    """How many cells must be visited so that links of target of all weight are found."""
    order = np.argsort(rank, kind="stable")
    reached = np.cumsum(weight[order]) / weight.sum()
    return int(rank[order][min(len(rank) - 1, int(np.searchsorted(reached, target - 1e-12)))])


def calibrated(good: DataFrame, index: MultiIndex, n: int, dim: int, threshold: float, target: float, seed: int = 5) -> MultiIndex:
    """index with the visits that find target of the links of about ASKERS vectors among all rows of good."""
    spark = good.sparkSession
    asking = good.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, ASKERS / n))).select("key", "label", "v").toPandas()
    if not len(asking):
        return index
    a, keys, labels = unit(np.array(asking["v"].tolist(), dtype=np.float64).reshape(-1, dim)), asking["key"].to_numpy(), asking["label"].to_numpy()
    shared = spark.sparkContext.broadcast((index, a, keys, labels))

    def meet(batches):
        index, a, keys, labels = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, half = unit(np.array(pdf["v"].tolist(), dtype=np.float64)), index.half
            cell = nearest(x[:, :half], index.first) * len(index.second) + nearest(x[:, half:], index.second)
            seen = []
            for at in range(0, len(x), 2048):
                part = slice(at, at + 2048)
                i, j = np.nonzero((a @ x[part].T >= threshold) & (labels[:, None] == pdf["label"].to_numpy()[part][None]) & (keys[:, None] != pdf["key"].to_numpy()[part][None]))
                seen.append(np.unique(i * (len(index.first) * len(index.second)) + cell[at + j], return_counts=True))
            met, at = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
            if len(met):
                i, c = np.divmod(met, len(index.first) * len(index.second))
                centre = np.concatenate([index.first[c // len(index.second)], index.second[c % len(index.second)]], axis=1)
                yield pd.DataFrame({"asker": i, "rank": rounded_up(visits_until(index, a[i], centre)), "n": np.bincount(at, np.concatenate([n for _, n in seen])).astype(np.int64)})

    found = good.mapInPandas(meet, "asker long, rank long, n long").groupBy("asker", "rank").agg(F.sum("n").alias("n")).toPandas()  # a few numbers an asker
    rng = np.random.default_rng(seed)
    far = rng.normal(size=a.shape)
    far -= (far * a).sum(axis=1, keepdims=True) * a
    made = visits_until(index, a, threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * far / np.maximum(np.sqrt((far * far).sum(axis=1, keepdims=True)), 1e-12))
    visits = enough_visits(made, np.ones(len(made)), target)
    if len(found):
        rank, total = found["rank"].to_numpy(), found.groupby("asker")["n"].transform("sum").to_numpy()
        weight = found["n"].to_numpy() / total
        visits = max(visits, enough_visits(rank, weight, target))
    index.visits = int(np.clip(visits, LEAST_VISITS, len(index.first) * len(index.second)))
    seen = f"{weight[rank <= index.visits].sum() / weight.sum():.4f} of the links of {found['asker'].nunique()} askers" if len(found) else "no link of an asker"
    logging.getLogger(__name__).info("%d of %d cells are visited; that finds %s", index.visits, len(index.first) * len(index.second), seen)
    return index


def near_vectors(vectors: DataFrame, key="vec_id", vector="embedding", label="label", threshold: float = 0.98, target_recall: float = 0.999, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component) of every distinct key, and of each row without a key."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    dims = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    odd = ~F.coalesce(F.col("label").isNotNull() & (F.size("v") == dim) & fine, F.lit(False))
    alone = rows.where("key is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    rows = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(odd.alias("odd"), "label", "v")).alias("r"))
    rows = stash(rows.select("key", "r.odd", "r.label", "r.v"), "vectors")
    # equal vectors are one, under the least key; the others take over its links
    good = stash(rows.where("not odd").groupBy("label", "v").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "vectors")
    n, n_labels = good.agg(F.count("*"), F.countDistinct("label")).first()
    if not n:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component")).unionByName(alone)
    part = good.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))) if n > SAMPLE else good
    got = part.select("label", "v").toPandas()
    sample = unit(np.array(got["v"].tolist(), dtype=np.float64).reshape(-1, dim))
    index = calibrated(good, fit(sample, got["label"].to_numpy(), n, n_labels, threshold), n, dim, threshold, target_recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of at most MAX_CODES words

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=np.float64)
                cells = shared.value.cells(unit(x))
                yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "copies": pdf["copies"], "cells": list(cells.astype(np.int64)), "v": [r.tobytes() for r in x]})

    placed = stash(good.mapInPandas(place, "key long, label string, copies long, cells array<long>, v binary"), "vectors")
    own = placed.withColumn("cell", F.col("cells")[0])
    asking = placed.withColumn("cell", F.explode("cells"))
    crowd = asking.groupBy("label", "cell").agg(F.count("*").alias("a")).join(own.groupBy("label", "cell").agg(F.count("*").alias("m")), ["label", "cell"], "left")
    many = lambda c, most: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    crowd = crowd.where((F.col("a") > block) | (F.col("m") > tile)).select("label", "cell", many("m", tile).alias("tiles"), many("a", block).alias("blocks"))
    crowd = stash(crowd, "vectors")

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """A row lies in one tile of its cell (a member) or in one block (an asker), and goes to every block or tile there."""
        df = df.join(crowd, ["label", "cell"], "left").withColumn("asks", F.lit(asks))
        one, all_of = ("block", "tile") if asks else ("tile", "block")
        df = df.withColumn(one, F.pmod(F.xxhash64("key"), F.coalesce(f"{one}s", F.lit(1))).cast("int"))
        return df.withColumn(all_of, F.explode(F.sequence(F.lit(0), F.coalesce(f"{all_of}s", F.lit(1)) - 1))).drop("tiles", "blocks")

    both = dealt(own, False).unionByName(dealt(asking, True))
    group = ("label", "cell", "tile", "block")
    both = both.repartition(*group).sortWithinPartitions(*group, "asks")

    def verify(batches):
        """Rows come by group, members first; askers are taken against them in blocks."""
        group, known, waiting = None, [], []
        for pdf in batches:
            names = list(zip(pdf["label"], pdf["cell"], pdf["tile"], pdf["block"]))
            new = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for i, stop in zip(new, [*new[1:], len(names)]):
                if names[i] != group:
                    if group is not None:
                        yield from compare(group[1], known, waiting)
                    group, known, waiting = names[i], [], []
                part = pdf.iloc[i:stop]
                known.append(part[~part["asks"]])
                waiting.append(part[part["asks"]])
                if sum(map(len, waiting)) > 4096:
                    yield from compare(group[1], known, waiting)
                    waiting = []
        if group is not None:
            yield from compare(group[1], known, waiting)

    def compare(cell, known, waiting):
        known, waiting = (pd.concat(x) if x else None for x in (known, waiting))
        if known is None or waiting is None or not len(known) or not len(waiting):
            return
        m, a = (np.frombuffer(b"".join(x["v"]), dtype=np.float64).reshape(-1, dim) for x in (known, waiting))
        mk, ak = known["key"].to_numpy(), waiting["key"].to_numpy()
        mc, ac = known["copies"].to_numpy(), waiting["copies"].to_numpy()
        m, a = unit(m), unit(a)
        back = np.array(known["cells"].tolist())  # cells that the members themselves visit
        home = np.array([c[0] for c in waiting["cells"]])
        keys = np.concatenate([mk, ak])
        links, labels = np.zeros(len(keys), dtype=np.int64), None
        for at in range(0, len(a), 512):
            i, j = np.nonzero(a[at : at + 512] @ m.T >= threshold)
            i += at
            other = ak[i] != mk[j]
            i, j = i[other], j[other]
            np.add.at(links, len(mk) + i, mc[j])
            one_way = ~(back[j] == home[i][:, None]).any(axis=1) if len(i) else np.empty(0, bool)
            np.add.at(links, j[one_way], ac[i[one_way]])  # the member does not ask in the asker's cell, so it counts here
            labels = min_labels(len(keys), labels, len(mk) + i, j) if len(i) else labels
        if labels is None:
            return
        touched = np.flatnonzero((links > 0) | (labels != np.arange(len(keys))) | np.isin(np.arange(len(keys)), labels[labels != np.arange(len(keys))]))
        yield pd.DataFrame({"key": keys[touched], "links": links[touched], "to": keys[labels[touched]]})

    found = stash(both.mapInPandas(verify, "key long, links long, to long"), "vectors")
    comps = connected_components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links")).join(comps.withColumnRenamed("node", "key"), "key", "left")
    links = good.where("copies > 1").select("key", "copies").join(links, "key", "full")
    links = stash(links.select(F.col("key").alias("least"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"), F.coalesce("component", "key").alias("component")), "vectors")
    own = good.where("copies > 1").select("label", "v", F.col("key").alias("least"))
    out = rows.join(stash(own, "vectors"), ["label", "v"], "left").select("key", F.coalesce(F.when(~F.col("odd"), F.col("least")), "key").alias("least"))
    out = out.join(links, "least", "left").select("key", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component"))
    return out.unionByName(alone)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else very large or small components overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def op10_vectordedup(spark, sf_dir: str) -> DataFrame:
    rows = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
