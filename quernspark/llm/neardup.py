"""Near-dedup: SimHash with pivot distance tables and MinHash bands find the candidates, whole shingle sets judge them.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least
threshold. Of each set 144 minima are taken; 24 keys of six minima each meet a pair at similarity s
with a probability of 1 - (1 - s^6)^24: 99.9 % at 0.8, more above. Nothing is linked by an estimate.

1. Equal sets are one node from here on, however many documents share it.
2. SimHash with pivot distance tables, as in simhash.py, on the nodes' fingerprints: it proposes all that differ in
   at most BITS bits. A similarity of 0.8 is about ten bits of 64, so the steps after it meet what lies further apart.
3. Keys held by one node only go. In each of a few rounds every node meets one node of another
   component within its keys, so that a large group of copies is linked by about as many pairs as
   it has nodes.
4. Whatever still shares a key and lies in different components is then met in full: crowded keys
   are cut into tiles, and each pair of tiles is a group of its own. Pairs whose minima agree far
   less than threshold asks (six standard deviations) are not looked at further.
5. Each proposed pair is verified on both whole sets before it counts as a link.

Defined cases: null texts and texts without words are one node; fewer words than a shingle count as
one shingle; rows with a null key stay, and link others, but never name a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import connected_components, frame_of, stash, text_batches, text_key, whole_number

BANDS, ROWS, TILE, ROUNDS = 24, 6, 2048, 2
BITS = 3
_ODD = np.random.default_rng(11).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_XOR = np.random.default_rng(12).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are cut as in simhash.fingerprint_bytes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))) if len(tokens) >= shingle else [b" ".join(tokens)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in parts], dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(_ODD), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 512):  # bounded, however long the text
        x = (hashes[at : at + 512, None] ^ _XOR) * _ODD
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    """A bit is 1 if set in over half the hashes of a set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that link nodes (node, fp) with at most BITS differing bits, by pivot distance tables."""
    same = stash(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "neardup")  # a row for each different fingerprint
    blocks, agree = simhash.plan_blocks(same.count(), BITS)
    pairs = simhash.near_links(simhash.key_rows(same, blocks, agree, 1, 1), 1, BITS)
    equal = nodes.select("fp", "node").join(same.hint("merge"), "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = pairs.unionByName(equal)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def least_agreeing(threshold: float) -> int:
    n = BANDS * ROWS
    return max(0, int(n * threshold - 6 * (n * threshold * (1 - threshold)) ** 0.5))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, th, node, size, bands, sketch) of each row (key, text): sketch has the last 8 bits of each minimum."""

    def make(batches):
        for pdf in batches:
            rows = []
            for key, th, text in zip(pdf["key"], pdf["th"], pdf["text"]):
                found = shingle_set(text, shingle)
                low = minima(found)
                bands = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
                node = np.array([xxhash.xxh3_64_intdigest(found.tobytes())], dtype=np.uint64).view(np.int64)[0]
                rows.append((whole_number(key), th, node, len(found), np.array(bands, dtype=np.uint64).view(np.int64), low.astype(np.uint8).tobytes(), fingerprint(found)))
            yield frame_of(rows, schema)

    schema = "key long, th long, node long, size int, bands array<long>, sketch binary, fp binary"
    return docs.select(F.col("key").cast("string").alias("key"), "th", "text").mapInPandas(make, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of each row (node, key, th) of wanted, from the text of that row."""
    asked = wanted.select("node", F.col("key").alias("a_key"), F.col("th").alias("a_th"))
    met = docs.join(asked.hint("merge"), (F.col("th") == F.col("a_th")) & F.col("key").eqNullSafe(F.col("a_key"))).select("node", "text")

    def make(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "hashes": [shingle_set(t, shingle).tobytes() for t in pdf["text"]]})

    # rows that repeat a key and a text answer alike
    return met.mapInPandas(make, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= threshold for a, b in zip(x, y)], dtype=bool)

    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")).hint("merge") for c in "ab")
    return pairs.join(one, "a").join(two, "b").where(alike("set_a", "set_b")).select("a", "b")


def met_in_full(rows: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key and lie in different components.

    rows: key, node, component, size, sketch. Sizes too far apart rule a pair out exactly.
    """
    hot = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = rows.join(stash(hot, "neardup"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "node", "component", "size", "sketch")
    dealt = dealt.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    least = least_agreeing(threshold)

    def compare(group):
        node, comp, size = (group[c].to_numpy() for c in ("node", "component", "size"))
        sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(group), -1)
        for i in range(len(group) - 1):
            j = np.arange(i + 1, len(group))
            near = (comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]))
            j = j[near]
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
            if len(j):
                yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    def pairs(batches):
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ids = rest[["key", "t1", "t2"]].to_numpy()
            new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
            for a, b in zip(new, new[1:]):
                yield from compare(rest.iloc[a:b])
            rest = rest.iloc[new[-1] :] if len(new) else None  # the last group may go on
        if rest is not None:
            yield from compare(rest)

    return dealt.mapInPandas(pairs, "a long, b long").distinct()


def near_components(docs: DataFrame, key="doc_id", text="text", shingle: int = 5, threshold: float = 0.8, tile: int = TILE) -> DataFrame:
    """(key, th, component) of every row of docs; component is the least key of the near copies, null if none has one."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("key"), text_key(docs[text]).alias("th"), F.col(text).alias("text"))
    slim = stash(sketches(base, shingle), "neardup")
    spot = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("spot")
    nodes = stash(slim.groupBy("node").agg(spot, *[F.first(c).alias(c) for c in ("size", "bands", "sketch", "fp")]), "neardup")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    members = stash(keyed.join(shared.hint("merge"), "key"), "neardup")  # (key, node)
    close = stash(close_fingerprints(nodes), "neardup")
    met = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = nodes.join(met.hint("merge"), "node", "left_semi").select("node", "spot.key", "spot.th")
    sets = stash(whole_sets(base, wanted, shingle), "neardup")

    edges = comps = None

    def open_keys(seed):
        """Members with their components, and the keys that hold several, with two of their nodes."""
        now = members.withColumn("component", F.col("node"))
        if comps is not None:
            now = members.join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        now = stash(now.select("key", "node", "component"), "neardup")
        end = F.struct(F.xxhash64("component", F.lit(seed)).alias("h"), "component", "node")
        return now, stash(now.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.component <> hi.component"), "neardup")

    def link(pairs):
        nonlocal edges, comps
        found = stash(verified(pairs, sets, threshold), "neardup")
        if found.isEmpty():
            return False
        edges = found if edges is None else edges.unionByName(found)
        comps = stash(connected_components(edges), "neardup")
        return True

    link(close)
    for seed in range(ROUNDS + 1):
        now, ends = open_keys(seed)
        if ends.isEmpty():
            break
        if seed == ROUNDS:
            rows = now.join(ends.select("key").hint("merge"), "key").join(nodes.select("node", "size", "sketch").hint("merge"), "node")
            link(stash(met_in_full(rows, threshold, tile), "neardup"))
            break
        other = F.when(F.col("component") == F.col("lo.component"), F.col("hi.node")).otherwise(F.col("lo.node"))
        one = now.join(ends.hint("merge"), "key").select("node", other.alias("other"))
        one = one.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "other", F.lit(seed)), "other")).alias("o")).select("node", "o.other")
        link(stash(one.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "neardup"))

    named = nodes.select("node", F.col("spot.key").alias("rep"), F.col("node").alias("component"))
    if comps is not None:
        named = nodes.select("node", F.col("spot.key").alias("rep")).join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        names = named.groupBy("component").agg(F.min("rep").alias("name"))
        named = named.join(names.hint("merge"), "component").select("node", F.col("name").alias("component"))
    else:
        named = named.select("node", F.col("rep").alias("component"))
    return slim.select("key", "th", "node").join(named.hint("merge"), "node").select("key", "th", "component")


def keep_one_of_near(docs: DataFrame, key="doc_id", text="text", **how) -> DataFrame:
    """docs without near copies: of each component the row with the smallest key stays; rows without a key stay."""
    gone = near_components(docs, key, text, **how).where("key <> component").select(F.col("key").alias("__gone"), F.col("th").alias("__th")).distinct()
    return docs.join(gone.hint("merge"), (docs[key] == gone["__gone"]) & (text_key(docs[text]) == gone["__th"]), "left_anti")
