"""SimHash near-dedup with pivot distance tables.

1. A fingerprint a document: of the hashes of its word shingles, a bit is 1 if set in over half.
2. Equal fingerprints are one node from here on, however many documents share it.
3. The distance table: for each distinct fingerprint the Hamming distances to many fixed reference
   fingerprints, the pivots. Pivots alone give Spark nothing to shuffle by, so pairs come from blocks
   of bits: fingerprints at few differing bits must agree on some blocks, and those are an equality
   key (no pair within max_bits escapes it while blocks - agree >= max_bits).
4. Within a key, rows are sorted by their distance to the first pivot and meet only those within
   max_bits of it; a pair is discarded if its rows in the table differ by more than max_bits in any
   other coordinate (triangle inequality), and the survivors are verified on their bits.
5. Each task returns a spanning forest of what it links, not the pairs; components are joined by
   shuffles. Keys with very many fingerprints are cut into tiles, and each pair of tiles is a group
   of its own, so that no task holds an unbounded group and no pair is lost.

Defined cases: null and empty texts (no words) have fingerprint zero and are linked like any other;
fewer words than a shingle hash as one; rows that repeat an id share one result each; rows with a
null id link others and get their group's component but never name it (null if no row of it has an id). An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, min_labels, stash, text_batches

PIVOTS, PIVOT_SEED, TILE = 16, 20, 4096
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def fingerprint_bytes(text: str | None, shingle: int, words: int) -> bytes:
    """words * 8 bytes, most significant first. The first 8 come from XXH64 (seed 42) as it is; more from mixing it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not tokens:
        return bytes(8 * words)
    parts = [b" ".join(x) for x in zip(*(tokens[i:] for i in range(shingle)))] if len(tokens) >= shingle else [b" ".join(tokens)]
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in parts], dtype=np.uint64)
    out = []
    for w in range(words):
        x = h
        if w:
            x = (h ^ np.uint64(_MIX[w])) * np.uint64(_MIX[0])
            x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[1])
            x = x ^ (x >> np.uint64(29))
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), 65536):  # bounded, however long the text
            part = x[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(x)).tobytes())
    return b"".join(out)


def simhash(text: Column, shingle: int = 3, words: int = 1) -> Column:
    @F.pandas_udf("binary")
    def fingerprints(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fingerprint_bytes(x, shingle, words), na_action=None)

    return fingerprints(text)


def references(words: int) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, (PIVOTS, words), dtype=np.uint64)


def plan_blocks(n: int, max_bits: int) -> tuple[int, int]:
    """(blocks, agree): fewer bits in the key for few fingerprints, more for many; exact at every size."""
    agree = 1 if n < 1 << 24 else 2 if n < 1 << 30 else 3
    return max_bits + agree, agree


def block_keys(word: np.ndarray, blocks: int, agree: int, first: int = 0) -> list[np.ndarray]:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    parts = [(word >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:])]
    width, keys = int(max(np.diff(edges))), []
    for c, chosen in enumerate(combinations(range(blocks), agree)):
        key = np.full(len(word), first + c, dtype=np.uint64)
        for b in chosen:
            key = (key << np.uint64(width)) | parts[b]
        keys.append(key.view(np.int64))
    return keys


def key_rows(nodes: DataFrame, blocks: int, agree: int, words: int, key_words: int) -> DataFrame:
    """A row for each node (fp, rep) and key: key, fp, rep and the node's row of the distance table."""

    def emit(batches):
        refs = references(words)
        for pdf in batches:
            if not len(pdf):
                continue
            fp = np.frombuffer(b"".join(pdf["fp"]), dtype=">u8").astype(np.uint64).reshape(-1, words)
            table = np.minimum(np.bitwise_count(fp[:, None, :] ^ refs[None]).sum(axis=2, dtype=np.int16), 255).astype(np.uint8)  # a cut can only bring distances nearer
            rows = [table[i].tobytes() for i in range(len(fp))]
            first = 0
            for w in range(key_words):
                keys = block_keys(np.ascontiguousarray(fp[:, w]), blocks, agree, first)
                first += len(keys)
                for key in keys:
                    yield pd.DataFrame({"key": key, "fp": pdf["fp"], "rep": pdf["rep"], "distances": rows})

    return nodes.select("fp", "rep").mapInPandas(emit, "key long, fp binary, rep long, distances binary")


def link_sorted(group: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels of rows after linking all pairs of a group within max_bits.

    The first pivot's distance decides who meets whom: rows are sorted by group and that distance, and
    each meets those that follow within max_bits of it. Steps through the pairs 1, 2, ... places apart;
    memory stays near the number of rows.
    """
    order = np.lexsort((table[:, 0], group))
    fp, table, place = fp[order], table[order], (group.astype(np.int64) * 512 + table[:, 0])[order]
    end = np.searchsorted(place, place + max_bits, side="right")  # distances are below 256
    n = len(group)
    labels, at, step = np.arange(n), np.arange(n), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        i = at[labels[at] != labels[at + step]]
        for c in range(1, table.shape[1], 4):  # the widest coordinate difference decides
            i = i[(np.abs(table[i, c : c + 4] - table[i + step, c : c + 4]) <= max_bits).all(axis=1)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]).sum(axis=1) <= max_bits]
        if len(i):
            labels = min_labels(n, labels, i, i + step)
        step += 1
    out = np.empty(n, dtype=np.int64)
    out[order] = order[labels]
    return out


def near_links(keyed: DataFrame, words: int, max_bits: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between reps: a spanning forest of the links within each key."""
    hot = keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    # written first, so that its size is known when Spark chooses the join: a row for each crowded key only
    dealt = keyed.join(stash(hot, "simhash"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "fp", "rep", "distances")
    dealt = dealt.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")

    def link(batches):
        rest = None
        for pdf, last in _with_end(batches):
            rest = pd.concat([x for x in (rest, pdf) if x is not None], ignore_index=True) if pdf is not None else rest
            if rest is None or not len(rest) or (not last and len(rest) < 20_000):
                continue
            ids = rest[["key", "t1", "t2"]].to_numpy()
            new = np.append(True, (ids[1:] != ids[:-1]).any(axis=1))
            stop = len(rest) if last else int(np.flatnonzero(new)[-1])  # the last group may go on
            if not stop:
                continue
            head, rest = rest.iloc[:stop], rest.iloc[stop:]
            fp = np.frombuffer(b"".join(head["fp"]), dtype=">u8").astype(np.uint64).reshape(-1, words)
            table = np.frombuffer(b"".join(head["distances"]), dtype=np.uint8).reshape(-1, PIVOTS).astype(np.int16)
            labels = link_sorted(np.cumsum(new[:stop]), fp, table, max_bits)
            rep = head["rep"].to_numpy()
            apart = labels != np.arange(stop)
            if apart.any():
                yield pd.DataFrame({"a": rep[labels[apart]], "b": rep[apart]})

    return dealt.mapInPandas(link, "a long, b long")


def _with_end(batches):
    for pdf in batches:
        yield pdf, False
    yield None, True


def simhash_components(docs: DataFrame, key="doc_id", text="text", shingle: int = 3, words: int = 1, max_bits: int = 3, blocks: int | None = None, agree: int | None = None, key_words: int = 1) -> DataFrame:
    """(key, fp, component) for every row of docs. Without blocks and agree, no link within max_bits is lost."""
    text_batches(docs.sparkSession)
    slim = stash(docs.select(F.col(key).cast("long").alias("key"), simhash(F.col(text), shingle, words).alias("fp")), "simhash")
    # a node is the fingerprint itself, so that rows without an id link others as well
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if words == 1 else F.xxhash64("fp")
    nodes = stash(slim.groupBy("fp").agg(F.min("key").alias("least")).withColumn("rep", node), "simhash")
    if blocks is None:
        blocks, agree = plan_blocks(nodes.count(), max_bits)
    keyed = key_rows(nodes, blocks, agree, words, key_words)
    comps = connected_components(near_links(keyed, words, max_bits))
    named = nodes.join(comps, nodes["rep"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "rep").alias("name"))
    named = stash(named, "simhash")
    least = named.groupBy("name").agg(F.min("least").alias("component"))
    return slim.join(named.join(least, "name").select("fp", "component"), "fp").select("key", "fp", "component")


def keep_one_of_each(docs: DataFrame, key="doc_id", text="text", shingle: int = 5, **how) -> DataFrame:
    """docs without near copies: of each component the row with the smallest key stays; rows without a key stay."""
    comps = simhash_components(docs, key, text, shingle, **how)
    gone = comps.where("key <> component").select(F.col("key").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs[key] == gone["__gone"], "left_anti")  # never broadcast: it grows with the documents


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    rows = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("key").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
