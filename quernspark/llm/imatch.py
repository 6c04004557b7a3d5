"""Document fingerprints by I-Match.

The terms of a document whose inverse document frequency lies in a band are kept; the distinct ones
are sorted and hashed, once for each of several randomised subsets of the lexicon. The subsets
differ in how many terms they keep (from a half to one in 4096, eight of each), so that short and
long documents both have subsets with few of their terms; the eight are families of nested subsets,
and terms are sorted by the smallest subset that holds them, then by hash. Two fingerprints are
alike to the degree that the hashes of subsets agree, of those subsets in which either has a term.

Document frequencies are counted over all documents, by 64-bit hashes of terms. The band has two
ends: idf (natural log) from idf_low to idf_high, and at least min_docs documents. A term inside is
in at least n * exp(-idf_high) of n documents, so the band has at most exp(idf_high) = 100,000 times
as many terms as a document has on average, however many documents there are. It is sent to the
executors as a filter of at least 16 bits a term, 2 MB to 32 MB: up to 16.8 million terms at most one
rarer term in 16 is taken for one inside (at 30 million: one in 9). That is so in every document
alike: equal texts stay equal. With no term in the band, all terms of a text are kept.

Defined cases: null and empty texts have no term, and fingerprints of their own kind: alike 1.0 to
each other, 0.0 to others. Documents are ordered by id (null ids last) and, for equal ids, by a hash
of the text; repeated rows stay rows of their own. A single document is its own next one. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash, text_key
from .words import slices, stretch_hashes

TERM_BITS, MOST_BITS, LEVELS, EACH = 24, 28, 12, 8
SUBSETS = LEVELS * EACH
IDF_LOW, IDF_HIGH, MIN_DOCS = 2.0, math.log(100_000), 2
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """64-bit hashes of terms, of the first 300,000 met in a worker; it changes no result."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        if len(self) < 300_000:
            self[word] = found
        return found


_hash_of = _Hashes().__getitem__


def distinct_terms(text: str | None) -> np.ndarray:
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.fromiter(map(_hash_of, words), dtype=np.uint64, count=len(words))


def terms(text: str | None) -> np.ndarray:
    """Sorted hashes (64 bits) of the distinct terms."""
    return np.sort(distinct_terms(text))


def buckets(hashes: np.ndarray, bits: int = TERM_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def in_lexicon(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    at = buckets(hashes, (len(lexicon) * 8).bit_length() - 1)
    return (lexicon[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def signatures(found: list[np.ndarray], lexicon: np.ndarray) -> np.ndarray:
    """The hash of each lexicon subset (0: no term in it), a row for each array of distinct terms."""
    n = len(found)
    doc = np.repeat(np.arange(n), [len(x) for x in found])
    hashes = np.concatenate([np.empty(0, np.uint64), *found])
    inside = in_lexicon(hashes, lexicon)
    inside |= (np.bincount(doc, inside, minlength=n) == 0)[doc]
    doc, hashes = doc[inside], hashes[inside]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    out = np.zeros((n, EACH, LEVELS), dtype=np.uint16)
    kind = np.uint16 if n * (LEVELS + 1) < 1 << 16 else np.int64  # numpy sorts 16 bits by radix
    places = np.arange(n)[:, None] * (LEVELS + 1)
    for each in range(EACH):
        # other random bits of a term for each family of subsets; a term with r trailing zeros is in the first r
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (each + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        zeros = np.minimum(np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)), LEVELS)
        own = np.flatnonzero(zeros)
        rank = (doc[own] * (LEVELS + 1) + LEVELS - zeros[own]).astype(kind)
        by_rank = np.argsort(rank, kind="stable")
        ranked = rank[by_rank].astype(np.int64)
        lo = np.broadcast_to(np.searchsorted(ranked, places), (n, LEVELS)).ravel()
        hi = np.searchsorted(ranked, (places + np.arange(LEVELS)).ravel(), side="right")
        made = stretch_hashes(hashes[own[by_rank]], lo, hi) % np.uint64(65535) + np.uint64(1)
        out[:, each, ::-1] = np.where(hi > lo, made, 0).reshape(n, LEVELS)
    return out.reshape(n, SUBSETS)


def signature(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    return signatures([hashes], lexicon)[0]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a != 0) | (b != 0)
    n = used.sum(axis=1)
    return np.where(n > 0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1), 1.0)


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def document_frequencies(docs: DataFrame, text="text") -> DataFrame:
    """(term, df) over all documents: summed in each task, a million terms at a time, then by Spark."""

    def summed(parts):
        term, n = (np.concatenate(x) for x in zip(*parts))
        term, at = np.unique(term, return_inverse=True)
        return term, np.bincount(at, n, minlength=len(term)).astype(np.int64)

    def count(batches):
        parts, held = [], 0
        for pdf in batches:
            found = np.concatenate([np.empty(0, np.uint64), *map(distinct_terms, pdf["text"])])
            parts.append((found, np.ones(len(found), dtype=np.int64)))
            held += len(found)
            if held > 3_000_000:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield from frames(*parts[0])
                    parts, held = [], 0
        if parts:
            yield from frames(*summed(parts))

    def frames(term, n):
        for i in range(0, len(term), 100_000):
            yield pd.DataFrame({"term": term[i : i + 100_000].view(np.int64), "n": n[i : i + 100_000]})

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon_bitmap(docs: DataFrame, text="text", idf_low: float = IDF_LOW, min_docs: int = MIN_DOCS, idf_high: float = IDF_HIGH) -> np.ndarray:
    """A filter of the terms in the band: the first bits of each one's hash are the number of its bit."""
    total = max(1, docs.count())
    idf = F.log(F.lit(float(total)) / F.col("df"))
    band = document_frequencies(docs, text).where((F.col("df") >= min_docs) & idf.between(idf_low, idf_high))
    band = stash(band.select("term"), "lexicon")
    bits = min(MOST_BITS, max(TERM_BITS, (16 * band.count() - 1).bit_length()))
    bucket = F.shiftrightunsigned("term", 64 - bits)
    pieces = band.groupBy(F.bitmap_bucket_number(bucket).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in pieces.collect():  # 4 KB each, as many as the filter has
        _place(out, int(r["piece"]), np.frombuffer(r["bits"], dtype=np.uint8))
    return out


def _place(out: np.ndarray, piece: int, bits: np.ndarray) -> None:
    """bitmap_bucket_number(v) is 0 for v = 0, else 1 + (v - 1) // 32768; position counts from there."""
    values = np.flatnonzero(np.unpackbits(bits, bitorder="little")) + (piece - 1) * 32768 + 1
    np.bitwise_or.at(out, values >> 3, (1 << (values & 7)).astype(np.uint8))


LEAST_ID = -(1 << 63)


def range_of(docs: DataFrame, n: int):
    """(number of ranges, Column function): ranges of (doc, th) that hold about equally many rows, counted
    from the largest doc. An id that fills several ranges is split by th. Null ids count as the least one."""
    cuts = docs.select(F.coalesce("doc", F.lit(LEAST_ID)).alias("doc")).approxQuantile("doc", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    value, many = np.unique(np.array([min(max(int(x), LEAST_ID), (1 << 63) - 1) for x in cuts], dtype=np.int64), return_counts=True)
    before = np.append(0, np.cumsum(many))
    ranges = int(before[-1]) + 1

    @F.arrow_udf("int")
    def part(doc: pa.Array, th: pa.Array) -> pa.Array:
        ids = doc.fill_null(LEAST_ID).to_numpy()
        i = np.searchsorted(value, ids)
        hit = np.append(value, 0)[i] == ids
        split = (th.to_numpy().astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        inside = (split * np.append(many, 1)[i].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return pa.array((ranges - 1 - before[i] - np.where(hit & (i < len(value)), inside, 0)).astype(np.int32))

    return ranges, part


def with_next(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Rows (part, tail, doc, th, text), cut by id into ranges that each lie in one partition, in descending order.

    After a range's last document stands a copy of the first one of the next range (tail = 1), and
    after the last range one of the very first document: so each document's successor follows it,
    and whole texts are shuffled once, range by range into partitions of their own.
    """
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    ranges, part = range_of(base, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = base.withColumn("th", text_key(F.col("text"))).select(part("doc", "th").alias("part"), F.lit(0).alias("tail"), "doc", "th", "text")
    heads = stash(rows.groupBy("part").agg(F.max(F.struct("doc", "th")).alias("head")), "next")  # a row a range
    order = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    after = F.broadcast(stash(after, "next"))  # as many rows of three numbers as there are ranges
    tails = rows.alias("r").join(after.alias("a"), F.col("r.doc").eqNullSafe(F.col("a.head.doc")) & (F.col("r.th") == F.col("a.head.th")))
    tails = tails.select("a.part", F.lit(1).alias("tail"), "r.doc", "r.th", "r.text").dropDuplicates(["part"])
    dealt = rows.unionByName(tails).repartitionById(ranges, F.col("part"))
    return dealt.sortWithinPartitions("part", "tail", F.col("doc").desc_nulls_last(), F.col("th").desc())


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_terms long"


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_with_next(docs: DataFrame, key="doc_id", text="text", idf_low: float = IDF_LOW, min_docs: int = MIN_DOCS, idf_high: float = IDF_HIGH) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon_bitmap(docs, text, idf_low, min_docs, idf_high))
    names = [x.split()[0] for x in OUT.split(", ")]

    def make(batches):
        before = None  # the last row of the rows so far: id, text, terms, fingerprint; it waits for the next one
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                tail = part["tail"].to_pylist()
                ids, texts = part["doc"].to_pylist(), [x or "" for x in part["text"].to_pylist()]
                found = [distinct_terms(x) for x in texts]
                sig = signatures(found, shared.value)
                sizes = [len(x) for x in found]
                if before is not None:
                    ids, texts, sizes, tail = [before[0], *ids], [before[1], *texts], [before[2], *sizes], [0, *tail]
                    sig = np.concatenate([before[3][None], sig])
                at = np.flatnonzero(np.array(tail[:-1]) == 0)
                edited = [edited_text(texts[k], texts[k + 1]) for k in at]
                sig1 = signatures([distinct_terms(x) for x in edited], shared.value)
                own, following = sig[at], sig[at + 1]
                columns = [pa.array([ids[k] for k in at], pa.int64()), pa.array([len(texts[k]) for k in at], pa.int64())]
                columns += [pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string())]
                columns += [pa.array(map(to_hex, x), pa.string()) for x in (own, sig1)]
                columns += [pa.array(likenesses(own, x)) for x in (sig1, following)] + [pa.array([sizes[k] for k in at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
                before = None if tail[-1] else (ids[-1], texts[-1], sizes[-1], sig[-1])

    return with_next(docs, key, text).select("tail", "doc", "text").mapInArrow(make, OUT)


def op9_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
