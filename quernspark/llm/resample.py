"""Importance resampling of documents towards a target, by hashed features and Gumbel top-k.

Features are runs of 1 to max_n consecutive words, hashed to buckets by CRC-32. CRC-32 is linear: a
span's value is the XOR of what each byte adds at its distance from the span's end, and of a constant
of the span's length. Both are tables (REACH distances x 256 bytes). The contributions of all bytes of
many spans are looked up at once and folded by bitwise_xor.reduceat; a span of more than REACH bytes
is folded block by block, where moving a value on by a block is four looks into the same table.

Counts of the buckets cover all documents and all target texts; every task sums its own before the
shuffle, so at most n_buckets rows leave it, and as many numbers reach the driver and are sent back.
A document's weight is the floored mean of its features' gains; with a Gumbel number of its id added,
the highest scores are a draw without replacement. The cut is found in a histogram of the scores
(whole numbers within a bound that the counts set); drawn rows alone are ordered, range by range.

Defined cases: a null text has no feature and weight 0; a null id is drawn by the hash of the empty id
and comes last among ties, equal ids in the order of a hash of their texts; repeated rows are rows of
their own; an empty table gives an empty result, an empty target equal gains; columns of the input
may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash
from .spans import Spans, spread
from .words import slices

REACH, BLOCK = 128, 1 << 20
POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
WORD = ~np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
N_BUCKETS, MIN_WORDS, SEED = 10_000, 20, 2024


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(what byte b adds with d bytes after it, the start value moved on by n bytes)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    by_distance, start = [one], [np.uint32(0xFFFFFFFF)]
    for _ in range(REACH):
        last, k = by_distance[-1], start[-1]
        by_distance.append(one[last & 0xFF] ^ last >> np.uint32(8))
        start.append(one[k & np.uint32(0xFF)] ^ k >> np.uint32(8))
    return np.array(by_distance[:REACH]), np.array(start, dtype=np.uint32)


TABLE, START = _tables()


def _moved(state: np.ndarray) -> np.ndarray:
    """CRC states after REACH zero bytes."""
    parts = [TABLE[REACH - 1 - k, state >> np.uint32(8 * k) & np.uint32(0xFF)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _folded(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What the bytes of spans of 1 to REACH bytes add."""
    sizes = hi - lo
    place = spread(lo, sizes)
    parts = TABLE[np.repeat(hi - 1, sizes) - place, data[place]]
    return np.bitwise_xor.reduceat(parts, np.cumsum(sizes) - sizes)


def span_crcs(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[lo[i]:hi[i]]; spans may overlap, none is empty."""
    out = np.empty(len(lo), dtype=np.uint32)
    sizes = hi - lo
    short = np.flatnonzero(sizes <= REACH)
    upto = np.cumsum(sizes[short])
    cuts = np.searchsorted(upto, np.arange(BLOCK, (upto[-1] if len(upto) else 0) + BLOCK, BLOCK), side="left") + 1
    for at in np.split(short, np.minimum(cuts, len(short))):
        if len(at):
            out[at] = _folded(data, lo[at], hi[at]) ^ START[sizes[at]]
    long = np.flatnonzero(sizes > REACH)
    lead = (sizes[long] - 1) % REACH + 1  # the first block is the odd one
    if len(long):
        state = _folded(data, lo[long], lo[long] + lead) ^ START[lead]
        at, begin = np.arange(len(long)), lo[long] + lead
        while len(at := at[begin[at] < hi[long[at]]]):
            state[at] = _moved(state[at]) ^ _folded(data, begin[at], begin[at] + REACH)
            begin[at] += REACH
        out[long] = state
    return ~out


def feature_buckets(texts: pa.Array, max_n: int = 1, n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text)."""
    found = Spans(texts, WORD)
    data, bounds = found.joined()
    buckets, owners = [], []
    for n in range(1, max_n + 1):
        at = np.flatnonzero(found.text[: max(0, len(found.text) - n + 1)] == found.text[n - 1 :])
        buckets.append(span_crcs(data, bounds[at], bounds[at + n] - 1) % np.uint32(n_buckets))
        owners.append(found.text[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), np.diff(found.first)


def bucket_counts(docs: DataFrame, text="text", max_n: int = 1, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: n_buckets numbers, summed in each task first."""

    def count(batches):
        own = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for i, j in slices(batch["text"]):
                own += np.bincount(feature_buckets(batch["text"].slice(i, j - i), max_n, n_buckets)[0], minlength=n_buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["bucket", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, dtype=np.int64)
    for r in rows.collect():  # at most n_buckets rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    n, all_own, all_target = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_own + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(own.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, key="doc_id", text="text", max_n: int = 1) -> DataFrame:
    """(doc_id, th, words, n_features, weight) of every document; th is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as many numbers as there are buckets
    base = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                bucket, owner, words = feature_buckets(part["text"], max_n, len(shared.value))
                n = np.bincount(owner, minlength=len(words))
                total = np.zeros(len(words), dtype=np.int64)
                np.add.at(total, owner, shared.value[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["th"], pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "th", "words", "n_features", "weight"])

    return base.mapInArrow(weigh, f"doc_id {kind}, th long, words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that the seed and the id decide, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, share: float = 10.0, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (doc_id, th, words, score, ...) with rank: 1, 2, ... for the share (in per cent) of the documents
    of at least min_words words with the highest scores, null for the rest."""
    fit = F.col("words") >= min_words
    held = sorted(((r["score"], r["count"]) for r in scored.where(fit).groupBy("score").count().collect()), reverse=True)  # whole numbers within a fixed range
    most, cut, over = math.floor(share * sum(n for _, n in held) / 100), None, 0
    for cut, n in held if most else ():
        over += n
        if over >= most:
            break
    above = fit & (F.col("score") >= cut) if most else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("th")]
    top = scored.where(above).repartitionByRange(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    top = stash(top.withColumn("row", F.monotonically_increasing_id()), "drawn")
    part, before, starts = F.shiftright("row", 33), 0, {}  # the number's part for the partition
    for r in top.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        starts[r["part"]], before = before, before + r["count"]
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts, default=0) + 1)]), (part + 1).cast("int"))
    rank = start + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = top.withColumn("rank", F.when(rank <= most, rank)).drop("row")
    return scored.where(~F.coalesce(above, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, share: float = 10.0, min_words: int = MIN_WORDS, max_n: int = 1, n_buckets: int = N_BUCKETS, seed: int = SEED, key="doc_id", text="text", target_text="text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have a rank."""
    gains = bucket_gains(bucket_counts(docs, text, max_n, n_buckets), bucket_counts(target, target_text, max_n, n_buckets))
    rows = weighed(docs, gains, key, text, max_n)
    scored = stash(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    return drawn(scored, share, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH table0 AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS word FROM d),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION SELECT word FROM b)),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[((xor(c, y) & 255) + 1)::INT])), 4294967295) % 10000 AS bucket FROM vocabulary, table0),
s AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS ns, (SELECT count(*) FROM b)::DOUBLE AS nt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ns + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (nt + 10000))))::BIGINT AS g FROM s FULL JOIN t USING (bucket), n),
weight AS (SELECT doc_id, sum(g) AS total FROM f JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= 20 AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) <= (count(*) FILTER (fit) OVER () * 10) // 100
    THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS rank FROM ranked
"""
