"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a fixed 60-bit hash of its id. A source gives whole passes over its documents
(the integer part of target / size) plus those documents whose hash lies below a threshold. The
threshold is found by histograms: sum the sizes by source and the top 12 bits of the hash, find the
bucket where the running sum passes the budget, and look at the next 12 bits in that bucket alone,
until all 60 bits are fixed. Documents are then filtered by comparing hashes; they are never sorted.
A larger budget raises the thresholds only, so that smaller mixes lie within larger ones.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a null
key hashes like an empty one; rows that repeat a key stand or fall together; an empty table gives an
empty result. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), budget: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row a source: source, source_size, target, passes (whole ones) and rest (words of the last one).

    Weights are dealt to the sources in code-point order, over and over. A target stops at
    max_repeats times the size of its source; the excess goes to the others by weight. Sources may be
    many: they are numbered range by range, and the water level is found by sums over them, once
    more for each time that it rises past some sources' stops.
    """
    spark, order = sized.sparkSession, F.col("source").asc_nulls_last()
    tot = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    tot = tot.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    tot = stash(tot.withColumn("row", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("row", 33)  # of the number's parts, the one for the partition
    before, starts = 0, {}
    for r in tot.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        starts[r["part"]], before = before % len(weights), before + r["count"]
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)) for i in range(max(starts, default=0) + 1)]), (part + 1).cast("int"))
    place = start + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = tot.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).drop("row")
    t = stash(t.withColumn("fills_at", F.col("cap") / F.col("weight")), "mix")
    whole, level, full = t.agg(F.sum("source_size")).first()[0] or 0, float("-inf"), -1
    while True:
        over = F.col("fills_at") < F.lit(level)
        n, held, open_weight = t.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (float(budget) * whole - (held or 0.0)) / open_weight
    target = F.least("cap", F.lit(level) * F.col("weight")) if open_weight else F.col("cap")
    t = t.withColumn("target", target)
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(max_repeats)))
    t = t.withColumn("passes", passes.cast("long"))
    rest = F.when(F.col("passes") >= max_repeats, 0.0).otherwise(F.col("target") - F.col("passes") * F.col("source_size"))
    return t.select("source", "source_size", "weight", "target", "passes", rest.alias("rest"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with below: the documents of a source with a smaller hash are in its last pass.

    sized has source, size and hash. Only the histograms (at most 4096 rows a source) are shuffled
    and ordered. The bucket that holds the boundary is refined level by level.
    """
    state = targets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        inside = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.hash", HASH_BITS - used + LEVEL_BITS) == F.col("s.prefix")))
        bucket = F.shiftright("d.hash", HASH_BITS - used)
        hist = inside.groupBy(F.col("d.source").alias("source"), bucket.alias("bucket")).agg(F.sum("d.size").alias("words"), F.first("s.rest").alias("rest"), F.first("s.base").alias("base"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = hist.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("e"))
        state = stash(edge.select("source", "e.rest", F.col("e.bucket").alias("prefix"), (F.col("e.upto") - F.col("e.words")).alias("base"), F.col("e.words").alias("words")), "mix")
    nearer = F.col("base") + F.col("words") - F.col("rest") < F.col("rest") - F.col("base")
    cut = state.select("source", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    out = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return out.select("t.*", F.coalesce("c.below", F.lit(0)).cast("long").alias("below"))


def plan_mix(docs: DataFrame, weights=(1, 2, 3), budget: float = 1.0, max_repeats: int = 3, key="doc_id", text="text", source="source") -> tuple[DataFrame, DataFrame]:
    """(one slim row a document with key, source, size and hash; one row a source with its threshold)."""
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), unit_hash(F.col(key)).alias("hash"))
    slim = stash(slim, "mix")
    targets = stash(source_targets(slim, weights, budget, max_repeats), "mix")
    return slim, stash(thresholds(slim, targets), "mix")


def repeats(hash_: Column) -> Column:
    """How often the mix takes a document whose row is joined with its source's thresholds."""
    return F.col("m.passes") + (hash_ < F.col("m.below")).cast("long")


def mix_plan_rows(slim: DataFrame, plan: DataFrame) -> DataFrame:
    joined = slim.alias("d").join(plan.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")))
    return joined.select("d.key", "d.source", "d.size", "m.source_size", "m.target", repeats(F.col("d.hash")).alias("repeats"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), budget: float = 1.0, max_repeats: int = 3, key="doc_id", text="text", source="source") -> DataFrame:
    """The mixed documents themselves, with the input's columns; a document taken twice is there twice."""
    _, plan = plan_mix(docs, weights, budget, max_repeats, key, text, source)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = held.alias("d").join(plan.alias("m"), F.col(f"d.row.{source}").eqNullSafe(F.col("m.source")))
    times = joined.select("d.row", repeats(unit_hash(F.col(f"d.row.{key}"))).alias("n")).where("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    slim, plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = mix_plan_rows(slim, plan)
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM tot),
f AS (SELECT *, cap / weight AS fills_at FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM tot)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM f),
lam AS (SELECT (SELECT lv FROM l WHERE lv <= fills_at ORDER BY fills_at, lv LIMIT 1) AS water),
t AS (SELECT source, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM l, lam),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT AS passes FROM t),
r AS (SELECT *, CASE WHEN passes >= 3 THEN 0 ELSE target - passes * source_size END AS rest FROM p),
c AS (SELECT s.*, r.source_size, r.target, r.passes, r.rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
d AS (SELECT *, passes + CASE WHEN source_size > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END AS repeats FROM c)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * repeats)::BIGINT AS taken, source, repeats::BIGINT AS repeats FROM d
"""
