"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one sends each record to its shard and, by a seeded hash, to one of the shard's buckets, each
sized to fit in memory. Pass two gathers a bucket, permutes it with Fisher-Yates (Spark's seeded
shuffle of an array) and writes it. The slot of a record is its place in the bucket after the
records of the shard's earlier buckets.

The shard depends on the id and the number of shards alone (rendezvous hashing: the shard with the
largest hash of id and shard number), so that one more shard only takes records, from all others.

Defined cases: a null text has size 1 and the checksum of an empty text; a null id hashes like any
other value; repeated rows share a shard and have slots of their own; an empty table stays empty; columns of
any name and type travel with their record.
Within a run slots are whole; between runs the order within a bucket may differ, the shard may not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import shared_dir, stash


def free_names(columns: list[str], *names: str) -> list[str]:
    """names, with underscores in front of those that columns have (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def rendezvous(key: Column, shards: int, seed: int = 17) -> Column:
    each = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.greatest(*each)["i"]


def shuffle_into_shards(rows: DataFrame, key: str, size: str, shards: int = 16, bucket_bytes: int = 64 << 20, seed: int = 17, bucket_rows: int = 100_000) -> DataFrame:
    """rows with shard, slot and grown_shard. Columns of rows travel with their record.

    A bucket holds about bucket_bytes of the column size and about bucket_rows records at most,
    whatever the data: its number follows from the totals, and records are spread by the hash of a
    number that each has of its own, so that neither copies nor repeated ids gather in one bucket.
    """
    held = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("own"))
    held = held.withColumn("shard", rendezvous(F.col(f"row.{key}"), shards, seed)).withColumn("grown_shard", rendezvous(F.col(f"row.{key}"), shards + 1, seed))
    held = stash(held, "shards", "zstd")
    total = held.agg(F.count("*"), F.sum(f"row.{size}")).first()
    buckets = max(1, -(-max((total[1] or 0) // bucket_bytes, total[0] // bucket_rows) // shards) + 1)
    held = held.withColumn("bucket", F.pmod(F.xxhash64("own", F.lit(seed)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    by_own = lambda a, b: F.when(a["own"] < b["own"], -1).when(a["own"] > b["own"], 1).otherwise(0)  # noqa: E731  records may hold what has no order
    full = held.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("own", "grown_shard", "row")), by_own).alias("records"))
    mixed = full.join(starts, ["shard", "bucket"]).select("shard", "start", F.shuffle("records", seed).alias("records"))
    out = mixed.select("shard", "start", F.posexplode("records").alias("pos", "r"))
    return out.select("r.row", "shard", (F.col("start") + F.col("pos")).cast("long").alias("slot"), F.col("r.grown_shard").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 16, key: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20) -> str:
    """Write whole records as Parquet, a folder a shard (__shard), with slot (the order in it) and grown_shard; where the
    records have columns of these names, ours get underscores in front (see free_names). Returns the path."""
    size, shard, slot, grown = free_names(docs.columns, "__size", "__shard", "slot", "grown_shard")
    sized = docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    out = shuffle_into_shards(sized, key, size, shards, bucket_bytes)
    path = path or shared_dir(docs.sparkSession, "sharded")
    rows = out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("slot").alias(slot), F.col("grown_shard").alias(grown), F.col("shard").alias(shard))
    rows.write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return path


def read_shards(spark, path: str, schema: StructType) -> DataFrame:
    """Records of that schema that write_shards wrote, with slot, grown_shard and __shard, or the names that were free."""
    _, shard, slot, grown = free_names(schema.names, "__size", "__shard", "slot", "grown_shard")
    return spark.read.schema(StructType(list(schema.fields)).add(slot, "long").add(grown, "integer").add(shard, "integer")).parquet(path)


def op8_shard(spark, sf_dir: str) -> DataFrame:
    """Whole records are scattered and written; size and checksum are those of the texts read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read_shards(spark, write_shards(docs), docs.schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("__shard").alias("shard"), "slot", "grown_shard")
