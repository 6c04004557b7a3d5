"""Helpers that several operators of this folder use: shared tables, components, row keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only where that setting is missing (a local session, as in tests) a folder of this machine is
    taken instead.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own_dir
    _written.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def sweep(spark: SparkSession) -> int:
    """Delete what this driver has written to the shared folder so far; returns the number of folders.

    Results read those tables when they are asked for, so call it once they are written or no longer needed.
    """
    n, conf = len(_written), spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stash(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files behind it go as soon as it is written, as nothing reads them again. Whole texts
    are best written with codec "zstd".
    """
    spark, path, cleanup = df.sparkSession, shared_dir(df.sparkSession, tag), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most so many rows: workers hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def whole_number(x: str | None) -> int | None:
    """An id that went to Python as text."""
    return None if x is None else int(x)


def frame_of(rows: list, schema: str) -> pd.DataFrame:
    """rows (tuples in the order of schema, or dicts) as pandas columns that keep 64-bit numbers beside nulls."""
    kinds = dict(x.split(" ") for x in schema.split(", "))
    whole = {"long": "Int64", "int": "Int32"}
    columns = {name: [r[name] for r in rows] for name in kinds} if rows and isinstance(rows[0], dict) else dict(zip(kinds, zip(*rows) if rows else [()] * len(kinds)))
    return pd.DataFrame({name: pd.array(list(x), dtype=whole[kinds[name]]) if kinds[name] in whole else pd.Series(list(x), dtype=object if kinds[name] != "double" else float) for name, x in columns.items()})


def text_key(text: Column) -> Column:
    """A second key beside the id, so that rows with one id and different texts stay apart."""
    return F.xxhash64(text)


def min_labels(n: int, labels: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of n rows after joining rows i[k] and j[k]: the smallest row of each class."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is the least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows
    with the logarithm of the longest chain. Each round only keeps minima per node, aggregated
    before the shuffle, so that a node with very many links is no hot group; joins on such a node
    are left to the skew handling of adaptive execution. No link reaches the driver.
    """
    edge = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    edge, seen = stash(edge.distinct(), "edges"), None
    for _ in range(max_rounds):
        mark = tuple(edge.agg(F.count("*"), F.expr("bit_xor(xxhash64(lo, hi))"), F.expr("sum(hi % 1000003)")).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edge.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edge.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = stash(large, "edges")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edge = stash(small.unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    ends = edge.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.unionByName(edge.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
