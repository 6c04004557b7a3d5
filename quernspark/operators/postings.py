"""A stored keyword index with impact bounds, and retrieval that leaves out what cannot be among the k best.

postings: (bucket, term, most, ids, impacts), blocks of at most BLOCK documents of one term in falling
impact (what BM25 gives a document before the term's idf); most is the first one's. The table is
partitioned by a hash of the term, so a question reads the folders of its terms only.
terms: (bucket, term, df, idf, most, kth): the highest impact and the DEPTH-th highest one.

A question's k-th score is at least that of the k-th impact of any one of its terms. Terms whose bounds,
summed from the smallest on, stay below that cannot lift a document by themselves (Turtle and Flood,
1995): only the others give candidates, and of those only blocks whose bound, with all other terms'
bounds, reaches it. Candidates alone are scored in full. With a negative idf nothing is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK, BUCKETS, DEPTH, SPREAD = 128, 64, 20, 8
MOST_CANDIDATES = 500_000  # candidates that are sent to the postings at once; more meet them in a shuffle


def bucket(term="term"):
    return F.pmod(F.crc32(F.encode(F.col(term), "utf-8")), F.lit(BUCKETS)).cast("int")


def impacts(docs: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    """(term, chunk_id, impact)."""
    rows = docs.select("chunk_id", T.tokenize(F.col("text")).alias("t"))
    rows = rows.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    return rows.select("term", "chunk_id", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))).alias("impact"))


def blocks(each: DataFrame) -> DataFrame:
    """Postings from impacts. A frequent term's documents are spread over SPREAD sorted streams, and a stream is cut
    into blocks as it passes: no term is gathered in one place."""
    kind = each.schema["chunk_id"].dataType.simpleString()
    rows = each.withColumn("bucket", bucket()).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)))
    rows = rows.sortWithinPartitions("bucket", "term", F.desc("impact"), "chunk_id").select("bucket", "term", "impact", "chunk_id")

    def cut(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, dtype=np.int64)
            ends = np.append(edges[1:], len(term))
            starts = np.concatenate([np.arange(i, j, BLOCK) for i, j in zip(edges, ends)]) if len(edges) else edges
            if not len(starts):
                continue
            keep = int(starts[-1])  # the last block may go on
            made = made_of(table, starts[:-1], np.append(starts[1:-1], keep) if len(starts) > 1 else starts[:0])
            held = table.slice(keep).combine_chunks().to_batches()[0]
            if made is not None:
                yield made
        if held is not None and len(held):
            yield made_of(pa.Table.from_batches([held]), np.array([0]), np.array([len(held)]))

    def made_of(table, starts, ends):
        if not len(starts):
            return None
        at = pa.array(starts)
        bounds = pa.array(np.append(starts, ends[-1]).astype(np.int32))
        ids, values = table["chunk_id"].combine_chunks(), table["impact"].combine_chunks()
        columns = [table["bucket"].combine_chunks().take(at), table["term"].combine_chunks().take(at), values.take(at), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, values)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "term", "most", "ids", "impacts"])

    return rows.mapInArrow(cut, f"bucket int, term string, most double, ids array<{kind}>, impacts array<double>")


def term_bounds(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (term, df, idf) with bucket, most and kth. Of each stream the first DEPTH impacts are enough."""
    first = postings.select("term", F.explode(F.slice("impacts", 1, DEPTH)).alias("x"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("x")))
    best = first.withColumn("nth", nth).where(F.col("nth") <= DEPTH).groupBy("term").agg(F.max("x").alias("most"), F.min(F.when(F.col("nth") == DEPTH, F.col("x"))).alias("kth"))
    return terms.join(best, "term").withColumn("bucket", bucket())


def pruned(table: DataFrame, words: list[str]) -> DataFrame:
    """The folders of the words' buckets."""
    at = sorted({_crc(w) % BUCKETS for w in words})
    return table.where(F.col("bucket").isin(at)) if at else table.where("false")


def _crc(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def asked_bounds(asked: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """asked (query_id, term, times) with weight, rest (the other terms' bounds), floor (what the k-th score reaches at
    least) and essential."""
    rows = asked.join(F.broadcast(terms), "term").withColumn("weight", F.col("times") * F.col("idf")).withColumn("bound", F.col("weight") * F.col("most"))
    own, upto = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("bound", "term")
    least = F.max(F.coalesce(F.col("weight") * F.col("kth"), F.lit(0.0))).over(own) if k <= DEPTH else F.lit(0.0)
    floor = F.when(F.min("idf").over(own) < 0, F.lit(float("-inf"))).otherwise(least - 2e-6)  # scores are rounded to 6 places
    rows = rows.withColumn("floor", floor).withColumn("rest", F.sum("bound").over(own) - F.col("bound"))
    return rows.withColumn("essential", F.sum("bound").over(upto) >= F.col("floor")).drop("bound")


def max_score(postings: DataFrame, terms: DataFrame, asked: DataFrame, words: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, score) of all documents that can be among the k best of their question."""
    known = pruned(terms, words).select("term", "df", "idf", "most", "kth")
    bounds = asked_bounds(asked, known, k)
    table = pruned(postings, words)
    open_ = F.broadcast(bounds.where("essential").select("query_id", "term", "weight", "rest", "floor"))
    lead = table.join(open_, "term").where(F.col("weight") * F.col("most") + F.col("rest") >= F.col("floor"))
    near = F.filter(F.arrays_zip("ids", "impacts"), lambda x: F.col("weight") * x["impacts"] + F.col("rest") >= F.col("floor"))
    candidates = lead.select("query_id", F.explode(near).alias("x")).select("query_id", F.col("x.ids").alias("chunk_id")).distinct()
    every = table.join(F.broadcast(bounds.select("term").distinct()), "term", "left_semi")
    each = every.select("term", F.explode(F.arrays_zip("ids", "impacts")).alias("x")).select("term", F.col("x.ids").alias("chunk_id"), F.col("x.impacts").alias("impact"))
    wanted = candidates.join(F.broadcast(bounds.select("query_id", "term", "weight")), "query_id")
    scores = wanted.join(each, ["term", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))
    return scores
