"""Keyword and vector indices, retrieval, fusion and reranking, for batches of questions.

Documents have (chunk_id, text) and a position, by default the order of chunk_id. Questions have
(query_id, question). Ranked lists have (query_id, chunk_id, score, rank).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import BATCH, kept
from . import postings as index
from . import topk

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values of BM25 Okapi
RETRIEVE_K, TOP_N, RRF_K = 20, 5, 60
MOST_ASKED, MOST_BYTES = 200_000, 64 << 20  # sent at once: terms of questions, bytes of questions' vectors


def doc_stats(docs: DataFrame) -> DataFrame:
    return docs.select("chunk_id", F.coalesce(F.size(T.tokenize(F.col("text"))), F.lit(0)).alias("dl"))


def raw(n: int):
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def raw_idf(docs: DataFrame, n: int) -> DataFrame:
    """(term, df, raw) of all terms."""
    distinct = docs.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", raw(n))


def floored(raw: DataFrame, mean) -> DataFrame:
    """(term, df, idf); a negative idf is replaced by EPSILON times the mean of all terms."""
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def term_stats(docs: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) of all terms."""
    raw = raw_idf(docs, n)
    return floored(raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))), F.col("mean"))  # one row


def sliced(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about most rows that keep a key's rows together, so that each part may be broadcast."""
    parts = max(1, -(-df.count() // most))
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def index_stats(docs: DataFrame) -> tuple[int, float]:
    """(number of documents, mean number of terms)."""
    n, mean = docs.select(F.coalesce(F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")), F.lit(0)).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    return n, mean or 1.0


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(T.tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def asked_idf(docs: DataFrame, n: int, words: list[str]) -> tuple[dict[str, float], float]:
    """(the idf of the words that documents have, the mean number of terms of n documents).

    The mean that floors an idf is over all terms: one pass over the texts, one row.
    """
    frame = docs.sparkSession.createDataFrame([(w,) for w in words], "term string")
    rows = docs.select(T.tokenize(F.col("text")).alias("t"))
    rows = rows.select(F.size("t").alias("dl"), F.posexplode(F.array_distinct("t")).alias("at", "term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("at") == 0, F.col("dl"))).alias("dl"))
    table = df.withColumn("raw", raw(n)).join(F.broadcast(frame.withColumn("asked", F.lit(True))), "term", "left")
    told = F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("asked")
    mean, total, asked = table.agg(F.avg("raw"), F.sum("dl"), told).first()
    return {r["term"]: EPSILON * mean if r["raw"] < 0 else r["raw"] for r in asked}, (total or 0) / max(1, n) or 1.0


def sets_of(rows: DataFrame, key: str, most: int):
    """The rows of a stated set in lists of about most, a key's rows together; one list at a time is on the driver."""
    for part in sliced(rows, key, most):
        yield part.collect()


def bm25(docs: DataFrame, questions: DataFrame, k: int = RETRIEVE_K, most: int = MOST_ASKED, stats=None, terms: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Top k; ties by chunk_id; unscored documents fill up with score 0, as if all had been scored.

    Without an index every text is read twice: for the statistics of its terms, and to be scored in its
    task, which keeps its k best of each question; only those are stored, and meet. The questions' terms are sent
    to the tasks, at most about most at once (more questions are taken in slices). With an index that is
    stored, stats, terms and postings come from it, and only what can be among the k best is scored.
    """
    n = stats[0] if stats else docs.count()
    kind, parts = questions.schema["query_id"].dataType, []
    asked = asked_terms(questions)
    if postings is None:
        for rows in sets_of(asked, "query_id", most):
            weights, avgdl = asked_idf(docs, n, sorted({r["term"] for r in rows}))
            held = {}
            for r in rows:
                held.setdefault(r["query_id"], {})[r["term"]] = r["times"]
            parts.append(kept(topk.scored_by_terms(docs, list(held.items()), weights, avgdl, k, K1, B), "scored", BATCH))
        out = topk.merged(reduce(DataFrame.unionByName, parts), k).withColumn("query_id", F.col("query_id").cast(kind))
        blank = questions.join(asked.select("query_id").distinct(), "query_id", "left_anti")  # questions without a word
        lead = docs.select("chunk_id").orderBy("chunk_id").limit(k)
        empty = blank.select("query_id").join(F.broadcast(lead)).withColumn("score", F.lit(0.0))
        return out.unionByName(topk.merged(empty, k)) if blank.limit(1).count() else out
    lowest = 0.0
    for part in sliced(asked, "query_id", most):
        words = [r["term"] for r in part.select("term").distinct().collect()]
        lowest = min(lowest, index.pruned(terms, words).agg(F.min("idf")).first()[0] or 0.0)
        parts.append(index.max_score(postings, terms, part, words, k))
    scored = reduce(DataFrame.unionByName, parts)
    return top_k(zero_filled(scored, docs, questions, k, lowest < 0), k)


def zero_filled(scored: DataFrame, docs: DataFrame, questions: DataFrame, k: int, below_zero: bool = False) -> DataFrame:
    """scored and, for each question, documents that it did not score, with score 0: as many of the first as can matter.

    Where no score is below zero, either k of the first 2 k documents are not scored, or more than k
    of them have a score that comes before any later document without one. Negative scores (below_zero)
    only come from a vocabulary that most documents share; then the documents are looked through
    as far as the most scored ones of a question can reach.
    """
    depth = 2 * k
    if below_zero:
        depth = k + (scored.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    lead = docs.select("chunk_id").orderBy("chunk_id").limit(depth)
    lead = lead if below_zero else F.broadcast(lead)
    near = scored.join(lead, "chunk_id", "left_semi").select("query_id", "chunk_id")
    blank = questions.select("query_id").join(lead).join(near, ["query_id", "chunk_id"], "left_anti")
    return scored.unionByName(blank.withColumn("score", F.lit(0.0)))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE_K, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Nearest k by squared distance. vectors: (chunk_id, v); queries: (query_id, q), a stated set.

    The questions' vectors are sent to the tasks, at most about most_bytes at once (more are taken in
    slices); the documents' vectors stay where they are, and every task keeps its k nearest of each
    question in a bounded list. Rows without a vector are not found; vectors of another length are an error.
    """
    kind, first = queries.schema["query_id"].dataType, queries.where("q is not null")
    width = first.agg(F.max(F.size("q"))).first()[0] or 1
    parts = [topk.nearest(vectors, rows, k) for rows in sets_of(first.select("query_id", "q"), "query_id", max(1, most_bytes // (8 * width))) if rows]
    if not parts:
        return queries.join(vectors.select("chunk_id").limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    ranked = topk.merged(reduce(DataFrame.unionByName, parts), k).withColumn("distance", 0.0 - F.col("score"))
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "chunk_id", "distance", T.similarity(F.col("distance")).alias("score"), "rank")


def rrf(first: DataFrame, second: DataFrame, k: int = RETRIEVE_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; equal scores keep the order of first, then of second."""
    a, b = first.select("query_id", "chunk_id", F.col("rank").alias("r1")), second.select("query_id", "chunk_id", F.col("rank").alias("r2"))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("r1") + part("r2"), 9)).withColumn("seen", F.coalesce("r1", F.lit(1_000_000) + F.col("r2")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def coverage(question, text):
    """The default score of a pair: the share of the question's distinct terms that the text has."""
    q, t = F.array_distinct(T.tokenize(question)), T.tokenize(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


def rerank(ranked: DataFrame, docs: DataFrame, questions: DataFrame, n: int = TOP_N, scorer=coverage) -> DataFrame:
    """The n best of each list by scorer(question, text); equal scores keep their order."""
    pairs = ranked.select("query_id", "chunk_id", F.col("rank").alias("was")).join(questions, "query_id").join(docs.select("chunk_id", "text"), "chunk_id")
    scored = pairs.select("query_id", "chunk_id", "was", F.round(scorer(F.col("question"), F.col("text")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "was")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def candidates(mode: str, docs: DataFrame, questions: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE_K, **stored) -> DataFrame:
    """The k candidates of one mode, before reranking. stored: statistics and terms of an index, as bm25 takes them."""
    if mode == "dense_only":
        return dense(vectors, queries, k)
    if mode == "sparse_only":
        return bm25(docs, questions, k, **stored)
    if mode in ("hybrid", "hybrid_rerank"):
        return rrf(dense(vectors, queries, k), bm25(docs, questions, k, **stored), k)
    raise ValueError(f"unknown mode {mode!r}")


def retrieve(mode: str, docs: DataFrame, questions: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE_K, n: int = TOP_N, scorer=coverage, **stored) -> DataFrame:
    """(query_id, chunk_id, rank) of one mode, cut to n in every mode."""
    out = candidates(mode, docs, questions, vectors, queries, k, **stored)
    out = rerank(out, docs, questions, n, scorer) if mode == "hybrid_rerank" else out
    return out.where(F.col("rank") <= n).select("query_id", "chunk_id", "rank")


def side_by_side(docs: DataFrame, questions: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 3, reranked: int = TOP_N, scorer=coverage, **stored) -> DataFrame:
    """(query_id, list, rank, chunk_id, score): the first of each retriever's list beside each other, and of the reranked one."""
    sparse, near = bm25(docs, questions, **stored), dense(vectors, queries)
    fused = rrf(near, sparse)
    lists = {"dense": near, "sparse": sparse, "hybrid": fused, "reranked": rerank(fused, docs, questions, reranked, scorer)}
    cut = [x.where(F.col("rank") <= (reranked if name == "reranked" else n)).select("query_id", F.lit(name).alias("list"), "rank", "chunk_id", F.round("score", 4).alias("score")) for name, x in lists.items()]
    return reduce(DataFrame.unionByName, cut)


def browse(docs: DataFrame, word: str, n: int = 3, file: str | None = None, **stored) -> DataFrame:
    """The n best chunks for some words, of sources whose name has file in it. A stored index serves whole corpora only."""
    if file:
        docs, stored = docs.where(F.contains(F.lower("source"), F.lit(file.lower()))), {}
    asked = docs.sparkSession.createDataFrame([("q", word)], "query_id string, question string")
    return bm25(docs, asked, n, **stored).join(docs, "chunk_id").orderBy("rank")


def chunk_by_number(docs: DataFrame, number: int) -> DataFrame:
    return docs.where(F.col("chunk_id").endswith(f"::{number}")).orderBy("chunk_id").limit(1)
