"""The k best of many candidates for each of many questions, in blocks, without sorting all pairs.

A task keeps k candidates a question and looks at its rows block by block; it hands on at most k rows
a question, and only those meet in a shuffle. Candidates are ordered by score, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 2_000_000  # pairs of a question and a candidate that are looked at at once


def id_array(column: pa.Array) -> np.ndarray:
    """Ids that numpy can order as Spark does: whole numbers, or strings by their bytes."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([x.encode() for x in column.to_pylist()], dtype=bytes)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids) if ids.dtype.kind == "i" else pa.array([x.decode() for x in ids.tolist()], pa.string())


def best_of_block(scores: np.ndarray, k: int) -> np.ndarray:
    """Places (a row a question) of the k highest scores of each row; of equal ones the first. Rows have at least k."""
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    over, tie = scores > kth, scores == kth
    tie &= np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True)
    return np.nonzero(over | tie)[1].reshape(len(scores), k)


class Best:
    """The k best candidates of each question so far."""

    def __init__(self, questions: int, k: int):
        self.k, self.scores, self.ids = k, np.full((questions, k), -np.inf), None

    def bound(self, lo: int, hi: int) -> np.ndarray:
        """What a candidate's score must reach to be among the k of each question."""
        return self.scores[lo:hi, -1]

    def take(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each question from number lo on, a column for each candidate; ids in ascending order."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        row = lo + np.flatnonzero(scores.max(axis=1) >= self.scores[lo : lo + len(scores), -1])
        if not len(row):
            return
        part = scores[row - lo]
        if part.shape[1] > self.k:
            at = best_of_block(part, self.k)
            part, new = np.take_along_axis(part, at, axis=1), ids[at]
        else:
            new = np.broadcast_to(ids, part.shape)
        if self.ids.dtype.itemsize < new.dtype.itemsize:
            self.ids = self.ids.astype(new.dtype)
        all_scores, all_ids = np.concatenate([self.scores[row], part], axis=1), np.concatenate([self.ids[row], new], axis=1)
        number = np.repeat(np.arange(len(row)), all_scores.shape[1])
        order = np.lexsort((all_ids.ravel(), -all_scores.ravel(), number)).reshape(all_scores.shape)[:, : self.k]
        self.scores[row], self.ids[row] = all_scores.ravel()[order], all_ids.ravel()[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of all that is held."""
        question, at = np.nonzero(self.scores > -np.inf)
        return question, self.ids[question, at] if self.ids is not None else np.empty(0, dtype=np.int64), self.scores[question, at]


def sorted_blocks(batches, most: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(ids, rows) of blocks of at most most rows, each in the order of column chunk_id; null ids are left out."""
    for batch in batches:
        batch = batch.filter(batch["chunk_id"].is_valid())
        for i in range(0, len(batch), most):
            part = batch.slice(i, most)
            ids = id_array(part["chunk_id"])
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.take(pa.array(order))


def merged(parts: DataFrame, k: int) -> DataFrame:
    """parts (query_id, chunk_id, score) with rank: the k best of the tasks' lists."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, questions: list, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of each task's k nearest; score is the squared distance, negative, to 6 places.

    questions: rows (query_id, q), a bounded part of a stated set, sent to all tasks. Distances come from
    block products; where one may be among the k, it is computed again from the differences, so that
    the lists are those of direct computation.
    """
    at, q = [r["query_id"] for r in questions], np.array([r["q"] for r in questions], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((at, q))

    def search(batches):
        at, q = shared.value
        best, norms, dim = Best(len(q), k), (q * q).sum(axis=1), q.shape[1]
        step = max(1, CELLS // 2048)
        for ids, part in sorted_blocks((b.filter(b["v"].is_valid()) for b in batches), 2048):
            v = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(v) != len(ids) * dim:
                raise ValueError(f"vectors must have {dim} numbers, as the questions' do")
            v = v.reshape(len(ids), dim)
            own = (v * v).sum(axis=1)
            for lo in range(0, len(q), step):
                near = norms[lo : lo + step, None] + own - 2 * (q[lo : lo + step] @ v.T)
                slack = 2e-6 + 1e-12 * (norms[lo : lo + step, None] + own.max())
                kth = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                kth = np.minimum(kth, -best.bound(lo, lo + step)) if len(ids) >= k else -best.bound(lo, lo + step)
                question, row = np.nonzero(near <= kth[:, None] + slack)
                near.fill(np.inf)
                for i in range(0, len(row), 1 << 15):
                    a, b = question[i : i + (1 << 15)], row[i : i + (1 << 15)]
                    near[a, b] = np.round(((v[b] - q[lo + a]) ** 2).sum(axis=1), 6)
                best.take(lo, -near, ids)
        yield from lists(best, at)

    return _typed(vectors.select("chunk_id", "v").mapInArrow(search, _schema(vectors, at)), vectors)


def lists(best: Best, at: list):
    question, ids, scores = best.rows()
    for i in range(0, len(question), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array([at[j] for j in question[i : i + 100_000]]), id_column(ids[i : i + 100_000]), pa.array(scores[i : i + 100_000])], ["query_id", "chunk_id", "score"])


def _schema(rows: DataFrame, at: list) -> str:
    """Whole numbers of any size go to Python and back as long."""
    kind = "string" if rows.schema["chunk_id"].dataType.simpleString() == "string" else "long"
    return f"query_id {'string' if at and isinstance(at[0], str) else 'long'}, chunk_id {kind}, score double"


def _typed(found: DataFrame, rows: DataFrame) -> DataFrame:
    return found.withColumn("chunk_id", F.col("chunk_id").cast(rows.schema["chunk_id"].dataType))


def scored_by_terms(docs: DataFrame, questions: list, weights: dict[str, float], avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, chunk_id, score) of each task's k best documents by BM25, to 6 places, over whole texts.

    questions: rows (query_id, terms: how often each term is asked), a bounded part of a stated set;
    weights: the idf of the asked terms. Each text is read once; its asked terms are counted in place, and
    nothing of it leaves the task. A document without any asked term has score 0, and counts.
    """
    at, numbers = [r[0] for r in questions], {t: i for i, t in enumerate(weights)}
    asks = sorted((numbers[t], j, weights[t] * n) for j, (_, terms) in enumerate(questions) for t, n in terms.items() if t in numbers)
    asked = tuple(np.array(x, dtype=d) for x, d in zip(zip(*asks) if asks else ((), (), ()), (np.int64, np.int64, float)))
    shared = docs.sparkSession.sparkContext.broadcast((at, numbers, asked))

    def search(batches):
        import re
        from collections import Counter

        at, numbers, (term, question, weight) = shared.value
        # Words that many questions ask for are a matrix product; of the others each match is added by itself.
        often = np.bincount(term, minlength=len(numbers))
        often = np.flatnonzero(often >= max(8, np.sort(often)[-min(len(often), CELLS // max(1, len(at))) :].min(initial=0)))
        column = np.full(len(numbers), -1)
        column[often] = np.arange(len(often))
        table, common = np.zeros((len(often), len(at))), column[term] >= 0
        np.add.at(table, (column[term[common]], question[common]), weight[common])
        term, question, weight = term[~common], question[~common], weight[~common]
        first = np.searchsorted(term, np.arange(len(numbers) + 1))
        best, words, size = Best(len(at), k), re.compile("[a-z0-9]+"), max(k, min(1024, CELLS // max(1, len(at))))
        for ids, part in sorted_blocks(batches, size):
            doc, seen, tf, dl = [], [], [], []
            for i, text in enumerate(part["text"].to_pylist()):
                found = words.findall(text or "")
                held = Counter(filter(numbers.__contains__, found))
                doc += [i] * len(held)
                seen += map(numbers.__getitem__, held)
                tf += held.values()
                dl += [len(found)] * len(held)
            doc, seen, tf, dl = (np.array(x, dtype=np.int64) for x in (doc, seen, tf, dl))
            part_w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            held, known = np.zeros((len(ids), len(often))), column[seen] >= 0
            held[doc[known], column[seen[known]]] = part_w[known]
            scores = np.ascontiguousarray((held @ table).T).ravel()
            many = first[seen + 1] - first[seen]
            cuts = np.searchsorted(np.cumsum(many), np.arange(CELLS, int(many.sum()) + CELLS, CELLS))
            for i in np.split(np.arange(len(seen)), cuts):
                if len(i):
                    ask = np.repeat(first[seen[i]] - (np.cumsum(many[i]) - many[i]), many[i]) + np.arange(int(many[i].sum()))
                    np.add.at(scores, question[ask] * len(ids) + np.repeat(doc[i], many[i]), weight[ask] * np.repeat(part_w[i], many[i]))
            best.take(0, np.round(scores.reshape(len(at), len(ids)), 6), ids)
        yield from lists(best, at)

    return _typed(docs.select("chunk_id", F.lower("text").alias("text")).mapInArrow(search, _schema(docs, at)), docs)
