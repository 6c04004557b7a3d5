"""Line dedup: winnowing over hashes of words in a row.

A run of words counts as repeated if it has at least min_words words in a row and an earlier place
has the same ones, whatever lines they stand in: passages also begin and end inside lines. Of each
min_words words in a row, the part of half as many words with the least hash is selected (of equal
ones the last): the guaranteed fingerprint. The same words have the same fingerprint in every text,
so a run of min_words words is repeated only if its fingerprint is met twice.

1. Documents are numbered in the order of their ids. A document whose whole text an earlier one has
   is a copy: each of its runs is repeated, so nothing of it needs to be looked up.
2. Fingerprints of all texts. Those met in one place only go. Each run of min_words words whose
   fingerprint is one of the others gets a hash of its own words.
3. A run of min_words words whose hash has an earlier place is deleted at the later one: each run is
   held against the first place of the whole run, so it does not matter how often its parts stand
   elsewhere before, and the number of rows stays linear however common a passage is. Touching runs
   grow together, both ways, to all that is repeated.
4. Places are ordered by document, then by word; where a run overlaps its first place in the same
   document, that place's min_words words stay.

First places are aggregated before the shuffle and written; they are joined with all places by
sorting and merging, where adaptive execution can split a common passage's rows.

No repeated run is missed. Runs are told apart by hashes of 64 bits, copies by 128 bits.

Defined cases: null texts stay null; empty texts and texts of fewer words stay as they are; rows
that repeat an id and a text are one document, and get the same result; ids that are null come
first, texts under one id in the order of their hashes; an empty table gives an empty result;
columns of any name stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash, text_key
from .words import Words, least_places, run_hashes, slices, stretch_hashes

MIN_WORDS = 50


def winnowed(texts: pa.Array, n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their hashes, place of the fingerprint of each n successive words, hash of each possible fingerprint).

    The place is that of the fingerprint's first word, or -1 where the n words are not in one text.
    """
    words, part = Words(texts), max(1, n // 2)
    hashes = words.hashes()
    parts = run_hashes(hashes, part)
    return words, hashes, np.where(words.whole(n), least_places(parts, n - part + 1), -1), parts


def repeats_inside(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row (text, hash), in ascending order of text and place, the first row that has both."""
    order = np.lexsort((hashes, text))  # stable: equal rows stay in order of place
    new = np.append(True, (np.diff(text[order]) != 0) | (np.diff(hashes[order]) != 0))[: len(order)]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(th, win, start, again) of the fingerprints of each row (th, text); again: the text has it twice."""

    def rows(batches):
        for batch in batches:
            for i, j in slices(batch["text"]):
                words, _, place, parts = winnowed(batch["text"][i:j], n)
                at = place[place >= 0]
                at = at[np.append(True, np.diff(at) != 0)[: len(at)]]  # places ascend
                text, win = words.text[at], parts[at]
                same = repeats_inside(text, win)
                th = batch["th"][i:j].to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(th), pa.array(win.view(np.int64)), pa.array((at - words.first[text]).astype(np.int32)), pa.array(same != np.arange(len(at)))], ["th", "win", "start", "again"])

    return docs.select("th", "text").mapInArrow(rows, "th long, win long, start int, again boolean")


def run_rows(docs: DataFrame, n: int) -> DataFrame:
    """(num, hash, at, own) of each row (num, text, starts): the runs of n words whose fingerprints begin at
    one of starts; own is the first place of the same run in the document."""

    def rows(batches):
        for batch in batches:
            for i, j in slices(batch["text"]):
                words, hashes, place, _ = winnowed(batch["text"][i:j], n)
                starts = batch["starts"][i:j]
                asked = np.zeros(len(words.starts) + 1, dtype=bool)
                asked[np.repeat(words.first[:-1], starts.value_lengths().to_numpy()) + starts.flatten().to_numpy()] = True
                at = np.flatnonzero((place >= 0) & asked[place])
                text, run = words.text[at], stretch_hashes(hashes, at, at + n)
                own = at[repeats_inside(text, run)] if len(at) else at
                num = batch["num"][i:j].to_numpy()[text]
                here = [pa.array((x - words.first[text]).astype(np.int32)) for x in (at, own)]
                yield pa.RecordBatch.from_arrays([pa.array(num), pa.array(run.view(np.int64)), *here], ["num", "hash", "at", "own"])

    return docs.select("num", "text", "starts").mapInArrow(rows, "num long, hash long, at int, own int")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, th, num, copy) of each document (doc, th, th2): num ascends with doc and th; copy: an earlier one has its text."""
    ids = docs.select("doc", "th", "th2").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc").asc_nulls_first(), F.col("th"))
    ids = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ids = stash(ids.withColumn("num", F.monotonically_increasing_id()), "lines")
    first = ids.groupBy("th", "th2").agg(F.min("num").alias("first"), F.max("num").alias("last")).where("first < last").drop("last")
    ids = ids.join(stash(first, "lines").hint("merge"), ["th", "th2"], "left")
    return stash(ids.select("doc", "th", "num", F.coalesce(F.col("num") > F.col("first"), F.lit(False)).alias("copy")), "lines")


def repeated_runs(docs: DataFrame, key="doc_id", text="text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, copy, runs) of the documents with something to delete: of each run of min_words words the first
    and last word that goes (lo, hi; counted from 0). Of a copy all goes. th is text_key of the text."""
    base = docs.select(F.col(key).cast("long").alias("doc"), text_key(F.col(text)).alias("th"), F.col(text).alias("text")).where("text is not null")
    ids = numbered(base.withColumn("th2", F.xxhash64(F.lit(2), "text")))
    place = stash(fingerprints(base, min_words), "lines")
    often = place.groupBy("win").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.max("again").alias("again")).where("a <> b or again").select("win")
    asked = place.join(stash(often, "lines").hint("merge"), "win", "left_semi").groupBy("th").agg(F.collect_set("start").alias("starts"))
    asked = asked.join(ids.where("not copy").hint("merge"), "th").select(F.col("doc").alias("a_doc"), F.col("th").alias("a_th"), "num", "starts")
    met = base.join(asked.hint("merge"), (F.col("th") == F.col("a_th")) & F.col("doc").eqNullSafe(F.col("a_doc")))
    rows = stash(run_rows(met, min_words), "lines")
    first = rows.groupBy("hash").agg(F.min("num").alias("f"), F.max("num").alias("l"), F.max(F.col("own") < F.col("at")).alias("again")).where("f < l or again").select("hash", "f")
    match = rows.join(stash(first, "lines").hint("merge"), "hash").where("num > f or own < at")
    lo = F.when(F.col("num") > F.col("f"), F.col("at")).otherwise(F.greatest("at", F.col("own") + min_words))
    match = match.select("num", lo.alias("lo"), (F.col("at") + min_words - 1).alias("hi")).where("lo <= hi")
    runs = match.groupBy("num").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return stash(ids.join(runs.hint("merge"), "num", "left").where("copy or runs is not null").select("doc", "th", "copy", "runs"), "lines")


def deleted(words: Words, gone: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the words in gone, first and last word of each run of them).

    The blanks after a run go with it; at the end of a text those before it.
    """
    text, n = words.text, len(gone)
    linked = gone[1:] & gone[:-1] & (text[1:] == text[:-1])
    lo = np.flatnonzero(gone & ~np.append(False, linked)[:n])
    hi = np.flatnonzero(gone & ~np.append(linked, False)[:n])
    opens, last = words.first[text[lo]], words.first[text[hi] + 1] - 1
    to = np.where(hi < last, words.starts[np.minimum(hi + 1, n - 1)], words.ends[hi])
    since = np.where(hi < last, words.starts[lo], np.where(lo > opens, words.ends[lo - 1], words.bounds[text[lo]]))
    step = np.zeros(len(words.data) + 1, dtype=np.int32)
    np.add.at(step, since, 1)
    np.add.at(step, to, -1)
    kept = np.cumsum(step[:-1]) == 0
    bounds = np.append(0, np.cumsum(kept))[words.bounds].astype(np.int32)
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.data[kept])))
    return out, lo, hi


def shorter(texts: pa.Array, copy: pa.Array, runs: pa.Array) -> pa.StructArray:
    """(text, lo, hi) of each text: without its runs, or without any word if it is a copy; null stays null."""
    words = Words(texts)
    n, many = len(words.starts), runs.value_lengths().fill_null(0).to_numpy()
    flat, at = runs.flatten(), np.repeat(words.first[:-1], many)
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, at + flat.field("lo").to_numpy(), 1)
    np.add.at(step, at + flat.field("hi").to_numpy() + 1, -1)
    gone = (np.cumsum(step[:n]) > 0) | copy.fill_null(False).to_numpy(zero_copy_only=False)[words.text]
    new, lo, hi = deleted(words, gone)
    text = words.text[lo]
    ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array((x - words.first[text]).astype(np.int32))) for x in (lo, hi)]
    return pa.StructArray.from_arrays([new, *lists], ["text", "lo", "hi"], mask=texts.is_null())


def cut(text: str, los, his) -> str:
    """text without words los[k] to his[k]."""
    runs = pa.array([[{"lo": lo, "hi": hi} for lo, hi in zip(los, his)]], pa.list_(pa.struct({"lo": pa.int32(), "hi": pa.int32()})))
    return shorter(pa.array([text]), pa.array([False]), runs)[0]["text"].as_py()


def without_runs(text: Column, copy: Column, runs: Column, min_words: int = MIN_WORDS) -> Column:
    """struct(text, lo, hi) of each text; of copies with fewer than min_words words nothing goes."""

    @F.arrow_udf("text string, lo array<int>, hi array<int>")
    def made(text: pa.Array, copy: pa.Array, runs: pa.Array) -> pa.Array:
        kind = pa.struct({"text": pa.string(), "lo": pa.list_(pa.int32()), "hi": pa.list_(pa.int32())})
        return pa.concat_arrays([pa.array([], kind), *[shorter(text[i:j], copy[i:j], runs[i:j]).cast(kind) for i, j in slices(text)]])

    return made(text, copy & (word_count(text) >= min_words), runs)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def dedup_lines(docs: DataFrame, key="doc_id", text="text", min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """(row, text, removed): row is the input's row, text the one without repeated runs, removed the
    numbers of its first and last words by run. drop_emptied leaves out documents that lose every word."""
    runs = repeated_runs(docs, key, text, min_words).select(F.col("doc").alias("r_doc"), F.col("th").alias("r_th"), "copy", "runs")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].cast("long").alias("doc"), text_key(docs[text]).alias("th"))
    # by sort and merge at every size: the runs grow with the documents, so they are never broadcast
    held = held.join(runs.hint("merge"), (F.col("th") == F.col("r_th")) & F.col("doc").eqNullSafe(F.col("r_doc")), "left")
    old, met = F.col(f"row.{text}"), F.col("copy").isNotNull()
    held = held.select("row", old.alias("old"), without_runs(F.when(met, old), F.col("copy"), F.col("runs"), min_words).alias("new"))
    gone = F.coalesce(F.arrays_zip("new.lo", "new.hi"), F.array().cast("array<struct<lo:int,hi:int>>"))
    out = held.select("row", F.coalesce("new.text", "old").alias("text"), gone.alias("removed"))
    return out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")) if drop_emptied else out


def without_repeated_lines(docs: DataFrame, key="doc_id", text="text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with shorter texts, in their own columns; documents that only repeat others go."""
    out = dedup_lines(docs, key, text, min_words, drop_emptied=True)
    return out.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"] + 1)
    return dedup_lines(docs).select("row.doc_id", "text", n_removed.alias("n_removed"), "removed")
