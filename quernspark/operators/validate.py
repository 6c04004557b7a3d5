"""Data-quality rules over an evaluation set: a row for each broken rule."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import BATCH, kept
from .evaluate import MOST_BYTES, golds
from .retrieve import sliced

REQUIRED = ("id", "question", "ground_truth_answer", "source_passage", "source_file", "query_type")
TARGETS = {"simple": (20, 25), "keyword_heavy": (10, 10), "paraphrase_heavy": (10, 10), "unanswerable": (10, 10)}  # fixed values


def violations(examples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem). chunks: (source, pos, text); a passage may span chunks, as they are joined by a blank."""
    found = [examples.where(F.col(c).isNull()).select("id", F.lit(f"missing {c}").alias("problem")) for c in REQUIRED]
    nth = F.row_number().over(Window.partitionBy("id").orderBy("question"))
    found.append(examples.where("id is not null").withColumn("nth", nth).where("nth > 1").select("id", F.lit("duplicate id").alias("problem")))
    found.append(examples.where(~F.col("query_type").isin(*TARGETS)).select("id", F.lit("unknown type").alias("problem")))
    found.append(examples.where(T.norm_blanks(F.col("question")) == "").select("id", F.lit("blank question").alias("problem")))
    none = examples.where("query_type = 'unanswerable'")
    found.append(none.where(T.norm_blanks(F.col("ground_truth_answer")) != T.REFUSAL).select("id", F.lit("answer of an unanswerable question").alias("problem")))
    found.append(none.where("source_passage <> '' or source_file <> ''").select("id", F.lit("source of an unanswerable question").alias("problem")))
    gold = golds(examples)
    blank = {"ground_truth_answer": "blank answer", "source_passage": "blank passage"}
    found += [gold.where(T.norm_blanks(F.coalesce(c, F.lit(""))) == "").select("id", F.lit(problem).alias("problem")) for c, problem in blank.items()]
    found.append(gold.join(chunks.select(F.col("source").alias("source_file")).distinct(), "source_file", "left_anti").select("id", F.lit("file not in corpus").alias("problem")))
    asked = gold.select("id", "source_file", T.norm_blanks(F.col("source_passage")).alias("passage")).where("passage <> ''")
    asked = asked.join(chunks.select(F.col("source").alias("source_file")).distinct(), "source_file", "left_semi")
    away = asked.join(in_files(asked.select("passage").distinct(), chunks), ["source_file", "passage"], "left_anti")
    found.append(away.select("id", F.lit("passage not in file").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def in_files(passages: DataFrame, chunks: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(source_file, passage): the passage lies in the file's chunks, in order of pos and joined by a blank.

    No file is put together. Chunks are sorted by (source, pos) over all tasks; each task reads its stretch once, looks
    for all passages by one automaton, and takes the end of a chunk along to the next one of the file: as much as a
    passage may reach back. Of each file it hands on the stretch's first and last so many characters, and these meet in
    order, a few rows a task, for passages that lie across tasks. Passages are a stated set, sent in slices of about most_bytes.
    """
    rows = chunks.where("source is not null").select("source", "pos", "text").repartitionByRange("source", "pos", "text")
    rows = rows.sortWithinPartitions("source", "pos", "text").select("source", T.norm_blanks(F.col("text")).alias("d")).where("d <> ''")
    size, many = passages.agg(F.sum(F.octet_length("passage")), F.count("*")).first()
    found = [_in_stretches([r["passage"] for r in part.collect()], rows) for part in (sliced(passages, "passage", max(1, many * most_bytes // max(1, size or 0))) if many else [])]
    return reduce(DataFrame.unionByName, found) if found else chunks.select(F.col("source").alias("source_file"), F.lit("").alias("passage")).where("false")


def _in_stretches(passages: list[str], rows: DataFrame) -> DataFrame:
    shared, reach = rows.sparkSession.sparkContext.broadcast(passages), max(map(len, passages)) - 1

    def machine():
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, p in enumerate(shared.value):
            made.add_word(p, i)
        made.make_automaton()
        return made

    def out(rows):
        # source, number of a passage that is found or null, and of an end: the stretch, its place there and the text
        return pa.RecordBatch.from_pylist([dict(zip(("source", "hit", "stretch", "last", "end"), r)) for r in rows], schema=pa.schema([("source", pa.string()), ("hit", pa.int32()), ("stretch", pa.int32()), ("last", pa.bool_()), ("end", pa.string())]))

    def search(batches):
        from pyspark import TaskContext

        made, number = machine(), TaskContext.get().partitionId()
        source, head, tail, whole, seen = None, "", "", True, set()

        def ends():  # whole: head is all of the stretch
            return [(source, None, number, False, head)] + ([] if whole else [(source, None, number, True, tail)]) if source is not None else []

        for batch in batches:
            told = []
            for at, d in zip(batch["source"].to_pylist(), batch["d"].to_pylist()):
                if at != source:
                    told += ends()
                    source, head, tail, whole, seen = at, "", "", True, set()
                text = f"{tail} {d}" if tail else d
                new = {i for _, i in made.iter(text)} - seen
                seen |= new
                told += [(source, i, None, None, None) for i in new]
                if whole:
                    head = f"{head} {d}" if head else d
                    whole, head = len(head) <= 2 * reach, head if len(head) <= 2 * reach else head[: reach or 1]
                tail = text[-reach:] if reach else ""
            yield out(told)
        yield out(ends())

    def across(key, group):
        import pandas as pd

        made, text, hits = machine(), "", set()
        group = group.sort_values(["stretch", "last"])
        for last, end in zip(group["last"], group["end"]):
            # between a stretch's first and last characters lies more than is known; no passage has this mark
            text = f"{text}\n{end}" if last else f"{text} {end}" if text else end
            hits |= {i for _, i in made.iter(text)}
            text = text[-reach:] if reach else ""
        return pd.DataFrame({"source": pd.Series([key[0]] * len(hits), dtype=object), "hit": pd.Series(sorted(hits), dtype="int32")})

    told = kept(rows.mapInArrow(search, "source string, hit int, stretch int, last boolean, end string"), "stretches", BATCH)
    spanning = told.where("end is not null").groupBy("source").applyInPandas(across, "source string, hit int")
    hits = told.where("hit is not null").select("source", "hit").unionByName(spanning).distinct()
    names = rows.sparkSession.createDataFrame(list(enumerate(passages)), "hit int, passage string")
    return hits.join(F.broadcast(names), "hit").select(F.col("source").alias("source_file"), "passage")


def type_counts(examples: DataFrame, targets=TARGETS) -> DataFrame:
    want = examples.sparkSession.createDataFrame([(k, *v) for k, v in targets.items()], "query_type string, low int, high int")
    return want.join(examples.groupBy("query_type").agg(F.count("*").alias("n")), "query_type", "left").fillna(0, "n").withColumn("ok", F.col("n").between(F.col("low"), F.col("high")))


def passes(examples: DataFrame, chunks: DataFrame, targets=TARGETS) -> bool:
    return violations(examples, chunks).isEmpty() and type_counts(examples, targets).where("not ok").isEmpty()
