"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

run(spark, sf_dir) applies STAGES to documents; each stage's result is written to the shared folder
and read again as the next stage's documents. A document that is mixed in more than once has its
pieces as often: sequence_id and offset tell them apart.

    spark-submit corpus_pipeline.py SF_DIR OUT
"""

import sys

from pyspark.sql import SparkSession

from quernspark.llm.langid import keep_known_languages
from quernspark.llm.linededup import without_repeated_lines
from quernspark.llm.mixing import mix_sources
from quernspark.llm.neardup import keep_one_of_near
from quernspark.llm.packing import default_vocabulary, pack_documents
from quernspark.llm.shared import stash, sweep


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or with no language that makes up half of the text, go."""
    return keep_known_languages(docs)


def line_dedup(spark, docs, sf_dir):
    """Later copies of runs of 50 words or more go; so do documents that are nothing else."""
    return without_repeated_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """Five-word shingles; documents at a similarity of 0.8 or more, by their whole sets of shingles, are copies."""
    return keep_one_of_near(docs, shingle=5, threshold=0.8)


def mixing(spark, docs, sf_dir):
    return mix_sources(docs)


def packing(spark, docs, sf_dir):
    return pack_documents(docs, default_vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language ID, near-dedup and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark, sf_dir, out):
    """run()'s rows as Parquet at out; the stages' tables go afterwards, also if a stage fails."""
    try:
        run(spark, sf_dir).write.parquet(out)
    finally:
        sweep(spark)


if __name__ == "__main__":
    write(SparkSession.builder.getOrCreate(), *sys.argv[1:])
