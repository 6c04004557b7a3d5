"""Reading and writing the corpus, the evaluation set, runs, judgements and indices."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import page

GOLD = "ground_truth_answer string, source_passage string, source_file string"
EVAL = f"id string, question string, {GOLD}, query_type string, alt_golds array<struct<{GOLD.replace(' string', ': string')}>>, gold_note string"
RUN = "id string, mode string, query_type string, question string, answer string, contexts array<string>, sources array<string>, timings struct<retrieval_ms: double, rerank_ms: double, generation_ms: double, total_ms: double>"
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
JUDGED = "id string, query_type string, user_input string, response string, reference string, faithfulness double, answer_relevancy double, context_precision double, context_recall double"
MODES = ("dense_only", "sparse_only", "hybrid", "hybrid_rerank")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(source, title, text, raw, html, pos): HTML files by name, then Markdown; files without text are left out.

    Bytes that are not UTF-8 are dropped, not replaced. Only names are numbered in one task.
    """

    @F.arrow_udf("string")
    def decode(content: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", errors="ignore") for x in content.to_pylist()], pa.string())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,md}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("source"), decode("content").alias("raw"))
    html = F.col("source").endswith(".html")
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    rows = rows.withColumn("page", page(F.when(html, F.col("raw"))))
    title = F.when(html & (F.col("page.title") != ""), F.col("page.title")).otherwise(stem)
    plain = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    rows = rows.select("source", title.alias("title"), F.when(html, F.col("page.text")).otherwise(plain).alias("text"), "raw", html.alias("html")).where("text <> ''")
    numbers = rows.select("source", (F.row_number().over(Window.orderBy(F.desc("html"), "source")) - 1).alias("pos"))
    return rows.join(numbers, "source")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).option("multiLine", True).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing is stored yet; anything else is an error
            raise
        return spark.createDataFrame([], schema)


def read_judged(spark: SparkSession, folder: str, modes=MODES) -> DataFrame:
    """The judgements of each mode that has a file, under column mode. Columns are found by their names in the
    file's header, in any order (metrics by a part of the name); a file that lacks one is an error."""
    out = spark.createDataFrame([], JUDGED + ", mode string")
    for mode in modes:
        try:
            one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/judged_{mode}.csv")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                continue
            raise
        if missing := {"id", "query_type"} - set(one.columns):
            raise KeyError(f"judged_{mode}.csv has no column {sorted(missing)}")
        text = [F.col(c) if c in one.columns else F.lit(None).cast("string").alias(c) for c in ("id", "query_type", "user_input", "response", "reference")]
        out = out.unionByName(one.select(*text, *[F.col(T.metric_column(one.columns, m)).cast("double").alias(m) for m in METRICS], F.lit(mode).alias("mode")))
    return out


def rebuild(df: DataFrame, path: str, *by: str) -> None:
    """An index is replaced as a whole, never appended to; by: columns that become folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


BATCH = 500  # whole texts that a Python worker is given at once
_own_dir: str | None = None


def kept(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df written once to a folder that all executors share, and read again: several plans can start from it.
    batch: rows that a Python worker is given at once while df is made, where they are whole texts.

    The folder is spark.checkpoint.dir; only a local session without that setting, as in tests, gets one of its own.
    """
    global _own_dir
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own_dir
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        if batch:
            spark.conf.set(setting, batch)
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("mode").parquet(path)


def write_judged(judged: DataFrame, path: str, metrics=METRICS) -> str:
    """Complete judgements to path; with any missing metric to path.PARTIAL, and then an error."""
    from ..operators.evaluate import poison

    bad = poison(judged, metrics).first()
    name = path if not any(bad) else f"{path}.PARTIAL"
    judged.write.mode("overwrite").option("header", True).option("escape", '"').csv(name)
    if any(bad):
        raise ValueError(f"missing metrics {bad.asDict()}; kept in {name}")
    return name


def patch(old: DataFrame, new: DataFrame, columns, key="id") -> DataFrame:
    """old with the given columns replaced where new has the row. A missing value in new is refused: nothing is patched."""
    from ..operators.evaluate import poison

    keys = [key] if isinstance(key, str) else list(key)
    bad = poison(new, columns).first()
    if any(bad):
        raise ValueError(f"missing scores {bad.asDict()}; nothing is patched")
    fresh = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = old.join(fresh, keys, "left")
    return out.select(*[(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c)) for c in old.columns])


def write_table(table: DataFrame, path: str) -> None:
    """A table of one row a mode, as one CSV file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(title: str, df: DataFrame, most: int = 2000) -> str:
    """A section of a report. Beyond most rows the section says how many are left out; the table itself has them."""
    rows = df.limit(most + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + [f"\n{df.count() - most} rows more"] * (len(rows) > most)) + "\n"
