"""Gold expansion, run facts, judgements and the ablation table."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.tables import BATCH, kept
from .retrieve import sliced

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
REF_DEPENDENT = ("context_precision", "context_recall")
MODES = ("dense_only", "sparse_only", "hybrid", "hybrid_rerank")
MOST_BYTES = 16 << 20  # of passages that are looked for at once


def golds(examples: DataFrame) -> DataFrame:
    """A row for each accepted gold, primary first (gold_idx 0); none for unanswerable questions."""
    fields = ("ground_truth_answer", "source_passage", "source_file")
    first = F.array(F.struct(*fields))
    rest = F.coalesce(F.transform("alt_golds", lambda g: F.struct(*[g[f].alias(f) for f in fields])), F.array().cast(f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"))
    rows = examples.where("query_type <> 'unanswerable'").select("id", "query_type", F.posexplode(F.concat(first, rest)).alias("gold_idx", "g"))
    return rows.select("id", "query_type", "gold_idx", "g.*", T.reference(F.col("g.ground_truth_answer"), F.col("g.source_passage")).alias("reference"))


def worklist(modes: DataFrame, examples: DataFrame, done: DataFrame) -> DataFrame:
    """(mode, id) still to run: modes is a handful of rows."""
    return examples.select("id").join(F.broadcast(modes.select("mode"))).join(done.select("mode", "id"), ["mode", "id"], "left_anti")


def number(c: str):
    """NaN counts as missing, as in data frames of the other kind."""
    return F.when(~F.isnan(c), F.col(c))


def collapse_references(judged: DataFrame, metrics=METRICS) -> DataFrame:
    """One row an id: the best reference for metrics that depend on it, else the first one's value."""
    made = [(F.max(number(m)) if m in REF_DEPENDENT else F.min_by(number(m), "gold_idx")).alias(m) for m in metrics]
    return judged.groupBy("mode", "id").agg(*made)


def poison(judged: DataFrame, metrics=METRICS) -> DataFrame:
    return judged.agg(*[F.count_if(F.col(m).isNull() | F.isnan(m)).alias(m) for m in metrics])


def call_budget(runs: DataFrame) -> DataFrame:
    """(calls of the strong judge, of the light one): n * (2 + 1 + k) and n, k the most contexts of a run."""
    k = F.coalesce(F.max(F.size("contexts")), F.lit(5))
    return runs.agg((F.count("*") * (3 + k)).alias("strong"), F.count("*").alias("light"))


def rescored(old: DataFrame, new: DataFrame, least: float = 1e-9) -> DataFrame:
    """Changes of the metrics that depend on references, where they differ."""
    both = old.alias("o").join(new.alias("n"), ["mode", "id"])
    moved = [(F.col(f"n.{m}") - F.col(f"o.{m}")).alias(m) for m in REF_DEPENDENT]
    out = both.select("mode", "id", *moved)
    return out.where(F.exists(F.array(*REF_DEPENDENT), lambda x: F.abs(x) > least))


def average_precision(verdicts: DataFrame, keys=("mode", "id")) -> DataFrame:
    """Context precision of (keys, rank, relevant): mean of precision at the relevant ranks, 0 without any."""
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = verdicts.withColumn("p", F.sum("relevant").over(upto) / F.col("rank"))
    return at.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("relevant")), F.sum("relevant")), F.lit(0.0)).alias("context_precision"))


def verdict_share(verdicts: DataFrame, name: str, keys=("mode", "id")) -> DataFrame:
    """Faithfulness, relevancy or recall: the share of claims or sentences that hold; 0 without any."""
    return verdicts.groupBy(*keys).agg(F.coalesce(F.avg("holds"), F.lit(0.0)).alias(name))


def run_facts(runs: DataFrame, golds_: DataFrame) -> DataFrame:
    """file_hit and passage_hit by any accepted gold (null for unanswerable), refused, answerable.

    runs: (mode, id, answer, sources, contexts). Passages are looked for in the run's own contexts,
    joined by a blank, so a pair of texts is compared only where the ids agree, and once for each
    different passage, however many files hold it.
    """
    shown = F.array_sort(F.collect_list(F.struct("gold_idx", "source_file", "source_passage")))
    held = golds_.groupBy("id").agg(F.collect_set("source_file").alias("files"), F.collect_set("source_passage").alias("passages"), shown.alias("shown"))
    held = held.withColumn("passages", F.array_distinct(F.transform("passages", T.norm)))
    text = runs.select("mode", "id", "sources", T.norm(F.array_join("contexts", " ")).alias("text"))
    within = F.coalesce(F.exists("passages", lambda p: (p != "") & F.contains("text", p)), F.when(F.array_contains("passages", ""), False))
    hit = text.join(held, "id").select(
        "mode", "id",
        F.when(F.size("files") > 0, F.exists("files", lambda f: F.array_contains("sources", f))).alias("file_hit"),
        F.when(F.size("passages") > 0, within).alias("passage_hit"),
        T.golds_shown(F.col("shown"), "source_file").alias("gold_source"), T.golds_shown(F.col("shown"), "source_passage").alias("gold_passage"),
    )
    rows = runs.select("mode", "id", T.is_refusal(F.col("answer")).alias("refused"), "answer", "sources").join(hit, ["mode", "id"], "left")
    return rows.withColumn("answerable", F.col("file_hit").isNotNull())


def ablation(facts: DataFrame, judged: DataFrame, modes: DataFrame) -> DataFrame:
    """One row a mode, in the given order, also for modes without rows."""
    means = judged.groupBy("mode").agg(*[F.bround(F.avg(number(m)), 4).alias(m) for m in METRICS])
    rest = facts.groupBy("mode").agg(
        F.bround(F.avg(F.when(~F.col("answerable"), F.col("refused").cast("int"))), 4).alias("refusal_rate_unanswerable"),
        F.bround(T.percentile(F.col("latency_ms"), 0.5)).alias("latency_p50_ms"), F.bround(T.percentile(F.col("latency_ms"), 0.95)).alias("latency_p95_ms"),
        F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_unanswerable"),
    )
    return modes.join(means, "mode", "left").join(rest, "mode", "left").orderBy("ord")


def contained_in(passages: DataFrame, docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, doc_id): the normalised passage lies in the normalised document, wherever it begins and ends.

    All passages together are one automaton (Aho and Corasick, 1975), so each document is read once, whatever
    the number and length of the passages. They are a stated set: about most_bytes of them are sent to the
    tasks at once, and more are taken in slices. Blank passages are in no document, null ids stay null.
    """
    p = passages.select("item_id", T.norm(F.col("text")).alias("p")).where("p <> ''")
    size, many = p.agg(F.sum(F.octet_length("p")), F.count("*")).first()
    found, types = [], {"item_id": passages.schema["item_id"].dataType, "doc_id": docs.schema["doc_id"].dataType}
    for part in sliced(p, "item_id", max(1, many * most_bytes // max(1, size or 0))) if many else []:
        found.append(kept(_held(docs, [(r["p"], r["item_id"]) for r in part.collect()], types), "held", BATCH))
    if not found:
        return docs.select(F.lit(None).cast(types["item_id"]).alias("item_id"), "doc_id").where("false")
    return reduce(DataFrame.unionByName, found).distinct()


def _held(docs: DataFrame, passages: list[tuple[str, object]], types: dict) -> DataFrame:
    ids: dict[str, list[int]] = {}
    for i, (text, _) in enumerate(passages):
        ids.setdefault(text, []).append(i)
    items = [i for _, i in passages]
    shared = docs.sparkSession.sparkContext.broadcast((ids, items))

    def search(batches):
        import ahocorasick

        ids, items = shared.value
        machine = ahocorasick.Automaton()
        for text, at in ids.items():
            machine.add_word(text, at)
        machine.make_automaton()
        for batch in batches:
            hits = [(row, item) for row, text in enumerate(batch["d"].to_pylist()) if text for item in {i for _, at in machine.iter(text) for i in at}]
            rows, which = zip(*hits) if hits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in which], item_type), batch["doc_id"].take(pa.array(rows, pa.int64()))], ["item_id", "doc_id"])

    item_type = to_arrow_type(types["item_id"])
    return docs.select("doc_id", T.norm(F.col("text")).alias("d")).mapInArrow(search, f"item_id {types['item_id'].simpleString()}, doc_id {types['doc_id'].simpleString()}")
