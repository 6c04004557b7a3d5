"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides. Features: lengths, depth, digit ratio, entropy,
numbers of parameters, and how often labelled URLs whose host has the same last label, or the same
last two, are blocked. Those rates are out of fold: a labelled URL's own fold of hosts (FOLDS, by a
hash of the host) does not count towards its rates, so that no row's features hold its own label. At
most about MAX_TRAIN labelled rows (chosen by a hash of the URL) are used for fitting the trees;
suffix statistics count all labelled rows, and every URL is judged.

Defined cases: a null URL, or one without "://", has empty host and path, fits no rule and is judged
by the trees; if the labelled rows know one verdict only, that is the verdict of the rest; without
labelled rows the verdict is allow. Repeated rows are judged alike; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: (rule, verdict); a rule is a host, and from the first / on the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_TRAIN, SMOOTH, FOLDS = 50_000, 20.0, 4
SUFFIXES = ("suffix1", "suffix2")
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "path_entropy",
    "hyphens", "parameters", "query_length", "fragment", "secure", *(f"{name}_rate" for name in SUFFIXES),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the path)."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, F.substr(after, F.length(path) + 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are part of the plan, so keep them to a few hundred."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    each = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def lexical(url: Column, host: Column, path: Column, rest: Column) -> list[Column]:
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    n = F.length(url)
    counted = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)
    made = {
        "url_length": n, "host_length": F.length(host), "path_length": F.length(path), "depth": counted(path, "/"), "labels": counted(host, "."),
        "digit_ratio": F.when(n > 0, digits(url) / n).otherwise(0.0), "host_digits": digits(host),
        "entropy": entropy(url), "path_entropy": entropy(path), "hyphens": counted(host, "-"),
        "parameters": F.when(query == "", 0).otherwise(counted(query, "&") + 1), "query_length": F.length(query), "fragment": rest.contains("#").cast("int"), "secure": url.startswith("https").cast("int"),
    }
    return [v.cast("double").alias(k) for k, v in made.items()]


def labelled_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key="page_id", url="url") -> DataFrame:
    """Every row with host, path, by_rule, label (1.0: a rule blocks it; null: no rule), fold, suffixes and features of its form."""
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    host, path, rest = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path, "rest": rest})
    rows = rows.withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    blocked = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule.verdict") == "block").cast("double"))
    fold = F.pmod(F.xxhash64("host", F.lit(3)), F.lit(FOLDS)).cast("int")
    suffixes = [F.substring_index("host", ".", -i).alias(name) for i, name in enumerate(SUFFIXES, 1)]
    form = lexical(F.col("url"), F.col("host"), F.col("path"), F.col("rest"))
    return stash(rows.select("key", "host", "path", "by_rule", blocked.alias("label"), fold.alias("fold"), F.xxhash64("url").alias("pick"), *suffixes, *form), "urls")


def with_rates(rows: DataFrame, prior: float) -> DataFrame:
    """rows with a vector of all features. The rate of a suffix is that of the labelled rows outside a labelled
    row's fold; a row without a label has no fold of its own. Hot suffixes are one row a task before the shuffle."""
    known = rows.where("label is not null")
    for name in SUFFIXES:
        held = known.groupBy(name, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        sums = held.groupBy(name).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("folds"))
        rows = rows.join(stash(sums, "urls"), name, "left")
        own = F.when(F.col("label").isNotNull(), F.col("folds")[F.col("fold")])
        left = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0))
        rows = rows.withColumn(f"{name}_rate", (left("s") + SMOOTH * prior) / (left("n") + SMOOTH)).drop("s", "n", "folds")
    return stash(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("key", "host", "path", "by_rule", "label", "fold", "pick", "features"), "urls")


def fit_trees(train: DataFrame, n: int, max_train: int = MAX_TRAIN, trees: int = 15, depth: int = 4):
    """Gradient-boosted trees on n rows (features, label, pick), or on about max_train of them."""
    if n > max_train:
        train = train.where(F.pmod("pick", F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    train = train.select("features", "label").coalesce(max(1, min(8, n // 5000)))
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=32).fit(train)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key="page_id", url="url", max_train: int = MAX_TRAIN, trees: int = 15, depth: int = 4) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) of every row; block_score is null where a rule decides."""
    rows = labelled_urls(pages, rules, key, url)
    n, blocked = rows.where("label is not null").agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, n):
        rest = F.lit("block" if n and blocked else "allow")
        return rows.select("key", "host", "path", "by_rule.rule", F.coalesce("by_rule.verdict", rest).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    rows = with_rates(rows, blocked / n)
    model = fit_trees(rows.where("label is not null"), n, max_train, trees, depth)
    judged = model.transform(rows.where("label is null")).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.when(F.col("prediction") == 1, "block").otherwise("allow").alias("verdict")
    judged = judged.select("key", "host", "path", F.lit(None).cast("string").alias("rule"), verdict, "block_score")
    ruled = rows.where("label is not null").select("key", "host", "path", "by_rule.rule", "by_rule.verdict", F.lit(None).cast("double").alias("block_score"))
    return ruled.unionByName(judged)


def op3_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("key", "page_id")
