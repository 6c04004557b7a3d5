"""Passages that lie across chunks, and across tasks, without a file being put together."""

import random

from quernspark.functions import text as T
from quernspark.operators import validate

from pyspark.sql import functions as F


def test_same_as_files_put_together(spark):
    rng, rows = random.Random(3), []
    for i in range(3000):
        words = [rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.choice((0, 1, 2, 30)))]
        rows.append((f"f{i % 3}", i // 2, rng.choice(("  ", "\n")).join(words) if i % 50 else None))
    chunks = spark.createDataFrame(rows, "source string, pos long, text string").repartition(7)
    whole = chunks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    whole = {r.source: r.w for r in whole.select("source", T.norm_blanks(F.array_join(F.transform("c", lambda c: c["text"]), " ")).alias("w")).collect()}
    asked = {"a", "zz", whole["f0"][:400], whole["f1"][-300:], "a b"}
    for _ in range(300):
        w = whole[f"f{rng.randint(0, 2)}"]
        at = rng.randint(0, len(w) - 300)
        p = w[at : at + rng.choice((5, 12, 40, 250))].strip()
        asked |= {p, p[:-1].strip() + "e"}
    asked.discard("")
    frame = spark.createDataFrame([(p,) for p in asked], "passage string")
    want = {(f, p) for f, w in whole.items() for p in asked if p in w}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 8 stretches, also of so few rows
    try:
        for most in (16 << 20, 9000):
            got = [tuple(r) for r in validate.in_files(frame, chunks, most).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    short = spark.createDataFrame([("b",)], "passage string")
    assert {tuple(r) for r in validate.in_files(short, chunks).collect()} == {(f, "b") for f in whole}
