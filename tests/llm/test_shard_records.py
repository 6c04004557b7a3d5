"""op8_shard moves whole records: what it reports is read from the shards that it wrote."""

import zlib
from collections import Counter

from quernspark.llm import sharding

SF = "/root/testdata/sf0.001"


def test_query_writes_whole_records(spark, monkeypatch):
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda *a, **b: paths.append(write(*a, **b)) or paths[-1])
    got = sharding.op8_shard(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = spark.read.parquet(paths[0])
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    raw = [(r, (r.text or "").encode()) for r in back.collect()]
    want = Counter((r.doc_id, len(t) + 1, zlib.crc32(t), "key", r["__shard"], r.slot, r.grown_shard) for r, t in raw)
    assert Counter(map(tuple, got)) == want
    slots = {}
    for r in got:
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert sharding.read_shards(spark, sharding.write_shards(none), none.schema).count() == 0


def test_names_that_we_use_and_types_without_order(spark):
    rows = [(i, f"t{i}", i, "g", -i, 1.5, {"a": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long, Grown_Shard string, __shard int, __size double, m map<string, int>")
    back = sharding.read_shards(spark, sharding.write_shards(docs), docs.schema)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    held = {}
    for r in back.collect():
        held.setdefault(r["___shard"], []).append(r["_slot"])
    assert all(sorted(x) == list(range(len(x))) for x in held.values()) and sum(map(len, held.values())) == 40
