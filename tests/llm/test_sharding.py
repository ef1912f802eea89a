"""Shards: near equal bytes, whole groups, gapless slots, odd rows."""

import zlib

from tidewire.llm import sharding


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    weight, slots, groups = {}, {}, {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        weight[r.shard] = weight.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    mean = sum(weight.values()) / 16
    assert set(weight) == set(range(16)) and max(weight.values()) < 1.1 * mean and min(weight.values()) > 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(g) > 1 for g in groups.values()) == 0


def test_hot_group_is_divided(spark):
    rows = [(i, "copy " * 30, "s", "en") for i in range(600)] + [(1000 + i, f"{i} " * (20 + i % 30), f"s{i % 4}", "de") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    weight = {r.shard: r.bytes for r in sharding.shard(docs, shards=8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()}
    assert len(weight) == 8 and max(weight.values()) < 1.25 * sum(weight.values()) / 8


def test_edges(spark):
    rows = [(1, None, None, None, 1), (1, None, None, None, 1), (None, "", "s", "en", 2), (3, "x" * 300_000, "s", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, node int")
    got = sorted((r["size"], r.text_crc32) for r in sharding.shard(docs).collect())
    assert [g[0] for g in got] == [1, 1, 1, 300_001] and got[0][1] == 0
    assert sharding.shard(docs.limit(0)).collect() == []
