"""Near duplicates against all pairs."""

import pyarrow.parquet as pq

from tests.llm.brute import near_components
from tidewire.llm import near_dedup

FOLDER = "/root/testdata/sf0.01"


def test_components_equal_all_pairs(spark):
    table = pq.read_table(f"{FOLDER}/documents.parquet").select(["doc_id", "text"]).to_pydict()
    wanted = near_components(zip(table["doc_id"], table["text"], strict=True))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == wanted
    assert len({c for _, c in got.values()}) < len(got)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, base, 1), (2, base.upper(), 2), (3, base + " w40", 3), (4, "", 4), (5, None, 5), (6, "  \n", 6),
        (7, "one two", 7), (8, "ONE\ttwo", 8), (8, "ONE\ttwo", 8), (None, base, 9), (None, "alone here", 9), (10, "x " * 30000, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumnRenamed("node", "label")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=repr)
    wanted = [
        (1, 36, 1, True), (2, 36, 1, False), (3, 37, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False), (None, 36, 1, False), (None, 1, None, True), (10, 1, 10, True),
    ]
    assert got == sorted(wanted, key=repr)
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_strangers_in_a_bucket(spark, monkeypatch):
    # One band of one row makes every pair meet somewhere; chains and strangers must still come out right.
    texts = [" ".join(f"v{i + k}" for k in range(40)) for i in range(0, 30, 3)] + [" ".join(f"u{i}-{k}" for k in range(30)) for i in range(5)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_components(rows)


def test_blocks_of_a_divided_bucket(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(["p", "q", f"r{k}"])
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(base[:60] + [f"s{k}-{i}" for i in range(30 + k)])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_components(rows)
