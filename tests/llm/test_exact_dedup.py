"""Exact duplicates: the query against SQL, spilling, and odd rows."""

import hashlib
import random

import pytest

from tests.llm.brute import lower
from tidewire.llm import exact_dedup


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(lower(text), []).append(key)
    out = []
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        kept = False
        for key in keys:
            stays = key == best and not kept
            kept |= stays
            out.append((key, best, len(keys), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("memory", [exact_dedup.MEMORY, 400])
def test_groups(spark, memory):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Abc", "aBC", "", None, "É x", "é x", "long " * 40, f"own {i % 37}"])) for i in range(400)]
    rows += [(7, "Abc"), (None, "abc"), (None, "nobody"), (None, "nobody"), (400, "same"), (400, "same"), (401, "y" * 100_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, rep string").repartition(5)
    got = sorted((tuple(r) for r in exact_dedup.deduplicate(docs, memory=memory).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute(rows)
    assert exact_dedup.deduplicate(docs.limit(0)).collect() == []


def test_spilled_groups_stay_whole():
    texts = [f"t{i % 50}".encode() * (1 + i % 3) for i in range(2000)]
    records = iter([(t, (1,)) for t in texts])
    seen = list(exact_dedup.grace(records, lambda t: [0], lambda s, v: (s.__setitem__(0, s[0] + 1), iter(()))[1], lambda t, s: [(t, s[0])], memory=1000))
    assert len(seen) == len(set(texts)) and sum(n for _, n in seen) == 2000
