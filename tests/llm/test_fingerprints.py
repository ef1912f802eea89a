"""Fingerprints against plain Python."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq

from tidewire.llm import fingerprints as fp

ANCHORS = set(fp.ANCHORS)


def marks(text):
    if not text:
        return []
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    found, run = [], []
    for i, word in enumerate(words):
        if word in ANCHORS:
            chain = [w for w in words[i + 1 :] if w not in ANCHORS][: fp.CHAIN]
            if len(chain) == fp.CHAIN:
                found.append(" ".join(chain) + " ")
            run = []
        else:
            run.append(word)
            if len(run) == 4:
                found.append(" ".join(run) + " ")
                run = []
    if not found:
        found = [w + " " for w in words] or [text]
    return sorted({zlib.crc32(f.encode()) for f in found})


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def printed(ms):
    return "".join(f"{m:08X}" for m in ms)


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = marks(text), marks(edited), marks(after)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), jaccard(a, b), jaccard(a, c))
    return out


def found(docs):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.edited_pairs(docs).collect()}


def test_equal_to_plain_python(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted, got = expected(zip(table["doc_id"], table["text"], strict=True)), found(docs)
    assert got.keys() == wanted.keys()
    wrong = [k for k in got if got[k][:4] != wanted[k][:4] or any(abs(x - y) > 1e-9 for x, y in zip(got[k][4:], wanted[k][4:], strict=True))]
    assert not wrong
    assert sum(v[4] > v[5] for v in got.values()) > 0.97 * len(got)


def test_edges(spark):
    rows = [(1, "The end of the long red road. And"), (2, None), (3, ""), (4, "?!"), (5, "alone"), (6, "a b c d e f g h " * 3000)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in rows], "doc_id long, text string, likeness double")
    assert found(docs).keys() == {1, 2, 3, 4, 5, 6}
    assert found(docs)[3][4] == 1.0
    twice = docs.union(docs.where("doc_id = 1")).union(spark.createDataFrame([(None, "x y", 1.0)], docs.schema))
    assert fp.edited_pairs(twice).count() == 8
    assert fp.edited_pairs(docs.limit(0)).collect() == []


def test_texts_of_anchors_take_linear_time(spark):
    """Many anchors in a row: 200,000 of them would take hours if every anchor looked over the following ones."""
    texts = lambda n: ["the " * 4 * n, "the of " * 3 + "red end " + "der die das " * n + "last", "the red the blue of the green", "a the b the c the d", "the"]
    docs = spark.createDataFrame(list(enumerate(texts(50_000))), "i long, text string")
    got = fp.with_marks(docs, "text").orderBy("i").collect()
    # How often anchors repeat makes no difference.
    assert [list(r.marks) for r in got] == [marks(t) for t in texts(2)]


def test_similar_pairs(spark):
    sets = {i: sorted(set(range(i % 5, 20 + i)) - {3 * i}) for i in range(12)} | {50: [], 51: [], 52: sorted(set(range(0, 20)))}
    marked = spark.createDataFrame(list(sets.items()), "key long, marks array<long>")
    got = {(r.a, r.b) for r in fp.similar_pairs(marked, 0.75).collect()}
    seen = {}
    for key, s in sorted(sets.items()):
        seen.setdefault(tuple(s), key)
    alone = {k: s for s, k in seen.items() if s}
    assert got == {(a, b) for a in alone for b in alone if a < b and jaccard(alone[a], alone[b]) >= 0.75}


def test_likeness_of_unequal_lengths(spark):
    sets = [([1], list(range(100))), ([], [1, 2]), ([], []), ([500], list(range(100))), ([3, 4], list(range(1000)))]
    pairs = spark.createDataFrame(sets, "a array<long>, b array<long>").select("a", "b", fp.likeness(fp.F.col("a"), fp.F.col("b")).alias("x")).collect()
    assert all(abs(r.x - jaccard(r.a, r.b)) < 1e-12 for r in pairs)
