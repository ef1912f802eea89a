"""Spelling forms against plain Python."""

import random
import re
import zlib
from collections import Counter

from tidewire.llm import queries, spelling


def words_of(rows, divisor=199):
    counts = Counter()
    for k, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, divisor=199, least=6, count=5, ratio=5):
    n = {w: c for w, c in words_of(rows, divisor).items() if len(w) >= least and c >= count}
    out, forms = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(close)
    root = lambda w: w if forms[w] is None else root(forms[w])
    return {w: (forms[w], root(w), n[w], out[w], n.get(forms[w])) for w in n}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed, letters="abé", length=(4, 9), many=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(*length))) for _ in range(120)]
    rows = []
    for k in range(many):
        words = [rng.choice(pool[: rng.choice((2, 10, 120))]) for _ in range(rng.randrange(0, 25))]
        rows.append((k, " ".join(w.title() if rng.random() < 0.2 else w for w in words)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    odd = [(None, None), (1, ""), (None, "Straße straße STRASSE " * 5), (9, "Über-über×x " * 9), (9, "Über-über×x " * 9), (7, "a" * 3000 + " " + "a" * 2999)]
    rows = texts(1) + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS word", "text AS n")
    wanted = brute(rows, divisor=7, least=4, count=2)
    assert found(spelling.spelling_forms(docs, divisor=7, least_length=4, least_count=2)) == wanted
    assert any(v[0] and v[1] != v[0] for v in wanted.values()) and any(v[0] is None and v[3] for v in wanted.values())
    assert spelling.spelling_forms(docs.limit(0)).collect() == []


def test_many_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 8)
    monkeypatch.setattr(spelling, "BUCKET", 16)
    rows = texts(2, letters="etx", length=(5, 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_forms(docs)) == brute(rows)


def test_query_on_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op13_spelling"](spark, folder)) == brute(rows)
