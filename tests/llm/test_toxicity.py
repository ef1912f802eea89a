"""Toxicity: held-out accuracy, folding, exceptions, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np

from tidewire.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op1_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) > 0.97 * len(held)
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic)


def test_folding():
    assert toxicity.fold("You 1D10T, іdiоt! w0rthle$$ 1999 a1") == ["you", "idiot", "idiot", "worthless", "1999", "ai"]
    assert toxicity.fold(None) == []


def small(spark):
    rows = [(i, f"you are an idiot and {'so ' * (i % 7)} on", 1) for i in range(40)] + [(100 + i, f"a fine day {'of ' * (i % 5)} rest", 0) for i in range(120)]
    docs = spark.createDataFrame([(k, t, "s") for k, t, _ in rows], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")


def test_hits_and_exceptions(spark):
    docs, labels = small(spark)
    odd = spark.createDataFrame(
        [(900, "what an 1di0t", ""), (901, "a fine rest", ""), (902, None, None), (903, "", ""), (None, "idiot " * 50000, ""), (905, "idiot proof plan", "")], docs.schema
    )
    found = {r.row.doc_id: r.predicted for r in toxicity.score(docs.union(odd), labels, exceptions=("idiot proof",)).collect()}
    assert [found[k] for k in (900, 901, 902, 903, None, 905)] == [1, 0, 0, 0, 1, 0]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 120


def test_without_labels(spark):
    docs, labels = small(spark)
    assert {r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()} <= {0, 1}
    assert toxicity.score(docs, labels.where("toxic = 0")).where("predicted = 1").isEmpty()
    assert toxicity.score(docs.limit(0), labels).collect() == []
    assert toxicity.score(docs.limit(0), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")).collect() == []


def by_hand(docs, labels, exceptions):
    """{doc_id: score} with plain counts, scans and Newton steps."""
    texts = dict(docs)
    train = [(texts[k], y) for k, y in labels if k in texts and zlib.crc32(str(k).encode()) % 5]
    toxic, clean = sum(y for _, y in train), sum(1 - y for _, y in train)
    seen = Counter(), Counter()
    for text, y in train:
        seen[y].update(set(toxicity.fold(text)))
    counts = {}
    for w in seen[0].keys() | seen[1].keys():
        for entry in [f" {w} ", *(f" {w[:n]}" for n in toxicity.STEMS if n < len(w))]:
            t, c = counts.get(entry, (0, 0))
            counts[entry] = (t + seen[1][w], c + seen[0][w])
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    lexicon = {e: odds(t, c) for e, (t, c) in counts.items() if t >= toxicity.LEAST_SEEN and odds(t, c) >= toxicity.LEAST_WEIGHT}
    line = lambda words: f" {' '.join(words)} "
    hit = lambda word: any(line([word]).startswith(e) for e in lexicon)
    pairs = Counter(), Counter()
    for text, y in train:
        words = toxicity.fold(text)
        pairs[y].update({f"{a} {b}" for a, b in zip(words, words[1:]) if hit(a) or hit(b)})
    excused = [*exceptions, *(p for p in pairs[0] if pairs[0][p] >= toxicity.LEAST_SEEN and odds(pairs[1][p], pairs[0][p]) < 0)]

    def row(text):
        words = toxicity.fold(text)
        free = set()
        for phrase in excused:
            n = len(phrase.split())
            free |= {i + j for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split() for j in range(n)}
        weight = sum(max((v for e, v in lexicon.items() if line([w]).startswith(e)), default=0) for i, w in enumerate(words) if i not in free)
        return [1.0, math.log1p(weight), math.log1p(1000 * weight / (len(words) + 20))]

    x, y, beta = np.array([row(t) for t, _ in train]), np.array([y for _, y in train]), np.zeros(3)
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return {k: 1 / (1 + math.exp(-np.dot(row(t), beta))) for k, t in docs}


def test_whole_result_by_hand(spark):
    docs, labels = small(spark)
    more = [(300 + i, f"an idiot light shines {i} and a {'w0rthless' if i % 3 else 'fine'} idiot light", 0) for i in range(8)]
    rows = [tuple(r)[:2] for r in docs.collect()] + [r[:2] for r in more] + [(900, "idiot"), (901, ""), (902, "idiot light")]
    marks = [tuple(r) for r in labels.collect()] + [(k, y) for k, _, y in more]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(wide, spark.createDataFrame(marks, "doc_id long, toxic int"), exceptions=("so so",)).collect()}
    wanted = by_hand(rows, marks, ("so so",))
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-6 for k in got)
    assert got[900] > got[902]  # the learnt phrase is excused


def test_many_exceptions_take_linear_time():
    automaton = toxicity._automaton({" trash ": 3.0, " idiot ": 4.0}, [" trash can "])
    words = ["trash", "can", "idiot"] * 100_000
    assert toxicity._weigh(automaton, words, {" trash can "}) == (400_000.0, 300_000)
