"""Line runs against plain Python."""

import random

from tests.llm.brute import WORD
from tidewire.llm import line_dedup, queries


def brute(rows, min_words):
    """{doc_id: (lines, deleted, text)} from the definition: all earlier common runs, longest first."""
    order = sorted(rows)
    lines = {k: (t or "").split("\n") for k, t in order}
    seen = [(k, i) for k, _ in order for i in range(len(lines[k]))]
    place = {p: n for n, p in enumerate(seen)}
    holders = {}
    for k, i in seen:
        if lines[k][i]:
            holders.setdefault(lines[k][i], []).append((k, i))
    out = {}
    for k, text in order:
        own, runs = lines[k], []
        for i, line in enumerate(own):
            best = 0
            for j, at in holders.get(line, []):
                if place[j, at] >= place[k, i]:
                    continue
                m = 0
                while i + m < len(own) and at + m < len(lines[j]) and own[i + m] and own[i + m] == lines[j][at + m]:
                    m += 1
                best = max(best, m)
            if best:
                runs.append((i, i + best))
        stretches = []
        for a, b in runs:
            if stretches and a < stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        gone = {i for a, b in stretches for i in range(a, b) if sum(len(WORD.findall(x)) for x in own[a:b]) >= min_words}
        left = text if not gone else "\n".join(x for i, x in enumerate(own) if i not in gone)
        out[k] = (len(own) if text else 0, len(gone), left)
    return out


def brute_runs(rows):
    """{doc_id: runs} from the definition: windows of powers of two, their earliest copy, diagonals, extension, the outer ones."""
    order = sorted(rows, key=lambda r: r[0])
    lines = {k: (t or "").split("\n") if t else [] for k, t in order}
    at = lambda k, i: lines[k][i] if 0 <= i < len(lines[k]) and lines[k][i] else None
    holders = {}
    for k in lines:
        for i in range(len(lines[k])):
            n = 1
            while all(at(k, i + m) for m in range(n)):
                holders.setdefault(tuple(lines[k][i : i + n]), []).append((k, i))
                n *= 2
    out = {}
    for k in lines:
        runs = set()
        for i in range(len(lines[k])):
            n, best = 1, None
            while all(at(k, i + m) for m in range(n)) and (first := min(holders[tuple(lines[k][i : i + n])])) < (k, i):
                best = (first, n)
                n *= 2
            if best is None:
                continue
            (o, p), n = best
            start, end, gap = i, i + n, i - p
            while at(k, start - 1) and at(k, start - 1) == at(o, start - 1 - gap):
                start -= 1
            while at(k, end) and at(k, end) == at(o, end - gap):
                end += 1
            runs.add((start, -end, o, gap))
        shown, reach = [], -1
        for start, end, o, gap in sorted(runs):
            if -end > reach:
                shown.append((start, -end - start, o, start - gap))
                reach = -end
        out[k] = shown
    return out


def runs_of(rows):
    return {r.row.doc_id: [tuple(x) for x in r.runs] for r in rows}


def found(docs, min_words):
    return {r.row.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_dedup.without_repeats(docs, min_words=min_words).collect()}


def test_random_lines(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = [rng.choice(["a b", "c", "d e f", "", "g h i j"]) if rng.random() < 0.6 else f"line {k} {i}" for i in range(rng.randrange(0, 14))]
        if rows and rng.random() < 0.3:
            other = rng.choice(rows)[1].split("\n")
            text[rng.randrange(len(text) + 1) : 0] = other[rng.randrange(len(other)) :]
        rows.append((k, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 5):
        assert found(docs, least) == brute(rows, least)
    got = line_dedup.without_repeats(docs, min_words=0).collect()
    wanted = brute_runs(rows)
    assert runs_of(got) == wanted
    assert {(r.n_runs, r.longest_run) for r in got} == {(len(v), max((x[1] for x in v), default=0)) for v in wanted.values()}
    assert max(r.longest_run for r in got) > 3


def test_edges(spark):
    long = "\n".join(f"line number {i} of the text" for i in range(300))
    rows = [(1, long, "a"), (2, "own\n" + long, "b"), (3, None, "c"), (4, "", None), (5, "\n\n", "d"), (6, "x\n" * 70, "e"), (None, "only here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = found(docs, 10)
    assert got[1] == (300, 0, long) and got[2] == (301, 300, "own")
    assert got[3] == (0, 0, None) and got[4] == (0, 0, "") and got[5] == (3, 0, "\n\n")
    assert got[6] == (71, 69, "x\n") and got[None] == (1, 0, "only here")
    runs = runs_of(line_dedup.without_repeats(docs).collect())
    assert runs[2] == [(1, 300, 1, 0)] and runs[6] == [(1, 69, 6, 0)] and runs[1] == [] == runs[3]
    twice = docs.unionByName(docs.where("doc_id = 1"))
    same = line_dedup.cleaned(twice)
    assert same.columns == docs.columns and sorted(r.text for r in same.where("doc_id = 1").collect()) == [long, long]
    assert line_dedup.cleaned(docs.limit(0)).collect() == []


def test_joined_stretches(spark):
    one, two, three = "one a b c d", "two a b c d", "three a b c d"
    rows = [(1, one), (2, two), (3, three), (4, f"{one}\n{two}\nown line"), (5, f"{two}\n\n\n{three}"), (6, f"{one}\nother line\n{two}"), (7, f"  \n{one}"), (8, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(v[1] == 0 for v in found(docs, 10).values())
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, joined=True).collect()}
    assert got == dict(rows) | {4: "own line", 5: "\n"}


def test_query_keeps_no_later_copy(spark, tmp_path):
    rows = [(1, "short line\nx\n\nlast"), (2, "short line"), (3, "x\nnew\n\nx"), (4, " "), (5, " \nshort line"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, rows[0][1]), 2: (1, 1, ""), 3: (4, 2, "new\n"), 4: (1, 0, " "), 5: (2, 2, ""), 6: (0, 0, None)}
    assert got == brute(rows, 0)
