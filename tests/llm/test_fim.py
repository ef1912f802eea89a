"""Fill-in-middle cuts against slicing, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np

from tidewire.llm import fim

TEXTS = [None, "", "a", "ß", "日本語テキスト" * 700, "plain words here " * 400, "has <P> inside", "x<S>", "<", "<<P", "á\r\n" * 900, "🤷🏽‍♀️", "\n", "z" * 5000]


def by_slices(doc_id, text, pattern=r"[\s\S]"):
    text = text or ""
    starts = [m.start() for m in re.finditer(pattern, text)]
    n = len(starts)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    cut = lambda k: 0 if k == 0 else len(text) if k == n else starts[k]
    a, b = cut(a), cut(b)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_against_slices(spark):
    rows = [(i * 100 + j, t, "row", i) for j in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (7, "two", "x", 2), (7, "two", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n long")
    for unit, pattern in ((None, r"[\s\S]"), (r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+")):
        made = fim.fill_in_middle(docs, unit=unit)
        got = made.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(made.output, made.form).alias("back")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_slices(r.doc_id, r.text, pattern), (r.doc_id, unit)
            assert r.back == (r.text or "")
        assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_cuts_of_all_blocks():
    rng = random.Random(5)
    for size in (1, 7, 8, 9, 64, 200):
        text = "".join(rng.choice("ab é日🤷") for _ in range(size))
        data = text.encode()
        words = np.array([len(text[: m.start()].encode()) for m in re.finditer(r"\S+", text)], dtype=np.int64)
        every, some = fim.TextBlocks(data, block=8), fim.TextBlocks(data, words, block=8)
        assert [every.cut(k) for k in range(size + 1)] == [(len(text[:k].encode()), k) for k in range(size + 1)]
        wanted = [(0, 0), *((int(w), len(data[:w].decode())) for w in words[1:]), (len(data), size)] if len(words) else [(0, 0)]
        assert [some.cut(k) for k in range(len(words) + 1)] == wanted
