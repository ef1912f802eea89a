"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.text import batches_of
from tidewire.session import settle

TRAIN_ROWS = 20_000  # at most so many labelled documents teach the lexicon
LEXICON = 5_000  # entries of the lexicon at most, the most telling ones
STEMS = range(4, 11)  # lengths of word beginnings that may become entries
LEAST_SEEN = 4  # toxic documents that hold an entry
LEAST_WEIGHT = 2.5  # log odds of an entry
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "stupid simple")  # beside those that are learnt
LEARNT = 1_000  # learnt exception phrases at most

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
              "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {i: chr(i - 0xFEE0) for i in range(0xFF41, 0xFF5B)}
_FOLD |= {ord(c): " " for c in "\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\t\n\r\x0b\x0c«»“”„’‘–—…¿¡"}
_FOLD |= {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None}
_DIGITS = {ord(k): v for k, v in DIGITS.items()}


def fold(text: str | None) -> list[str]:
    """The words of a text, lower-cased, with look-alikes as Latin letters and digits inside words as letters."""
    words = (text or "").lower().translate(_FOLD).split()
    return [w if w.isalpha() else _spelled(w) for w in words]


def _spelled(word: str) -> str:
    """Digits and signs stand for letters only next to letters; a final exclamation mark is one."""
    word = word.rstrip("!")
    return word.translate(_DIGITS) if any(map(str.isalpha, word)) else word


COUNTED = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(set(fold(text)))
        yield from batches_of(((w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()), COUNTED)


def held_out(doc_id: Column) -> Column:
    """Rows that must not teach: the id's CRC is divisible by five; so are rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that are not held out, in a seeded order."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IN (0, 1)")
        .where(~held_out(F.col("_id")))
        .distinct()
    )
    # Bounded by ``rows``, so it may be broadcast.
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return settle(texts.join(F.broadcast(sample), "_id").select("text", "toxic"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words (' word ') and word beginnings (' begin') with their log odds of toxic against clean documents.

    Counts are of the sample's distinct words per document; beginnings sum over their words. A beginning is kept
    only if it tells more than its words could by chance: it must itself be seen and weigh enough.
    """
    total = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = total["t"] or 0, total["c"] or 0
    counted = sample.mapInArrow(_count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    stems = F.transform(
        F.filter(F.array(*[F.lit(n) for n in STEMS]), lambda n: n < F.length("word")), lambda n: F.concat(F.lit(" "), F.substr(F.col("word"), F.lit(1), n))
    )
    entries = (
        counted.select(F.explode(F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), stems)).alias("entry"), "t", "c")
        .groupBy("entry")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= LEAST_SEEN)
        .withColumn("weight", F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0)))
        .where(F.col("weight") >= LEAST_WEIGHT)
    )
    best = entries.orderBy(F.desc(F.col("weight") * F.log1p("t")), "entry").limit(LEXICON)
    return {r["entry"]: r["weight"] for r in best.collect()}  # at most LEXICON rows


def _automaton(entries: dict[str, float], excused: Sequence[str] = ()):
    automaton = ahocorasick.Automaton()
    for entry, weight in entries.items():
        automaton.add_word(entry, (len(entry), weight))
    for phrase in excused:
        automaton.add_word(phrase, (len(phrase), entries.get(phrase)))
    automaton.make_automaton()
    return automaton


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], most: int = LEARNT) -> list[str]:
    """Phrases of two words, one of them a hit, that clean documents hold rather than toxic ones, whatever the language.

    Counted once per document of the sample; a phrase must stand in LEAST_SEEN clean ones and be less likely in a toxic
    document than in a clean one. The most frequent ``most`` are kept.
    """
    if not lexicon:
        return []
    total = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = total["t"] or 0, total["c"] or 0

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon)
        for batch in batches:
            seen = Counter(), Counter()
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text)
                starts = np.cumsum([0, *(len(w) + 1 for w in words)])
                at = {int(np.searchsorted(starts, end - length + 1)) for end, (length, _) in automaton.iter(f" {' '.join(words)} ")}
                pairs = {i for k in at for i in (k - 1, k) if 0 <= i < len(words) - 1}
                seen[kind].update({f"{words[i]} {words[i + 1]}" for i in pairs})
            yield from batches_of(((w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()), COUNTED)

    counted = sample.mapInArrow(phrases, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    best = counted.where((F.col("c") >= LEAST_SEEN) & (odds < 0)).orderBy(F.desc("c"), "word").limit(most)
    return [r["word"] for r in best.collect()]  # at most ``most`` rows


def hits(lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS):
    """A column function from text to (weight of all hits, number of words)."""
    excused = [f" {e} " for e in exceptions]

    @F.pandas_udf("weight double, words long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(lexicon, excused)
        free = set(excused)
        for texts in batches:
            rows = [_weigh(automaton, fold(text), free) for text in texts]
            yield pd.DataFrame({"weight": [r[0] for r in rows], "words": [r[1] for r in rows]})

    return run


def _weigh(automaton, words: list[str], excused: set[str] = frozenset()) -> tuple[float, int]:
    """Each word counts with its heaviest entry; words inside an exception phrase do not count.

    Hits come by their end; the excused stretches are joined in order of their start, so a look-up is a binary search.
    """
    line = f" {' '.join(words)} "
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(line):
        at = end - length + 1
        if weight is not None and weight > best.get(at, 0.0):
            best[at] = weight
        if length > 1 and line[at : end + 1] in excused:
            free.append((at, end))
    if not free:
        return sum(best.values()), len(words)
    starts, ends = [], []
    for low, high in sorted(free):
        if ends and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        else:
            starts.append(low), ends.append(high)
    inside = lambda at: (i := bisect_right(starts, at)) and at < ends[i - 1]
    return sum(w for at, w in best.items() if not inside(at)), len(words)


def features(weight: Column, words: Column) -> list[Column]:
    """Total weight and weight per thousand words, both damped."""
    return [F.lit(1.0), F.log1p(weight), F.log1p(1000 * weight / (words + 20))]


def fit(table: DataFrame, rounds: int = 12, ridge: float = 1e-2) -> list[float]:
    """Logistic coefficients by Newton steps; the driver sees nine sums per step."""
    names = ["x0", "x1", "x2"]
    beta = np.zeros(3)
    for _ in range(rounds):
        z = sum((F.col(n) * float(b) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        rows = table.select(*names, p.alias("p"), "toxic").agg(
            *[F.sum(F.col(n) * (F.col("toxic") - F.col("p"))).alias(f"g{i}") for i, n in enumerate(names)],
            *[F.sum(F.col(a) * F.col(b) * F.col("p") * (1 - F.col("p"))).alias(f"h{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names)],
        ).first()
        gradient = np.array([rows[f"g{i}"] or 0.0 for i in range(3)]) - ridge * beta
        curve = np.array([[rows[f"h{i}{j}"] or 0.0 for j in range(3)] for i in range(3)]) + ridge * np.eye(3)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return [float(b) for b in beta]


def score(docs: DataFrame, labels: DataFrame, *, exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """All rows as ``row`` with held_out, score (0 to 1) and predicted (score of at least 0.5).

    The lexicon's entries and weights and the calibration come from labelled documents that are not held
    out, at most TRAIN_ROWS of them, and so do exception phrases beside the given ones. The score is a logistic function of the weight of the hits, in total
    and by length. Null and empty texts have no hits and get the base score; without any labels of
    one class the lexicon is empty and all rows share a score. Rows with null or other labels do not teach;
    repeated rows are scored alike; an empty table gives an empty result. Input columns stay inside ``row``.
    """
    sample = training(docs, labels)
    lexicon = learn_lexicon(sample)
    weigh = hits(lexicon, [*exceptions, *learn_exceptions(sample, lexicon)])
    seen = sample.select(weigh("text").alias("hit"), "toxic")
    table = settle(seen.select(*[f.alias(f"x{i}") for i, f in enumerate(features(F.col("hit.weight"), F.col("hit.words")))], "toxic"))
    beta = fit(table)
    rows = docs.select(F.struct("*").alias("row"), weigh(F.col("text").cast("string")).alias("hit"))
    z = sum((x * b for x, b in zip(features(F.col("hit.weight"), F.col("hit.words")), beta, strict=True)), F.lit(0.0))
    scored = rows.select("row", held_out(F.col("row.doc_id")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    return score(docs, labels).where("predicted = 0").select("row.*")
