"""Spelling variants: words one edit apart, found by Gram matrices of letter counts."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.text import batches_of
from tidewire.session import settle

RUN = r"[A-Za-zÀ-ÿ]+"
DIVISOR = 199  # of the checksum: such runs lose a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
HELD = 400_000  # distinct words a task holds before it passes their counts on
# Letters in the order of their frequency in English, dealt in turn to the parts; other letters go by their code.
PARTS = 3
ORDER = "etaoinshrdlucmfwypvbgkjqxz"
TILE = 2048  # words of a tile; a product is at most TILE x TILE
BUCKET = 1024  # words that share a bucket of block keys, on average

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
FORM_ROWS = "word string, near string, near_n long"


def lowered(text: str) -> str:
    """Lower case for A to Z only; bytes of other letters lie above."""
    return text.encode().translate(_FOLD).decode()


def without_letter(word: str, number: int) -> str:
    at = number % len(word)
    return word[:at] + word[at + 1 :]


def _count(divisor: int, least: int):
    run = re.compile(RUN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                own: dict[str, int] = defaultdict(int)
                for word in run.findall(lowered(text)):
                    own[word] += 1
                start = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, n in own.items():
                    code = zlib.crc32(word.encode(), start)
                    if code % divisor == 0:
                        word = without_letter(word, code)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield from batches_of(iter(held.items()), COUNTS)
                    held.clear()
        yield from batches_of(iter(held.items()), COUNTS)

    return count


def word_counts(docs: DataFrame, *, divisor: int = DIVISOR, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words with their occurrences (word, n); counted inside the tasks before they are shuffled, so a frequent word is no heavy key."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.mapInArrow(_count(divisor, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def part_of(code: int) -> int:
    letter = chr(code)
    return (ORDER.index(letter) if letter in ORDER else code) % PARTS


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n -> the checksums of its letter counts inside every part of the alphabet."""
    part = np.array([part_of(c) for c in range(256)])
    rng = np.random.default_rng(13)  # one fixed factor per letter; sums of factors stand for counts
    factor = rng.integers(1, 1 << 62, 256, dtype=np.int64)
    weights = [np.where(part == p, factor, 0) for p in range(PARTS)]
    for batch in batches:
        words = batch.column(0)
        codes = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8)
        ends = np.cumsum(np.array([len(w) for w in words.to_pylist()], dtype=np.int64))
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
        sums = [pa.array(np.add.reduceat(w[codes], starts) if len(starts) else np.zeros(0, np.int64)) for w in weights]
        yield pa.RecordBatch.from_arrays([words, batch.column(1), *sums], names=["word", "n", *(f"k{p}" for p in range(PARTS))])


class Tile:
    """Words of one tile by length: letters as a matrix, letter counts, keys of the parts, occurrences."""

    def __init__(self, words: list[str], n: list[int], keys: list[list[int]]) -> None:
        lengths = np.array([len(w) for w in words])
        self.words, self.slices, order = np.array(words, dtype=object), {}, np.argsort(lengths, kind="stable")
        keys = np.array(keys, dtype=np.int64).reshape(len(words), PARTS)
        for length in np.unique(lengths):
            at = order[lengths[order] == length]
            letters = np.frombuffer("".join(self.words[at]).encode("latin-1"), dtype=np.uint8).reshape(len(at), length)
            # Sums of squares of longer words would leave the exact range of short floats.
            counts = np.zeros((len(at), 256), dtype=np.float32 if length < 2000 else np.float64)
            np.add.at(counts, (np.repeat(np.arange(len(at)), length), letters.ravel()), 1)
            self.slices[int(length)] = (at, letters, counts, keys[at])
        self.n = np.array(n, dtype=np.int64)


def _agree(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Rows (letters of two words each) whose words are one edit apart: common beginning and end leave one letter."""
    size = shorter.shape[1]
    ahead = np.cumprod(shorter == longer[:, :size], axis=1, dtype=np.uint8).sum(axis=1)
    behind = np.cumprod((shorter == longer[:, longer.shape[1] - size :])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
    return ahead + behind >= longer.shape[1] - 1


def near_in_tiles(one: Tile, two: Tile, part: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in one, in two) of near words that share the key of ``part`` and of no part before it; each pair once.

    The product of the letter counts of two blocks of words of adjacent length gives all squared distances: 2 for one letter
    replaced, 1 for one letter more. What is left is compared letter by letter.
    """
    for length in one.slices:
        for other in (length, length + 1) if same else (length - 1, length, length + 1):
            if other not in two.slices:
                continue
            at, letters, counts, keys = one.slices[length]
            at2, letters2, counts2, keys2 = two.slices[other]
            used = np.flatnonzero(counts.any(axis=0) | counts2.any(axis=0))
            a, b = counts[:, used], counts2[:, used]
            distance = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            i, j = np.nonzero(distance == (2 if other == length else 1))
            if same and other == length:
                i, j = i[i < j], j[i < j]
            fits = keys[i, part] == keys2[j, part]
            for p in range(part):
                fits &= keys[i, p] != keys2[j, p]
            i, j = i[fits], j[fits]
            left, right = letters[i], letters2[j]
            apart = _agree(left, right) if other >= length else _agree(right, left)
            yield at[i[apart]], at2[j[apart]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            same = row["i"] == row["j"]
            one = Tile(row["words"], row["n"], row["keys"])
            two = one if same else Tile(row["words2"], row["n2"], row["keys2"])
            for a, b in near_in_tiles(one, two, row["part"], same):
                for x, i, y, j in ((one, a, two, b), (two, b, one, a)):
                    yield pa.RecordBatch.from_arrays([pa.array(x.words[i], pa.string()), pa.array(y.words[j], pa.string()), pa.array(y.n[j])], schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """Near words of every word, both ways: word, near, near_n (occurrences of ``near``).

    One edit changes the letter counts in at most two of the three parts of the alphabet, so near words agree in all counts
    of a part. Blocks hold the words that share a part's counts (several small blocks share a bucket); a block of any size is
    dealt into tiles of about TILE words, and pairs of tiles are multiplied on their own. No pair is lost, and a pair
    that meets in several parts counts in the first.
    """
    keyed = settle(words.select("word", "n").mapInArrow(_keys, "word string, n long, " + ", ".join(f"k{p} long" for p in range(PARTS))))
    buckets = max(1, keyed.count() // BUCKET)
    spread = keyed.select("word", "n", F.array(*[f"k{p}" for p in range(PARTS)]).alias("keys")).select("*", F.posexplode("keys").alias("part", "key"))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("part", "key"), F.lit(buckets)))
    sizes = spread.groupBy("part", "bucket").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = spread.join(sizes, ["part", "bucket"]).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    packed = dealt.groupBy("part", "bucket", "tiles", "tile").agg(F.collect_list(F.struct("word", "n", "keys")).alias("w"))
    tiles = settle(packed.selectExpr("part", "bucket", "tiles", "tile", "w.word AS words", "w.n AS n", "w.keys AS keys"))
    left = tiles.select("part", "bucket", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    pairs = left.join(tiles.selectExpr("part", "bucket", "tile AS i", "words", "n", "keys"), ["part", "bucket", "i"])
    right = tiles.selectExpr("part", "bucket", "tile AS j", "words AS words2", "n AS n2", "keys AS keys2")
    meet = pairs.join(right, ["part", "bucket", "j"])
    # Pairs of tiles are dealt anew, since a hot block has many.
    dealt_anew = meet.repartition(F.xxhash64("part", "bucket", "i", "j"))
    return dealt_anew.select("part", "i", "j", "words", "n", "keys", "words2", "n2", "keys2").mapInArrow(_compare, FORM_ROWS)


def spelling_forms(docs: DataFrame, *, ratio: int = RATIO, **options) -> DataFrame:
    """Words with their near words and the form they are a variant of: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters (A-Z lowered); of a run whose crc32 with its doc_id (``doc_id:run``) is
    divisible by ``divisor`` the letter at that number modulo the length is deleted. Those of at least ``least_length`` letters and
    ``least_count`` occurrences in the whole table count. The form is the near word (one letter inserted, deleted or
    replaced) of most occurrences (ties: the smallest in code point order), if it has at least ``ratio`` times the word's
    own; else null. ``root`` follows forms to the last one. Null and empty texts have no words; a null doc_id is the
    empty string; repeated rows count as often as they stand there; other columns are not read; an
    empty table gives an empty result.
    """
    words = settle(word_counts(docs, **options))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= F.col("n") * ratio
    formed = settle(
        joined.select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """The last form of every word that has one. A step multiplies the occurrences, so paths are short; each round doubles the steps."""
    ahead = settle(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ahead.join(further, "root", "left_semi").isEmpty():
            return ahead
        ahead = settle(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
