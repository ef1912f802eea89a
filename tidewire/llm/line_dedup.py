"""Repeated runs of lines, found by distributed prefix doubling over line ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.text import word_count
from tidewire.operators.index import heavy_join, row_index
from tidewire.session import settle

MIN_WORDS = 10  # a repeated stretch with fewer words stays
DOC = ["id", "hash"]
NO_ID = -(2**63)  # stands for a null doc_id
RUNS = "array<struct<start: int, length: int, original_id: long, original_place: int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """All rows with the key of their document: rows that repeat doc_id and text are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("body")
    )


def line_sequences(keyed: DataFrame) -> DataFrame:
    """Lines that occur at least twice: id, hash, place, number, rank, words. Equal lines share a rank; ranks are dense.

    ``place`` counts all lines of a document, ``number`` only those that are not empty.
    """
    placed = F.transform(F.split("body", "\n"), lambda line, place: F.struct(place.alias("place"), line.alias("line")))
    filled = F.filter(placed, lambda spot: spot["line"] != "")
    lines = keyed.select(*DOC, F.posexplode(filled).alias("number", "spot")).select(*DOC, "number", "spot.place", "spot.line")
    # 128 bits tell lines apart; the copies of a repeated document count once.
    coded = settle(
        lines.select(
            *DOC, "place", "number", F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two"), word_count(F.col("line")).alias("words")
        ).distinct()
    )
    often = coded.groupBy("one", "two").agg(F.count("*").alias("_n")).where("_n > 1")
    ranks = settle(row_index(often, ["one", "two"], name="rank"))
    ranked = heavy_join(coded, ranks.drop("_n"), ["one", "two"], spread=[*DOC, "place"], counts=ranks)
    return settle(ranked.select(*DOC, "place", "number", "rank", "words"))


def later_windows(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of each place the longest run of 2^j lines from there that stands earlier as well, and the places' ranks of every round.

    The windows are (id, hash, place, length, first), ``first`` the earliest place that it stands at. Round j knows the suffixes'
    order by their first 2^j lines as a dense rank, so equal ranks are the interval of suffixes with a common prefix of that length.
    A pair (rank, rank 2^j further) orders them by twice as many lines; its intervals of one suffix cannot repeat any longer and
    are dropped, so the rounds shrink and end at the longest repeated run. The first suffix of an interval, by (id, hash, place), is
    the original; the others are later copies. Only distinct pairs are sorted, and the rows of a frequent rank are dealt
    (``heavy_join``), so a frequent line is no heavy key.
    """
    found, rounds, length = [], [], 1
    suffixes = lines.select(*DOC, "place", "rank")
    while True:
        rounds.append(suffixes)
        first = settle(suffixes.groupBy("rank").agg(F.min(F.struct(*DOC, "place")).alias("first"), F.count("*").alias("_n")))
        joined = heavy_join(suffixes, first.drop("_n"), ["rank"], spread=[*DOC, "place"], counts=first)
        later = joined.where(F.struct(*DOC, "place") != F.col("first")).select(*DOC, "place", F.lit(length).alias("length"), "first")
        found.append(settle(later))
        ahead = Window.partitionBy(*DOC).orderBy("place").rangeBetween(length, length)
        pairs = settle(suffixes.withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL"))
        often = pairs.groupBy("rank", "next").agg(F.count("*").alias("_n")).where("_n > 1")
        ranked = settle(row_index(often, ["rank", "next"], name="doubled"))
        joined = heavy_join(pairs, ranked.drop("_n"), ["rank", "next"], spread=[*DOC, "place"], counts=ranked)
        suffixes = settle(joined.select(*DOC, "place", F.col("doubled").alias("rank")))
        length *= 2
        if suffixes.isEmpty():
            break
    windows = reduce(DataFrame.unionByName, found).groupBy(*DOC, "place").agg(F.max(F.struct("length", "first")).alias("w"))
    return settle(windows.select(*DOC, "place", "w.length", "w.first")), rounds


def _agreement(runs: DataFrame, ranks: DataFrame, step: int, key: list[str]) -> DataFrame:
    """Runs (by ``key``) whose ``step`` lines before (``ahead`` = step) or after (``behind`` = step) are those of the original."""
    own, other = F.struct(*DOC), F.struct(F.col("o_id").alias("id"), F.col("o_hash").alias("hash"))
    asked = F.array(
        *[
            F.struct(F.lit(side).alias("side"), doc.alias("doc"), (at - back).cast("int").alias("place"))
            for side, at in ((0, F.col("start") - step), (1, F.col("end")))
            for doc, back in ((own, F.lit(0)), (other, F.col("gap")))
        ]
    )
    spots = runs.select(*key, F.explode(asked).alias("a")).select(*key, "a.side", F.col("a.doc.id").alias("id_"), F.col("a.doc.hash").alias("hash_"), "a.place")
    placed = ranks.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), "place", "rank")
    met = spots.join(placed, ["id_", "hash_", "place"]).groupBy(*key, "side").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("*").alias("n"))
    sides = [F.max(F.when(F.col("side") == i, step)).alias(name) for i, name in ((0, "ahead"), (1, "behind"))]
    return met.where("n = 2 AND low = high").groupBy(*key).agg(*sides)


def maximal_runs(windows: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Maximal repeated runs per document: id, hash, runs (array of start, length, original_id, original_place, by start).

    Windows that lie on one diagonal (same document, same original document, same distance of the places) and touch make a run.
    It is then extended both ways along its diagonal, by 2^j lines where the ranks of round j agree, from the longest window down
    to one line: so both ends are where the lines differ or the text ends. Runs inside a longer run of the document are left
    out (of equal ones the earliest original stays).
    """
    line = [*DOC, "o_id", "o_hash", "gap"]
    placed = windows.select(
        *DOC, F.col("first.id").alias("o_id"), F.col("first.hash").alias("o_hash"), (F.col("place") - F.col("first.place")).alias("gap"), "place",
        (F.col("place") + F.col("length")).alias("end"),
    )
    along = Window.partitionBy(*line).orderBy("place")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = placed.withColumn("begins", F.when(before >= F.col("place"), 0).otherwise(1))
    runs = begins.withColumn("island", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*line, "island").agg(F.min("place").alias("start"), F.max("end").alias("end")).drop("island")
    runs = settle(runs.withColumn("run", F.xxhash64(*line, "start")))
    # Hardly any run goes on beyond its windows: only those that agree in one line more are looked at further.
    key = ["run", *line, "start"]
    open_ = settle(runs.join(_agreement(runs, rounds[0], 1, key).select(*key), key, "left_semi"))
    runs = runs.join(open_.select(*key), key, "left_anti")
    if not open_.isEmpty():
        for j in range(len(rounds) - 1, -1, -1):
            grown = open_.join(_agreement(open_, rounds[j], 1 << j, key), key, "left")
            open_ = settle(
                grown.select("run", *line, (F.col("start") - F.coalesce("ahead", F.lit(0))).alias("start"), (F.col("end") + F.coalesce("behind", F.lit(0))).alias("end"))
            )
        runs = runs.unionByName(open_)
    in_order = Window.partitionBy(*DOC).orderBy("start", F.desc("end"), "o_id", "o_hash", "gap").rowsBetween(Window.unboundedPreceding, -1)
    outer = runs.withColumn("reach", F.max("end").over(in_order)).where("reach IS NULL OR reach < end")
    shown = F.struct(
        "start", (F.col("end") - F.col("start")).alias("length"), F.when(F.col("o_id") != NO_ID, F.col("o_id")).alias("original_id"), (F.col("start") - F.col("gap")).alias("original_place")
    )
    return outer.groupBy(*DOC).agg(F.sort_array(F.collect_list(shown)).alias("runs"))


def repeated_lines(keyed: DataFrame, min_words: int = MIN_WORDS, joined: bool = False, runs: bool = True) -> DataFrame:
    """What to delete per document: id, hash, gone (array of places), with ``runs`` also runs (``maximal_runs``).

    Windows of later copies that overlap make up the maximal repeated runs: a run of m lines is covered by the
    windows of its largest power of two, each a line further. A stretch of overlapping runs goes if it has at least
    ``min_words`` words; ``joined`` makes one stretch of runs that only touch or have empty lines between them.
    """
    lines = line_sequences(keyed)
    windows, rounds = later_windows(lines)
    along = Window.partitionBy(*DOC).orderBy("place")
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("place") + F.coalesce("length", F.lit(0))
    marked = (
        lines.join(windows.drop("first"), [*DOC, "place"], "left")
        .withColumn("end", F.max(reach).over(upto))
        .withColumn("held", F.coalesce(F.max(reach).over(before), F.lit(0)))
        .withColumn("stretch", F.sum(F.when(F.col("held") <= F.col("place"), 1).otherwise(0)).over(upto))
        .where("end > place")
    )
    if joined:
        marked = marked.withColumn("stretch", F.col("number") - F.row_number().over(along))
    long = marked.groupBy(*DOC, "stretch").agg(F.sum("words").alias("words"), F.collect_list("place").alias("places")).where(F.col("words") >= min_words)
    gone = long.groupBy(*DOC).agg(F.flatten(F.collect_list("places")).alias("gone"))
    return gone.join(maximal_runs(windows, rounds), DOC, "full") if runs else gone


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, joined: bool = False, runs: bool = True) -> DataFrame:
    """All rows as ``row`` with n_lines, n_deleted, the text that is left, n_runs, longest_run and runs.

    ``runs`` are the maximal repeated runs (``maximal_runs``): start and length in lines, and doc_id and place of the earlier copy;
    the last three columns are left out without ``runs``.

    Lines end at line feeds and are compared as they are. Later copies (by doc_id, then by place) of runs of
    lines are deleted, inside a document and across documents; null doc_ids come first. Every row stays, even with
    nothing left (''); null and empty texts stay as they are and have no lines. Empty lines are never part of a run and
    always stay. Stretches of fewer than ``min_words`` words stay; 0 deletes every later copy. ``joined`` judges runs that
    touch, or have only empty lines between them, as one stretch. Rows that repeat doc_id and text are one document and share its result. An empty table gives an empty
    result. Input columns stay inside ``row`` and cannot clash.
    """
    keyed = _keyed(docs)
    gone = repeated_lines(keyed, min_words, joined, runs)
    lines = F.split("body", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    shown = [
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
    ]
    return keyed.join(gone, DOC, "left").select(
        "row",
        F.when(F.col("body") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        *(shown if runs else []),
    )


def cleaned(docs: DataFrame, *, min_words: int = MIN_WORDS, joined: bool = False) -> DataFrame:
    """The documents with their columns, the text without repeated lines."""
    held = without_repeats(docs, min_words=min_words, joined=joined, runs=False)
    return held.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
