"""Document fingerprints after SpotSigs: chains of content words that follow common words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.index import row_index
from tidewire.session import settle

# Common words of four languages, the anchors.
ANCHORS = (
    "the of and to in is that for it with as was on are by be at or an this from have not he his "
    "der die und das den von zu mit ist des auf für ein eine im dem nicht sich als auch "
    "de la le et les du un une est que en pour dans qui sur par au pas ce avec "
    "el los las y del se por con su para lo como más al"
).split()
CHAIN = 2  # content words of a signature


def _choice(words: list[str]) -> str:
    """An alternation grouped by first letter, so that most words fail on one comparison."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by_first.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(sorted(rest, reverse=True))})" for first, rest in by_first.items()) + ")"


ANCHOR = _choice(ANCHORS)
# Every anchor gives way to a mark, and marks in a row to one ahead of the next content word, so that no search walks over them again.
# (A pattern for a whole run of anchors would take a stack frame for each.)
ONE_ANCHOR = rf"(?<= ){ANCHOR} "
MARK = "|"
# The CHAIN content words behind a mark, with the marks between them.
SPOT = r"\|(?=([^ |]+ " + r"\|?[^ |]+ " * (CHAIN - 1) + "))"
# A stretch without anchors, in blocks of words counted from its start.
BLOCK = r"(?<=[ |])(?:[^ |]+ ){4}"


def with_marks(df: DataFrame, text: str, name: str = "marks") -> DataFrame:
    """Add the sorted distinct signatures of a text column (not null) as 32-bit checksums; only an empty text has none.

    Every anchor gives the chain of the next CHAIN content words. Stretches without anchors (lists, tables, other
    languages) give their blocks of four words, so they count too. A text without either gives its words, one without
    words itself as a whole. The generators keep the optimizer from repeating a search for each use.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    spread = df.select("*", F.inline(F.array(F.struct(plain.alias("_plain"), F.regexp_replace(F.regexp_replace(plain, ONE_ANCHOR, MARK), r"\|\|+", MARK).alias("_marked")))))
    found = F.struct(F.regexp_extract_all("_marked", F.lit(SPOT), F.lit(1)).alias("_spots"), F.regexp_extract_all("_marked", F.lit(BLOCK), F.lit(0)).alias("_blocks"))
    spread = spread.select("*", F.inline(F.array(found)))
    chains = F.transform("_spots", lambda spot: F.replace(spot, F.lit(MARK), F.lit("")))
    words = F.transform(F.filter(F.split(F.trim("_plain"), " "), lambda w: w != ""), lambda w: F.concat(w, F.lit(" ")))
    whole = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    marks = F.when(F.size("_spots") + F.size("_blocks") > 0, F.concat(chains, "_blocks")).when(F.col("_plain") != "  ", words).otherwise(whole)
    # 32 bits each; sorted as unsigned numbers.
    checks = F.sort_array(F.array_distinct(F.transform(marks, lambda s: F.crc32(s.cast("binary")))))
    return spread.select(*df.columns, checks.alias(name))


def fingerprint(marks: Column) -> Column:
    """The signatures as one string, eight hexadecimal digits each."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.hex(m), 8, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 if both are empty."""
    both = F.size(F.array_intersect(one, two))
    return F.when((F.size(one) == 0) & (F.size(two) == 0), 1.0).otherwise(both / (F.size(one) + F.size(two) - both))


def similar_pairs(marked: DataFrame, similarity: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints that are at least ``similarity`` alike.

    ``marked`` has key and marks. Equal sets are one: their smallest key stands for them. Sets are partitioned by length so that
    partners lie in the same or the next partition; a set meets the others on its rarest marks, just as many as a
    partner must share one of; then the sets are compared. Sets without marks have no partner.
    """
    sets = settle(marked.where(F.size("marks") > 0).groupBy("marks").agg(F.min("key").alias("key")).select("key", "marks", F.size("marks").alias("n")))
    often = sets.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("often"))
    placed = (
        sets.select("key", "n", F.explode("marks").alias("mark"))
        .join(often, "mark")
        .groupBy("key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "mark"))).alias("rare"))
    )
    first = F.expr(f"n - CAST(ceil({similarity} * n - 1e-9) AS INT) + 1")
    part = F.floor(F.log("n") / math.log(1 / similarity) + 1e-9)
    keyed = settle(placed.select("key", part.alias("part"), F.explode(F.transform(F.slice("rare", F.lit(1), first), lambda r: r["mark"])).alias("mark")))
    one = keyed.select(F.col("key").alias("a"), "mark", "part")
    two = keyed.select(F.col("key").alias("b"), "mark", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    met = one.join(two, ["mark", "part"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("key").alias(c), F.col("marks").alias(f"m{c}")) for c in "ab")
    return met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("ma"), F.col("mb")).alias("likeness")).where(F.col("likeness") >= similarity)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of edited texts, and their likeness: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The last third of a text's code points (rounded down) is replaced by the first as many of the next document's, or by
    all of it; next is by descending doc_id, null last, and after the last comes the first. Rows that share a
    doc_id follow by the digest of their text; rows that repeat both are one document and are listed as often. Null
    texts count as empty; an empty table gives an empty result; other columns are not read.
    """
    lowest = F.lit(-(2**63))  # stands for null
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("id", F.xxhash64("text").alias("hash"), "text")
    chain = row_index(
        keyed.select("id", "hash", F.length("text").alias("n")).distinct().withColumn("down", -F.col("id").cast("decimal(20,0)")), ["down", "hash"], name="place"
    )
    count = chain.agg(F.count("*")).first()[0]
    chain = settle(chain.select("id", "hash", "n", "place"))
    # The document before a document: it is the one that takes this one's first characters.
    before = chain.select(F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), (F.col("n") / 3).cast("int").alias("take"), F.pmod(F.col("place") + 1, F.lit(max(count, 1))).alias("place"))
    giver = chain.join(before, "place").select("id", "hash", "to_id", "to_hash", "take")
    # Both uses below read all four columns, so they share one exchange and the signatures are made once.
    spotted = with_marks(keyed, "text")
    heads = (
        spotted.join(giver, ["id", "hash"])
        .select("to_id", "to_hash", F.col("text").substr(F.lit(1), F.col("take")).alias("head"), F.col("marks").alias("next_marks"))
        .groupBy(F.col("to_id").alias("id"), F.col("to_hash").alias("hash"))
        .agg(F.first("head").alias("head"), F.first("next_marks").alias("next_marks"))
    )
    size = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), size - (size / 3).cast("int")), F.col("head"))
    marked = spotted.join(heads, ["id", "hash"]).select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"), size.cast("long").alias("n_chars"), edited.alias("edited"), "marks", "next_marks"
    )
    return with_marks(marked, "edited", "edited_marks").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
