"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.chunks import CODE_ROW, Codes, encode_distinct, merged_spans, packed_ints, unpacked_chunks, unpacked_ints

# White space as Unicode has it; Java's \s is ASCII only.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BUCKETS = 1 << 17  # of the pair table, about one pair each
BITS = 17  # of an id; ranks stand above them
NO_RANK = 1 << 40
LONG = 256  # bytes; longer words are merged with a heap, since a fold takes quadratic time


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line. Its size is that of a vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def java_pattern(pattern: str) -> str:
    """The word pattern with white space spelled out for Java."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the token that two neighbours make, for all pairs of tokens that make one."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def _bucket(a, b):
    return (a * 7919 + b) % BUCKETS


def pair_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The pair ranks as one value, array<map<pair, rank>> by bucket, ranks shifted by BITS; bounded by the vocabulary."""
    pairs = np.array([(a, b, r) for (a, b), r in pair_ranks(ranks).items()], dtype=np.int64).reshape(-1, 3)
    table = pa.table({"bucket": _bucket(pairs[:, 0], pairs[:, 1]), "pair": (pairs[:, 0] << BITS) + pairs[:, 1], "rank": pairs[:, 2] << BITS})
    filled = spark.createDataFrame(table).groupBy("bucket").agg(F.collect_list(F.struct("pair", "rank")).alias("ranks"))
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(filled.hint("merge"), "bucket", "left")
    in_order = F.sort_array(F.collect_list(F.struct("bucket", "ranks")))
    return every.agg(F.transform(in_order, lambda x: F.map_from_entries(x["ranks"])).alias("pairs")).scalar()


def _pair(pairs: Column, a: Column, b: Column) -> Column:
    """Shifted rank of two neighbours, NO_RANK if they make no token or one is missing."""
    bucket = F.get(pairs, F.pmod(a * 7919 + b, F.lit(BUCKETS)).cast("int"))
    return F.coalesce(F.element_at(bucket, a * (1 << BITS) + b), F.lit(NO_RANK))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(ids: Column, pairs: Column) -> Column:
    """Merge the lowest-ranked neighbours, the leftmost first, until no pair has a rank. A token's id is its rank.

    The state holds one number per token: the rank that it makes with its right neighbour, shifted, plus its id. So the least number is
    the next merge, and equal numbers are equal pairs. A number without a rank ahead of all spares the first token a case of its own.
    """
    low = F.lit((1 << BITS) - 1)

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            return F.when(least >= NO_RANK, state).otherwise(_with(F.array_position(state, least).cast("int"), lambda p: merged(least, p)))

        def merged(least: Column, p: Column) -> Column:
            new = F.shiftright(least, BITS)
            before, after = F.get(state, p - 2).bitwiseAND(low), F.get(state, p + 1).bitwiseAND(low)
            changed = F.array(_pair(pairs, before, new) + before, _pair(pairs, new, after) + new)
            return F.concat(F.slice(state, F.lit(1), p - 2), changed, F.slice(state, p + 2, F.size(state)))

        return _with(F.array_min(state), at)

    size = F.size(ids)
    ranked = F.transform(ids, lambda a, i: _pair(pairs, a.cast("long"), F.get(ids, i + 1).cast("long")) + a)
    start = F.concat(F.array(F.lit(NO_RANK + (1 << BITS) - 1)), ranked)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, merge, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s)), lambda x: x.bitwiseAND(low).cast("int"))
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, by a heap over linked neighbours."""
    return [ranks[piece] for piece in merged_spans(word, ranks)]


FRESH_ROW = "block long, numbers binary, uses binary, fresh array<array<int>>, done array<array<int>>"
FRESH = pa.schema(
    [("block", pa.int64()), ("numbers", pa.binary()), ("uses", pa.binary()), ("fresh", pa.list_(pa.list_(pa.int32()))), ("done", pa.list_(pa.list_(pa.int32())))]
)


def _fresh(share):
    """Rows of words -> the words' numbers, with the byte ids of those that the partition has not seen before.

    Whole tokens are numbered by rank; words above LONG bytes come merged (``done``), all others have still to be folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = share.value
        single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        numbers: dict[bytes, int] = {}
        after = max(ranks.values()) + 1
        for batch in batches:
            for row in batch.select(["block", "numbers", "chunks"]).to_pylist():
                words = unpacked_chunks(row["chunks"])
                new = [w for w in words if w not in ranks and w not in numbers]
                fresh, done = [w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]
                for word in (*fresh, *done):
                    numbers[word] = after
                    after += 1
                uses = np.array([ranks[w] if w in ranks else numbers[w] for w in words], dtype=np.int64)
                bytes_ = single[np.frombuffer(b"".join(fresh), dtype=np.uint8)]
                merged = [merge_long(w, ranks) for w in done]
                columns = [pa.array([row["block"]]), pa.array([row["numbers"]]), pa.array([packed_ints(uses)], pa.binary())]
                for sizes, ids in (([len(w) for w in fresh], bytes_), ([len(m) for m in merged], np.array([i for m in merged for i in m], dtype=np.int32))):
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(ids, pa.int32()))
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), lists))
                yield pa.RecordBatch.from_arrays(columns, schema=FRESH)

    return run


def _coded(tokens: int):
    """Numbers of words -> their ids; the folded words of a row count on from those of the rows before, as ``_fresh`` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(np.arange(tokens))
        for batch in batches:
            for i in range(batch.num_rows):
                for name in ("fresh", "done"):
                    lists = batch.column(name)[i].values
                    codes.add(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64))
                yield codes.batch(batch.column("block")[i].as_py(), batch.column("numbers")[i].as_py(), unpacked_ints(batch.column("uses")[i].as_py()))

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, packed: bool = False) -> DataFrame:
    """Token ids of whole texts: doc_id, ids (array of int). Null and empty texts have none.

    ``packed`` adds the ids as little-endian unsigned 32-bit integers.

    ``pattern`` splits a text into words that are encoded on their own, as the rank file's tokenizer does; strings
    of special tokens are ordinary text. Words meet by bucket (``chunks.encode_distinct``), so each distinct word of the corpus is
    folded once, by higher-order functions with the rank map as a literal value; whole tokens need no fold. The ids
    return to the blocks of documents by place. Repeated rows give repeated rows; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)).alias("words"))
    share = spark.sparkContext.broadcast(ranks)  # of the vocabulary's size

    def code(rows: DataFrame) -> DataFrame:
        # One partition's rows pass through the three steps in order.
        words = rows.mapInArrow(_fresh(share), FRESH_ROW).withColumn("pairs", pair_table(spark, ranks))
        folded = words.select("block", "numbers", "uses", F.transform("fresh", lambda w: fold_merges(w, F.col("pairs"))).alias("fresh"), "done")
        return folded.mapInArrow(_coded(max(ranks.values()) + 1), CODE_ROW)

    if not packed:
        return encode_distinct(split, None, code)
    return encode_distinct(split, None, code, with_packed, "doc_id long, ids array<int>, packed binary")


def with_packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column(1)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    data = ids.values.to_numpy().astype("<u4").tobytes()
    rows = [data[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(rows, pa.binary())], names=["doc_id", "ids", "packed"])


def token_hex(ranks: dict[bytes, int]) -> list[str]:
    """The tokens' bytes in hexadecimal, by id."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return pieces


def _literal(pieces: list[str]) -> Column:
    """An array literal; it is folded from one string when the query is planned."""
    return F.split(F.lit(" ".join(pieces)), " ")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: the tokens' binary pieces, concatenated."""
    pieces = _literal(token_hex(ranks))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))
