"""Exact duplicates by Grace hashing, first inside each input partition, then across them."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.text import batches_of, utf8
from tidewire.session import settle

MEMORY = 64 << 20
FANOUT = 16
ENTRY = 200  # bytes a table entry needs besides its text


def grace(
    records: Iterator[tuple[bytes, tuple]],
    start: Callable[[bytes], list],
    add: Callable[[list, tuple], Iterator[tuple]],
    finish: Callable[[bytes, list], Iterator[tuple]],
    memory: int = MEMORY,
    level: int = 0,
) -> Iterator[tuple]:
    """Group records by their whole text in bounded memory.

    The table is a dict: open addressing, with a comparison of the complete text on every hit. Once it is
    full, records of texts it does not hold go to spill files, dealt by the hash of this level; each file
    is then grouped in the same way with the hash of the next level. A text is either in the table from
    its first record on or never, so no group is divided. Every pass settles a whole table, so it ends.
    """
    table: dict[bytes, list] = {}
    used, spills = 0, []
    try:
        for text, value in records:
            state = table.get(text)
            if state is None:
                if table and used + len(text) + ENTRY > memory:
                    if not spills:
                        # Nameless files, gone when the task ends in whatever way; a lost task starts anew.
                        spills = [tempfile.TemporaryFile(buffering=1 << 16) for _ in range(FANOUT)]
                    pickle.dump((text, value), spills[xxhash.xxh64_intdigest(text, level) % FANOUT], protocol=5)
                    continue
                state = table[text] = start(text)
                used += len(text) + ENTRY
            yield from add(state, value)
        for text, state in table.items():
            yield from finish(text, state)
        table.clear()
        for spill in spills:
            spill.seek(0)
            yield from grace(_read(spill), start, add, finish, memory, level + 1)
            spill.close()
    finally:
        for spill in spills:
            spill.close()


def _read(spill) -> Iterator[tuple[bytes, tuple]]:
    while True:
        try:
            yield pickle.load(spill)
        except EOFError:
            return


LOCAL = pa.schema(
    [("member", pa.int64()), ("tie", pa.int64()), ("rep", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("best", pa.int64())]
)
MERGED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("wins", pa.bool_()), ("text_sha256", pa.string())])


def _above(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _local(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = (TaskContext.get().partitionId() << 36) - 1

        def records():
            for batch in batches:
                # bytes.lower() changes A-Z only.
                yield from ((text.lower(), (key,)) for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True))

        def start(_):
            nonlocal counter
            counter += 1
            return [counter, 0, None, 0]  # number, members, largest id, members that hold it

        def add(state, value):
            key = value[0]
            if state[1] == 0 or _above(key, state[2]):
                state[2], state[3] = key, 0
            elif key == state[2]:
                state[3] += 1
            state[1] += 1
            yield key, state[3], state[0], None, None, None

        def finish(text, state):
            yield None, None, state[0], text, state[1], state[2]

        yield from batches_of(grace(records(), start, add, finish, memory), LOCAL)

    return run


def _merge(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                rep, body, n, best = (batch.column(i).to_pylist() for i in range(4))
                yield from ((t, (r, c, b)) for r, t, c, b in zip(rep, body, n, best, strict=True))

        def add(state, value):
            state.append(value)
            return iter(())

        def finish(text, state):
            # At most one entry for each input partition.
            best = None
            for _, _, b in state:
                best = b if _above(b, best) else best
            size = sum(c for _, c, _ in state)
            winner = min(r for r, _, b in state if b == best)
            digest = hashlib.sha256(text).hexdigest()
            yield from ((r, best, size, r == winner, digest) for r, _, _ in state)

        yield from batches_of(grace(records(), lambda _: [], add, finish, memory), MERGED)

    return run


def deduplicate(docs: DataFrame, *, memory: int = MEMORY) -> DataFrame:
    """Classes of equal texts, one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays; a null doc_id is smaller than any other. Of rows that repeat the largest doc_id
    one stays (its first local copy in the lowest partition). An empty table gives an empty result; other
    columns are not read.

    The first pass groups inside each input partition, so of a text with any number of copies one record
    per partition is shuffled. The second pass groups these records, dealt by the text's hash. Both passes
    hold ``memory`` bytes of distinct texts at most and spill the rest. The members meet their class on the
    number of the local group.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Stored once: local numbers must not change between the two uses, and lost executors cost no rerun.
    local = settle(narrow.mapInArrow(_local(memory), "member long, tie long, rep long, body binary, n long, best long"))
    merged = (
        local.where("body IS NOT NULL")
        .select("rep", "body", "n", "best")
        .repartition(F.xxhash64("body"))
        .mapInArrow(_merge(memory), "rep long, keep_id long, group_size long, wins boolean, text_sha256 string")
    )
    return (
        local.where("body IS NULL")
        .select("member", "tie", "rep")
        .join(merged, "rep")
        .select(
            F.col("member").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("wins") & (F.col("tie") == 0) & F.col("member").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )
