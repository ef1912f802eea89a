"""Tables of distinct chunks: texts as places in a block's chunks, every distinct chunk coded once, codes joined back by place.

A task cuts its texts into chunks and numbers the distinct ones of a block of texts. The chunks of all blocks meet by bucket of
their checksum, so equal chunks meet in one task and are coded once; their ids return to the blocks. Only packed arrays are shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHUNKS = 1 << 21  # chunks of a block of texts
BLOCK_DISTINCT, BLOCK_BYTES = 400_000, 16 << 20  # distinct ones, and their bytes
TEXTS_AT_ONCE = 1024  # texts that are split together
ROW_CHUNKS = 1 << 18  # chunks of the texts that share a row
BUCKETS_A_PARTITION = 4

BLOCKS = pa.schema(
    [
        ("place", pa.int64()), ("block", pa.int64()), ("numbers", pa.binary()), ("chunks", pa.binary()),
        ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary()),
    ]
)
BLOCK_ROW = "place long, block long, numbers binary, chunks binary, docs array<long>, counts array<long>, places binary"
CODES = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
CODE_ROW = "block long, numbers binary, counts binary, ids binary"
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def packed_ints(values: np.ndarray) -> bytes:
    """32-bit integers, their first, second, third and fourth bytes together."""
    raw = np.ascontiguousarray(values, dtype="<i4").view(np.uint8).reshape(-1, 4)
    return squeezed(np.ascontiguousarray(raw.T).tobytes())


def unpacked_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expanded(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").ravel()


def packed_chunks(chunks: Sequence[bytes]) -> bytes:
    sizes = np.array([len(c) for c in chunks], dtype="<i4").tobytes()
    return len(chunks).to_bytes(4, "little") + squeezed(sizes + b"".join(chunks))


def unpacked_chunks(data: bytes) -> list[bytes]:
    n, body = int.from_bytes(data[:4], "little"), expanded(data[4:])
    ends = (np.cumsum(np.frombuffer(body, dtype="<i4", count=n), dtype=np.int64) + 4 * n).tolist()
    return [body[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)] if n else []


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(starts - before, counts)


class _Numbers(dict):
    """Chunk -> its number, in the order of first use."""

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = number = len(self)
        return number


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _slices(docs: pa.Array, lists: pa.ListArray) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Rows of about ROW_CHUNKS chunks together."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(lists):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + ROW_CHUNKS, side="right")))
        yield docs.slice(at, upto - at), lists.slice(at, upto - at)
        at = upto


def _block_rows(cut: Callable[[pa.Array], Iterable[tuple[np.ndarray, pa.ListArray]]] | None, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers, used, held = TaskContext.get().partitionId() << 32, _Numbers(), 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list] = {}
            for chunk, number in numbers.items():
                by_bucket.setdefault(zlib.crc32(chunk) % buckets, []).append((chunk, number))
            for bucket in list(by_bucket):
                some = by_bucket.pop(bucket)
                some.sort()  # alike chunks side by side take less room
                chunks, places = zip(*some, strict=True)
                yield _rows(BLOCKS, place=[-1 - bucket], block=[block], numbers=[packed_ints(np.array(places))], chunks=[packed_chunks(chunks)])
            pa.default_memory_pool().release_unused()

        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = batch.column(1)
            for rows, cut_rows in cut(texts) if cut else [(None, texts)]:
                ids = batch.column(0) if rows is None else batch.column(0).take(pa.array(rows))
                for docs, lists in _slices(ids, cut_rows):
                    coded = lists.flatten().dictionary_encode()
                    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
                    known = len(numbers)
                    own = np.fromiter(map(numbers.__getitem__, distinct), np.int32, len(distinct))
                    held += sum(len(c) for c, n in zip(distinct, own.tolist(), strict=True) if n >= known)
                    places = own[coded.indices.to_numpy()]
                    counts = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
                    yield _rows(BLOCKS, place=[block], block=[block], docs=[docs.to_pylist()], counts=[counts], places=[packed_ints(places)])
                    used += len(places)
                    if used >= BLOCK_CHUNKS or len(numbers) >= BLOCK_DISTINCT or held >= BLOCK_BYTES:
                        yield from close()
                        block, numbers, used, held = block + 1, _Numbers(), 0, 0
        yield from close()

    return run


class Codes:
    """Ids of numbered chunks in one growing array."""

    def __init__(self, ids: np.ndarray | None = None) -> None:
        """``ids``: the first chunks' ids, one each."""
        self.flat = np.zeros(1 << 16, np.int32) if ids is None else ids.astype(np.int32)
        self.used = self.n = 0 if ids is None else len(ids)
        self.starts = np.zeros(max(self.n, 1 << 10), np.int64)
        self.sizes = np.ones(max(self.n, 1 << 10), np.int64)
        self.starts[: self.n] = np.arange(self.n)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        for name, used, more in (("flat", self.used, len(ids)), ("starts", self.n, len(counts)), ("sizes", self.n, len(counts))):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate((held[:used], np.zeros(max(len(held), more), held.dtype))))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.sizes[self.n : self.n + len(counts)] = counts
        self.used, self.n = self.used + len(ids), self.n + len(counts)

    def batch(self, block: int, numbers: bytes, at: np.ndarray) -> pa.RecordBatch:
        """A row of codes for the chunks with these numbers."""
        if len(at) and at.max() >= self.n:
            raise ValueError("a chunk is used before it is coded")
        sizes = self.sizes[at]
        ids = self.flat[ragged(self.starts[at], sizes)]
        return _rows(CODES, block=[block], numbers=[numbers], counts=[packed_ints(sizes)], ids=[packed_ints(ids)])


def _join_back(texts: pa.Table, codes: pa.Table, finish: Callable[[pa.RecordBatch], pa.RecordBatch]) -> pa.Table:
    """The ids of a block's texts: every place in a text is replaced by its chunk's ids."""
    numbers, counts, ids = [], [], []
    for row in codes.select(["numbers", "counts", "ids"]).to_pylist():
        numbers.append(unpacked_ints(row["numbers"]).astype(np.int64))
        counts.append(unpacked_ints(row["counts"]).astype(np.int64))
        ids.append(unpacked_ints(row["ids"]))
    none = np.zeros(0, dtype=np.int64)
    at, sizes, flat = (np.concatenate([none, *x]) for x in (numbers, counts, ids))
    starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    starts[at], lengths[at], flat = np.cumsum(sizes) - sizes, sizes, flat.astype(np.int32)
    del numbers, counts, ids
    out = []
    for docs, counts, packed in zip(*(texts.column(c) for c in ("docs", "counts", "places")), strict=True):
        places = unpacked_ints(packed.as_py())
        taken = lengths[places]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(taken)))[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts.values.to_numpy())))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[ragged(starts[places], taken)]))
        out.append(finish(pa.RecordBatch.from_arrays([docs.values, lists], schema=ENCODED)))
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out)


def encode_distinct(
    texts: DataFrame, cut: Callable | None, code: Callable[[DataFrame], DataFrame], finish: Callable = lambda batch: batch, columns: str = "doc_id long, ids array<int>"
) -> DataFrame:
    """Ids of whole texts: doc_id, ids; ``finish`` may turn batches of these into other ``columns``.

    ``texts`` has two columns, doc_id and a text, which ``cut`` splits into chunks: it takes an array of texts and gives lists of
    chunks with the places of their texts; with None the second column holds the lists. ``code`` takes
    rows with packed chunks (block, numbers, chunks; equal chunks share a partition) and returns rows of CODE_ROW; it may hold the
    distinct chunks of its partition, which are a share of all. Blocks are bounded, so no task holds more than one block's
    distinct chunks; a chunk that all texts share stands once per block.

    One exchange deals texts by block and chunks by bucket; both sides below read it.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(_block_rows(cut, BUCKETS_A_PARTITION * partitions), BLOCK_ROW)
    dealt = rows.repartition(partitions, "place")
    codes = code(dealt.mapInArrow(_only_chunks, CHUNK_ROW))
    # A filter that is not deterministic stays behind the exchange, which otherwise would be made twice.
    blocks = dealt.where(F.when(F.col("docs").isNull(), 0).otherwise(1) > F.rand())
    return blocks.groupBy("place").cogroup(codes.withColumnRenamed("block", "place").groupBy("place")).applyInArrow(lambda left, right: _join_back(left, right, finish), columns)


CHUNK_ROW = "block long, numbers binary, chunks binary"


def _only_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column("chunks").is_valid()).select(["block", "numbers", "chunks"])


def merged_spans(chunk, ranks) -> Iterable:
    """The pieces of a long chunk: neighbours whose joint piece ranks lowest merge first, the leftmost of equals; by a heap over links."""
    n = len(chunk)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (rank := ranks.get(chunk[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[i], ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        j = after[i]
        if ends[i] != middle or j >= n or ends[j] != end:
            continue  # one of the two has been merged since
        ends[i], after[i] = end, after[j]
        ends[j] = -1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    i = 0
    while i < n:
        yield chunk[i : ends[i]]
        i = after[i]
