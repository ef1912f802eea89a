"""SentencePiece BPE: every distinct chunk between white space markers is segmented once."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import CODE_ROW, Codes, encode_distinct, merged_spans, ragged, unpacked_chunks

MARK = "▁"  # stands for a space
CHUNK = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")
NONE = np.int32(2**31 - 1)  # rank of neighbours that make no piece
PAD = np.int32(-(2**31))
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64)  # symbols of the chunks that are merged together; longer ones use a heap
ROWS_AT_ONCE = 1 << 14  # rows of a matrix
IDS_AT_ONCE = 1 << 19  # ids that are decoded together
FRESH_AT_ONCE = 1 << 16  # new chunks that a task segments together


@dataclass
class Pieces:
    """A vocabulary of ranked pieces with byte fallback, as its model file states it."""

    pieces: list[str]
    ranks: dict[str, int]  # of the pieces that merges may make; equal scores share one
    ids: dict[str, int]
    byte_ids: np.ndarray
    end: int
    single: np.ndarray = field(init=False)  # id of a code point's piece, or -1 - code point
    table: tuple[np.ndarray, np.ndarray, np.ndarray] = field(init=False)  # pair, rank, id by hash

    def __post_init__(self) -> None:
        self.single = -1 - np.arange(0x110000, dtype=np.int32)
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = number
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ids.get(piece[:i]), self.ids.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank, self.ids[piece])
        keys = np.array(list(pairs), dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        slots, places = np.full(size, -1, np.int64), np.zeros((size, 2), np.int32)
        at, left = _hash(keys, size), np.arange(len(keys))
        while len(left):  # open addressing; of the keys that want a free slot one gets it
            free = slots[at[left]] == -1
            slots[at[left[free]]] = keys[left[free]]
            left = left[slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % size
        for key, value in zip(keys, values, strict=True):
            slot = _hash(np.array([key]), size)[0]
            while slots[slot] != key:
                slot = (slot + 1) % size
            places[slot] = value
        self.table = slots, np.ascontiguousarray(places[:, 0]), np.ascontiguousarray(places[:, 1])

    @cached_property
    def spelling(self) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings of the pieces (None for bytes), their bytes side by side with starts and sizes, and which begin with a space."""
        bytes_ = {int(i): b for b, i in enumerate(self.byte_ids)}
        strings = [None if i in bytes_ else p.replace(MARK, " ") if p in self.ids else "" for i, p in enumerate(self.pieces)]
        raws = [bytes([bytes_[i]]) if s is None else s.encode() for i, s in enumerate(strings)]
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        spaced = np.array([bool(s) and s[0] == " " for s in strings])
        return strings, np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, spaced

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that neighbours make; NONE where they make none."""
        slots, ranks, ids = self.table
        shape = a.shape
        key = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        key[(a.ravel() < 0) | (b.ravel() < 0)] = -1
        rank, made = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        left = np.flatnonzero(key >= 0)
        wanted = key[left]
        at = _hash(wanted, len(slots))
        while len(left):
            held = slots[at]
            hit = held == wanted
            rank[left[hit]], made[left[hit]] = ranks[at[hit]], ids[at[hit]]
            further = ~hit & (held != -1)
            left, wanted, at = left[further], wanted[further], (at[further] + 1) % len(slots)
        return rank.reshape(shape), made.reshape(shape)


def _hash(keys: np.ndarray, size: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) ^ (x >> np.uint64(17))).astype(np.int64) & (size - 1)


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a BPE model file; its size is that of a vocabulary.

    Chunks are independent only if no piece holds a marker behind another letter, and texts stay as they are only
    under the identity rule; models with other rules are refused.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in every]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in every]
    plain = {pieces[i]: i for i in every if not special[i]}
    probe = "  A ﬁ  é "
    if any(model.is_unused(i) for i in every) or any(MARK in p.lstrip(MARK) for p in plain) or model.decode(model.encode(probe)) != probe:
        raise ValueError("pieces across white space, unused pieces and rewriting rules are not supported")
    by_byte = {pieces[i]: i for i in every if model.is_byte(i)}
    scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
    order = {score: rank for rank, score in enumerate(scores)}
    ranks = {p: order[model.get_score(i)] for p, i in plain.items()}
    return Pieces(pieces, ranks, plain, np.array([by_byte[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int32), model.eos_id())


def cut(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """Texts' chunks, runs of white space markers with the letters behind them, each without its first marker.

    A marker goes ahead of a text that is not empty, so every chunk has one. Texts whose markers are single spaces between
    words are split at them, all others by pattern.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
    yield plain, pc.split_pattern(texts.take(pa.array(plain)), " ")
    lists = [[chunk[1:] for chunk in CHUNK.findall(" " + text)] if text else [] for text in texts.take(pa.array(other)).to_pylist()]
    yield other, pa.array(lists, pa.list_(pa.string()))


def _merge(ids: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Merge the best-ranked neighbours of every row, the leftmost of equals, until none makes a piece."""
    done = np.full_like(ids, PAD)
    rows = np.arange(len(ids))
    rank = vocabulary.look_up(ids[:, :-1], ids[:, 1:])[0]
    while len(rows):
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        more = rank[np.arange(len(rows)), at] < NONE if rank.shape[1] else np.zeros(len(rows), bool)
        done[rows[~more], : ids.shape[1]] = ids[~more]
        rows, ids, rank, at = rows[more], ids[more], rank[more], at[more]
        if not len(rows):
            break
        line = np.arange(len(rows))
        made = vocabulary.look_up(ids[line, at], ids[line, at + 1])[1]
        # A row that goes on loses one symbol and one pair.
        columns = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
        ids[line, at] = made
        columns = columns[:-1]
        rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < rank.shape[1])
        rank[left, at[left] - 1] = vocabulary.look_up(ids[left, at[left] - 1], made[left])[0]
        rank[right, at[right]] = vocabulary.look_up(made[right], ids[right, at[right] + 1])[0]
    return done


def _with_bytes(ids: np.ndarray, counts: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Code points without a piece give way to the pieces of their bytes."""
    strange = np.flatnonzero(ids < 0)
    if not len(strange):
        return ids, counts
    parts = [vocabulary.byte_ids[list(chr(-1 - int(i)).encode())] for i in ids[strange]]
    sizes = np.ones(len(ids), np.int64)
    sizes[strange] = [len(p) for p in parts]
    out = np.repeat(ids, sizes)
    out[np.repeat(ids < 0, sizes)] = np.concatenate(parts)
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)


def segment(chunks: list[str], vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks in a row, and how many each has."""
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    symbols = vocabulary.single[np.frombuffer("".join(chunks).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32)]
    ends = np.cumsum(sizes)
    counts = np.zeros(len(chunks), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for width in WIDTHS:
        group = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for some in (group[i : i + ROWS_AT_ONCE] for i in range(0, len(group), ROWS_AT_ONCE)):
            inside = np.arange(width) < sizes[some, None]
            rows = np.full((len(some), width), PAD, np.int32)
            rows[inside] = symbols[ragged(ends[some] - sizes[some], sizes[some])]
            merged = _merge(rows, vocabulary)
            kept = merged != PAD
            counts[some] = kept.sum(axis=1)
            done.append((some, merged[kept]))
    for i in np.flatnonzero(sizes > low):
        spans = merged_spans(chunks[i].replace(" ", MARK), vocabulary.ranks)
        ids = np.fromiter((vocabulary.ids.get(s, -1 - ord(s[0])) for s in spans), np.int32)
        counts[i] = len(ids)
        done.append((np.array([i]), ids))
    starts, flat = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
    for some, ids in done:
        flat[ragged(starts[some], counts[some])] = ids
    return _with_bytes(flat, counts, vocabulary)


def _code(share) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, codes = share.value, {}, Codes()
        for batch in batches:
            rows = batch.select(["block", "numbers", "chunks"]).to_pylist()
            while rows:
                some, fresh = [], {}
                while rows and len(fresh) < FRESH_AT_ONCE:
                    row = rows.pop()
                    row["chunks"] = unpacked_chunks(row["chunks"])
                    fresh.update((c, None) for c in row["chunks"] if c not in known)
                    some.append(row)
                if fresh:
                    codes.add(*segment([MARK + c.decode() for c in fresh], vocabulary))
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                for row in some:
                    yield codes.batch(row["block"], row["numbers"], np.array([known[c] for c in row["chunks"]], dtype=np.int64))

    return run


def encode(docs: DataFrame, vocabulary: Pieces, *, end: bool = False, decoded: bool = False) -> DataFrame:
    """Token ids of whole texts: doc_id, ids (array of int); with ``end`` an end id closes them. Null and empty texts have no others.
    ``decoded`` adds ``text``, what the ids decode to.

    As the model's library encodes: a marker goes ahead of the text, spaces become markers, neighbours merge by the pieces'
    scores, and code points without a piece fall back to bytes; strings of special tokens are ordinary text. No piece crosses from
    a chunk to the next marker, so each distinct chunk of a bucket is segmented once, many at a time as rows of a matrix, and the
    ids return by place (``chunks.encode_distinct``). Repeated rows give repeated rows, a null doc_id stays null; an
    empty table gives an empty result; other columns are not read.
    """
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(0), ended(batch.column(1), share.value.end) if end else batch.column(1)]
        columns += [texts_of(columns[1], share.value)] if decoded else []
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    names = "doc_id long, ids array<int>" + (", text string" if decoded else "")
    return encode_distinct(texts, cut, lambda rows: rows.mapInArrow(_code(share), CODE_ROW), finish, names)


def ended(ids: pa.ListArray, end: int) -> pa.ListArray:
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = np.insert(ids.values.to_numpy()[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], end)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0] + np.arange(len(offsets)), pa.int32()), pa.array(flat, pa.int32()))


# Of bytes that are no UTF-8 every one becomes a replacement character.
codecs.register_error("each_byte", lambda error: ("\ufffd", error.start + 1))


def decoded(ids: list[int], vocabulary: Pieces, strings: list[str | None]) -> str:
    """The text of ids, as the model's library decodes them: without the first marker; bytes that are no UTF-8 become U+FFFD."""
    out, raw, first = [], bytearray(), True
    for i in ids:
        piece = strings[i]
        if piece is None:
            raw.append(int(vocabulary.pieces[i][3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "each_byte"))
            raw.clear()
            first = False
        if first and piece:
            first = False
            piece = piece.removeprefix(" ")
        out.append(piece)
    if raw:
        out.append(raw.decode("utf-8", "each_byte"))
    return "".join(out)


def texts_of(ids: pa.ListArray, vocabulary: Pieces) -> pa.Array:
    """The texts of many rows of ids: the pieces' bytes side by side; rows that are no UTF-8 one by one. Null gives null."""
    offsets, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
    parts, at = [], 0
    while at < len(ids):  # rows of about IDS_AT_ONCE ids together
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + IDS_AT_ONCE, side="right")) - 1)
        ends = offsets[at : upto + 1]
        parts += _texts(flat[ends[0] : ends[-1]], ends - ends[0], vocabulary)
        at = upto
    return pa.array([t if ok else None for t, ok in zip(parts, ids.is_valid().to_pylist(), strict=True)], pa.string())


def _texts(ids: np.ndarray, ends: np.ndarray, vocabulary: Pieces) -> list[str]:
    strings, letters, starts, sizes, spaced = vocabulary.spelling
    taken = sizes[ids]
    skip = np.zeros(len(ids), dtype=np.int64)
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        while low < high and taken[low] == 0:
            low += 1
        if low < high and spaced[ids[low]]:
            skip[low] = 1  # the marker ahead of the text
    whole = letters[ragged(starts[ids] + skip, taken - skip)].tobytes()
    places = np.concatenate((np.zeros(1, np.int64), np.cumsum(taken - skip)))[ends].tolist()
    out = []
    for i, (low, high) in enumerate(zip(places[:-1], places[1:], strict=True)):
        try:
            out.append(whole[low:high].decode())
        except UnicodeDecodeError:
            out.append(decoded(ids[ends[i] : ends[i + 1]].tolist(), vocabulary, strings))
    return out


def decode(vocabulary: Pieces) -> Callable:
    """A column function: array of ids -> text. Control ids are silent; null gives null."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return texts_of(ids, vocabulary)

    return text
