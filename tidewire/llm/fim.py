"""Fill-in-middle: texts cut at two units that Fenwick trees over fixed text blocks locate."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # bytes of a text block
SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN_PERCENT, SPM_PERCENT = 10, 20
PARTS = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _tree(counts: np.ndarray) -> np.ndarray:
    """Fenwick trees (one a row) of the counts per block: node i holds the blocks (i - lowest bit of i, i]."""
    upto = np.concatenate((np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1, dtype=np.int64)), axis=1)
    node = np.arange(upto.shape[1])
    return upto - upto[:, node - (node & -node)]


class TextBlocks:
    """A text in UTF-8 with the number of units and of code points per block, as Fenwick trees.

    ``starts`` are the byte offsets of the units, in order; None takes every code point as a unit.
    """

    def __init__(self, data: bytes, starts: np.ndarray | None = None, block: int = BLOCK) -> None:
        self.size, self.block = len(data), block
        self.leads = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        self.starts = starts
        blocks = -(-self.size // block)
        edges = np.arange(blocks) * block
        chars = np.add.reduceat(self.leads, edges, dtype=np.int64) if blocks else np.zeros(0, np.int64)
        units = chars if starts is None else np.bincount(starts // block, minlength=blocks)
        self.n = int(units.sum())
        self.nodes = _tree(np.stack((units, chars))).T.tolist()

    def cut(self, k: int) -> tuple[int, int]:
        """Byte offset and code points before the place where unit ``k`` (from 0) starts; 0 is the start, n the end."""
        if k == 0:
            return 0, 0
        at, left, chars, step = 0, k, 0, 1 << (len(self.nodes) - 1).bit_length()
        while step:
            if at + step < len(self.nodes) and self.nodes[at + step][0] <= left:
                at += step
                left -= self.nodes[at][0]
                chars += self.nodes[at][1]
            step >>= 1
        low = at * self.block
        if k >= self.n:  # every unit lies before; text behind the last one goes with it
            return self.size, chars + int(self.leads[low:].sum())
        high = min(low + self.block, self.size)
        if self.starts is None:
            offset = low + int(np.flatnonzero(self.leads[low:high])[left])
        else:
            offset = int(self.starts[np.searchsorted(self.starts, low) + left])
        return offset, chars + int(self.leads[low:offset].sum())


def _starts(text: str, data: bytes, unit: re.Pattern) -> np.ndarray:
    places = np.array([m.start() for m in unit.finditer(text) if m.end() > m.start()], dtype=np.int64)
    return np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[places] if len(places) else places


def rearranged(text: str, draws: tuple[int, int, int, int], unit: re.Pattern | None, sentinels=SENTINELS, plain=PLAIN_PERCENT, spm=SPM_PERCENT) -> dict:
    """One text cut and put together anew; see ``fill_in_middle``."""
    data = text.encode()
    blocks = TextBlocks(data, None if unit is None else _starts(text, data, unit))
    out = {"n": blocks.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    if not data or draws[2] % 100 >= 100 - plain or any(s in text for s in sentinels):
        return out
    first, second = sorted(d % (blocks.n + 1) for d in draws[:2])
    (a, before), (b, upto) = blocks.cut(first), blocks.cut(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = (x.encode() for x in sentinels)
    form = "spm" if draws[3] % 100 < spm else "psm"
    output = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return out | {"form": form, "prefix_chars": before, "middle_chars": upto - before, "output": output.decode()}


def fill_in_middle(
    docs: DataFrame,
    *,
    unit: str | None = None,
    seed: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """All rows as ``row`` with n (units), form, prefix_chars, middle_chars and output.

    ``unit`` is a pattern whose non-empty matches, left to right, are the units; None takes code points. A cut after k units
    lies where unit k (from 0) starts, so text between matches goes with the unit before it and text before the first match
    with the first piece; a cut after all n units lies at the end. Four draws h1 to h4 are the first 8-digit groups of
    the hex sha256 of ``seed:doc_id``: prefix and middle end after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1)
    units. Form is ``plain`` (the text itself) if the text is empty or holds a sentinel, or for ``plain_percent`` of h3 % 100;
    else ``spm`` (suffix, prefix, middle) for ``spm_percent`` of h4 % 100, else ``psm``. A null text counts as empty, a
    null doc_id as the empty string. Rows that repeat doc_id and text get the same result; an empty table gives an empty result;
    input columns stay inside ``row`` and cannot clash. One pass, no shuffle: a text's cuts depend on its row only.
    """
    pattern = None if unit is None else re.compile(unit)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def parts(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        draws = zip(h1.to_pylist(), h2.to_pylist(), h3.to_pylist(), h4.to_pylist(), strict=True)
        rows = [rearranged(t.as_py() or "", d, pattern, sentinels, plain_percent, spm_percent) for t, d in zip(text, draws, strict=True)]
        return pa.array(rows, PARTS)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    made = docs.select(F.struct("*").alias("row"), parts(F.col("text").cast("string"), *draws).alias("made"))
    return made.select("row", "made.*")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from output and form. No piece holds a sentinel, so splitting at them gives the three pieces back."""
    pieces = F.split(output, "|".join(re.escape(s) for s in sentinels))
    psm = F.concat(pieces[1], pieces[3], pieces[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(pieces[2], pieces[3], pieces[1]))
