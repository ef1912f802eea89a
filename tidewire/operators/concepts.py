"""Concepts of one entity: bounded samples kept in order, decisions for blocks of rows at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidewire.functions.ks import ks_p_values

# Fixed values of the rule: a block belongs to a concept above P and certainly to the current one above 1 - P; a new concept
# that no known one explains even at MALICIOUS_P is malicious; rows are scaled by these percentiles.
P, MALICIOUS_P, PERCENTILES = 0.01, 1e-4, (0.16, 0.5, 0.84)


def draw(concept: int, seen: np.ndarray) -> np.ndarray:
    """Place of the ``seen``-th row of a concept among 0 .. seen - 1, the same on every run."""
    with np.errstate(over="ignore"):
        x = seen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(concept + 1) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % seen.astype(np.uint64)).astype(np.int64)


@dataclass
class Sample:
    """Uniform sample of a concept's rows, with every feature's values in order beside it."""

    number: int
    rows: np.ndarray
    seen: int
    malicious: bool = False
    ordered: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.ordered = np.sort(self.rows, axis=0)

    def places(self, count: int, limit: int) -> np.ndarray:
        """Where the next ``count`` rows go: a place of the sample, or -1."""
        at = self.seen + 1 + np.arange(count)
        drawn = draw(self.number, at)
        return np.where(at <= limit, at - 1, np.where(drawn < limit, drawn, -1))

    def add(self, rows: np.ndarray, limit: int) -> None:
        places = self.places(len(rows), limit)
        kept = np.concatenate((self.rows, np.empty((max(0, min(limit, self.seen + len(rows)) - len(self.rows)), rows.shape[1]))))
        for i in np.flatnonzero(places >= 0):  # in order: a later row may take an earlier one's place
            kept[places[i]] = rows[i]
        self.rows, self.seen = kept, self.seen + len(rows)
        self.ordered = np.sort(kept, axis=0)

    def steady(self, count: int, limit: int) -> int:
        """How many of the next ``count`` rows can come before the sample loses one."""
        places = self.places(count, limit)
        lost = np.flatnonzero((places >= 0) & (self.seen + 1 + np.arange(count) > limit))
        return int(lost[0]) if len(lost) else count


def growing_percentiles(ordered: np.ndarray, added: np.ndarray, probs=PERCENTILES) -> np.ndarray:
    """Percentiles (row, prob) of the values in order together with the first 0, 1, 2, ... of ``added`` (one row each).

    The k-th smallest of two ordered lists lies where as many of the second list come before it as fit; those counts are
    sums of comparisons, for all rows at once.
    """
    n, m = len(ordered), len(added)
    lists = np.where(np.tri(m, m, -1, dtype=bool), added[None, :], np.inf)  # row t: the first t values
    lists.sort(axis=1)
    lists = np.concatenate((np.full((m, 1), -np.inf), lists), axis=1)
    own = np.concatenate(([-np.inf], ordered, [np.inf]))
    sizes = n + np.arange(m)
    out = np.empty((m, len(probs)))
    for i, p in enumerate(probs):
        rank = p * (sizes - 1)
        ends = []
        for k in (np.floor(rank).astype(int), np.ceil(rank).astype(int)):
            # The j-th of the second list is among the k + 1 smallest if it lies below the (k - j)-th of the first.
            against = own[np.clip(k[:, None] - np.arange(m)[None, :], -1, n) + 1]
            taken = (lists[:, 1:] < against).sum(axis=1)
            ends.append(np.maximum(own[np.clip(k - taken, -1, n) + 1], lists[np.arange(m), taken]))
        low, high = ends
        out[:, i] = low + (rank - np.floor(rank)) * (high - low)
    return out


def sliding_distances(ordered: np.ndarray, rows: np.ndarray, width: int, count: int, entering: int) -> np.ndarray:
    """Two-sample distances for t = 0 .. count - 1 between the sample with the first t rows and the rows t .. t + width - 1.

    Of the rows only the first ``entering`` enter the sample. Distribution functions differ most at a value of the
    window: at it, or just below it.
    """
    x = rows[: count - 1 + width]
    below, upto = np.searchsorted(ordered, x, side="left"), np.searchsorted(ordered, x, side="right")
    window = np.arange(count)[:, None] + np.arange(width)[None, :]
    values = np.sort(x[window], axis=1)
    order = np.take_along_axis(window, np.argsort(x[window], axis=1, kind="stable"), axis=1)
    # Rows before t that lie below, or not above, each value of the window.
    first = np.concatenate((np.zeros((1, len(x)), int), np.cumsum(x[: max(count - 1, 0), None] < x[None, :], axis=0)))
    last = np.concatenate((np.zeros((1, len(x)), int), np.cumsum(x[: max(count - 1, 0), None] <= x[None, :], axis=0)))
    at = np.minimum(np.arange(count), entering)[:, None]
    size = len(ordered) + at
    under, over = (below[order] + first[at, order]) / size, (upto[order] + last[at, order]) / size
    mine_under = np.stack([np.searchsorted(v, v, side="left") for v in values]) / width
    mine_over = np.stack([np.searchsorted(v, v, side="right") for v in values]) / width
    return np.maximum(np.abs(under - mine_under), np.abs(over - mine_over)).max(axis=1)


class History:
    """The concepts of one entity while its rows arrive.

    The first ``least`` rows make concept 0, the next ``least`` wait; from then on every new row lets the longest waiting one be
    decided. Where no decision is standing, the waiting rows are held against the current concept: if they fit beyond doubt, all
    of them are its own; if they do not fit, they belong to the oldest concept they fit, into which other fitting ones
    merge, or make a new one, and this concept is current from then on; in between only the row in turn is its own.
    """

    def __init__(self, width: int, least: int, most: int) -> None:
        self.least, self.most = least, most
        self.start, self.waiting = np.empty((0, width)), np.empty((0, width))
        self.concepts: dict[int, Sample] = {}
        self.current, self.made, self.standing = 0, 0, 0
        self.arrived, self.decided = 0, 0

    def plain(self) -> dict:
        """The state as numbers and arrays."""
        samples = [(c.number, c.rows, c.seen, c.malicious) for c in self.concepts.values()]
        return {**vars(self), "concepts": samples}

    @classmethod
    def resumed(cls, plain: dict) -> History:
        history = cls(plain["start"].shape[1], plain["least"], plain["most"])
        vars(history).update(plain, concepts={c[0]: Sample(*c) for c in plain["concepts"]})
        return history

    def arrive(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take rows; give those that are decided, in order: rows, scaled rows, concepts, malice, number of concepts."""
        self.arrived += len(rows)
        short = self.least - len(self.start)
        if short > 0:
            self.start = np.concatenate((self.start, rows[:short]))
            rows = rows[short:]
            if len(self.start) < self.least:
                return self._none()
            self.concepts[0] = Sample(0, self.start, len(self.start))
        self.waiting = np.concatenate((self.waiting, rows))
        parts = []
        while (free := len(self.waiting) - self.least) > 0:
            if not self.standing and (count := self._doubtful(free)):
                parts.append(self._decide(count))
                continue
            parts.append(self._decide(min(free, self.standing)))
            self.standing -= len(parts[-1][0])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else self._none()

    def _none(self):
        none = np.empty((0, self.start.shape[1]))
        return none, none, np.empty(0, int), np.empty(0, bool), np.empty(0, int)

    def _doubtful(self, free: int) -> int:
        """How many rows in turn go to the current concept one by one; 0 after a decision about all waiting rows."""
        sample = self.concepts[self.current]
        # The first loss of a sampled row takes effect after its row is decided.
        count = min(free, self.least, sample.steady(min(free, self.least), self.most) + 1)
        entering = min(count, max(0, self.most - sample.seen))
        columns = zip(sample.ordered.T, self.waiting.T, strict=True)
        distance = np.max([sliding_distances(mine, rows, self.least, count, entering) for mine, rows in columns], axis=0)
        sizes = len(sample.rows) + np.minimum(np.arange(count), entering)
        p = ks_p_values(distance, self.least, sizes)
        clear = np.flatnonzero((p > 1 - P) | (p < P))
        if len(clear) and clear[0] == 0:
            if p[0] < P:
                self.current = self._home(self.waiting[: self.least])
            self.standing = self.least
            return 0
        return int(clear[0]) if len(clear) else count

    def _home(self, rows: np.ndarray) -> int:
        """The concept that rows belong to."""
        p = {}
        for number, sample in self.concepts.items():
            distance = max(sliding_distances(sample.ordered[:, f], rows[:, f], len(rows), 1, 0)[0] for f in range(rows.shape[1]))
            p[number] = float(ks_p_values(np.array([distance]), len(rows), np.array([len(sample.rows)]))[0])
        fitting = [number for number, value in p.items() if value > P]
        if fitting:
            first, *others = (self.concepts[number] for number in fitting)
            for other in others:
                first.add(other.rows, self.most)
                first.malicious |= other.malicious
                del self.concepts[other.number]
            return first.number
        self.made += 1
        new = Sample(self.made, np.empty((0, rows.shape[1])), 0, max(p.values()) < MALICIOUS_P)
        new.add(rows, self.most)
        self.concepts[self.made] = new
        return self.made

    def _decide(self, count: int) -> tuple[np.ndarray, ...]:
        """Scale the next ``count`` waiting rows by the current concept and add each to it before the one after."""
        sample, rows = self.concepts[self.current], self.waiting[:count]
        self.waiting = self.waiting[count:]
        scaled = np.empty(rows.shape)
        at = 0
        while at < count:
            part = min(count - at, sample.steady(count - at, self.most) + 1)
            some = rows[at : at + part]
            grows = min(part, max(0, self.most - sample.seen))  # rows that enter before the sample is full
            for f in range(rows.shape[1]):
                entered = growing_percentiles(sample.ordered[:, f], some[: grows + 1, f])
                # Rows a full sample does not take leave it as it is.
                marks = entered[np.minimum(np.arange(part), len(entered) - 1)]
                spread = marks[:, 2] - marks[:, 0]
                scaled[at : at + part, f] = (some[:, f] - marks[:, 1]) / np.where(spread == 0, 1.0, spread)
            sample.add(some, self.most)
            at += part
        self.decided += count
        return rows, scaled, np.full(count, sample.number), np.full(count, sample.malicious), np.full(count, len(self.concepts))
