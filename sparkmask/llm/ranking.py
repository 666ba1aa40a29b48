"""Bradley-Terry strengths from all pairs of good and bad rows, in passes over blocks of features.

A block is (x, y, whole): features, labels 0 and 1, and which rows are whole texts.  Blocks lie in memory (`Held`) or in a
DataFrame (`Stored`); every pass reads all of them, and only sums of fixed size come to the driver.

The loss over all pairs and its gradient hang on rows through their scores alone: a row's part in the gradient is its
features times a function of its score, which counts of the other label's scores give.  So no pairs are made.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Counts of scores stand this close; a score between two is shared out to both, which moves no pair's loss by over 5e-7.
STEP = 1 / 256
#: As `STEP`, for sums of rows by score, on which only the way of the descent hangs and not its end.
COARSE = 1 / 2
#: Bits of a double that are settled in each pass of `order_statistics`.
DIGITS = (12, 11, 11, 10, 10, 10)

#: Adds a block's part to an array of sums.
Adder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]
#: Values, a row each and in any number of columns, of a block.
Values = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Held:
    """Blocks in the driver's memory."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.blocks = blocks

    def total(self, add: Adder, size: int, grouped: bool = False) -> np.ndarray:
        out = np.zeros(size)
        for b in self.blocks:
            add(out, *b)
        return out

    def widest(self, values: Values, low: float, high: float) -> tuple[float, float] | None:
        """The two neighbours furthest apart among the values from low to high; the lowest such two."""
        v = np.concatenate([values(*b).ravel() for b in self.blocks])
        return _widest([_gap(np.sort(v[(v >= low) & (v <= high)]))])


class Stored:
    """Blocks that `unpack` makes of a DataFrame's batches, which is read anew in each pass."""

    def __init__(self, rows: DataFrame, unpack: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]):
        self.rows, self.unpack = rows, unpack

    def total(self, add: Adder, size: int, grouped: bool = False) -> np.ndarray:
        """Sums over all blocks; if grouped, tasks' sums are added before they come to the driver."""
        unpack = self.unpack

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for block in unpack(batches):
                add(out, *block)
            at = np.flatnonzero(out)
            part = np.full(len(at), TaskContext.get().partitionId())
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(at, pa.int64()), pa.array(out[at])], ["part", "k", "v"])

        with small_batches(self.rows.sparkSession):
            sums = self.rows.mapInArrow(run, "part int, k long, v double")
            sums = sums.groupBy("k").agg(F.sum("v").alias("v")) if grouped else sums
            got = sums.toArrow()
        got = got if grouped else got.sort_by("part")
        out = np.zeros(size)
        np.add.at(out, got["k"].to_numpy(), got["v"].to_numpy())
        return out

    def widest(self, values: Values, low: float, high: float) -> tuple[float, float] | None:
        unpack = self.unpack

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in unpack(batches):
                v = values(*block).ravel()
                yield pa.record_batch([pa.array(v[(v >= low) & (v <= high)])], ["v"])

        def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the values of a task come in order
            found = [g for b in batches if (g := _gap(b.column("v").to_numpy()))]
            if found:
                best = _widest(found) or (found[0][0],) * 2
                yield pa.record_batch([pa.array([v]) for v in (found[0][0], found[-1][1], *best)], ["first", "last", "left", "right"])

        with small_batches(self.rows.sparkSession, rows=1 << 16):
            ordered = self.rows.mapInArrow(between, "v double").repartitionByRange("v").sortWithinPartitions("v")
            got = ordered.mapInArrow(gaps, "first double, last double, left double, right double").collect()
        return _widest(sorted(tuple(r) for r in got))


def _gap(v: np.ndarray) -> tuple[float, float, float, float] | None:
    """(first, last, left, right) of values in order, where left and right are the neighbours furthest apart."""
    if not len(v):
        return None
    k = int(np.diff(v).argmax()) if len(v) > 1 else 0
    return float(v[0]), float(v[-1]), float(v[k]), float(v[min(k + 1, len(v) - 1)])


def _widest(parts: list[tuple[float, float, float, float] | None]) -> tuple[float, float] | None:
    """The widest gap within parts in order, or from one to the next; None where there are no two different values."""
    parts = [p for p in parts if p]
    every = [p[2:] for p in parts] + [(a[1], b[0]) for a, b in zip(parts, parts[1:], strict=False)]
    best = max(every, key=lambda g: (g[1] - g[0], -g[0]), default=(0.0, 0.0))
    return best if best[1] > best[0] else None


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles."""
    u = (v + 0.0).view(np.uint64)  # no zero below zero
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def order_statistics(source: Held | Stored, values: Values, ranks: np.ndarray) -> np.ndarray:
    """Of each column of values the ones of these ranks (0: the smallest), exactly: a row for each column, as `ranks` has."""
    left, prefix, done = np.array(ranks, np.int64), np.zeros(np.shape(ranks), np.uint64), 0
    for digit in DIGITS:
        targets = sorted({(c, int(p)) for c, row in enumerate(prefix) for p in row})
        rest = np.uint64(64 - done - digit)

        def count(out, x, y, whole, targets=targets, done=done, digit=digit, rest=rest):
            keys = np.ascontiguousarray(_ordered(values(x, y, whole)).T)
            for t, (c, p) in enumerate(targets):
                k = keys[c] if not done else keys[c][keys[c] >> np.uint64(64 - done) == np.uint64(p)]
                if len(k):
                    found = (k >> rest & np.uint64((1 << digit) - 1)).astype(np.int64)
                    np.add.at(out, found + (t << digit), 1.0)

        counts, settled = source.total(count, len(targets) << digit, grouped=True).reshape(len(targets), -1), prefix.copy()
        for t, (c, p) in enumerate(targets):
            upto = np.cumsum(counts[t])
            for r in np.flatnonzero(prefix[c] == np.uint64(p)):
                d = int(np.searchsorted(upto, left[c, r], side="right"))
                left[c, r] -= int(upto[d - 1]) if d else 0
                settled[c, r] = (p << digit) | d
        prefix, done = settled, done + digit
    u = np.where(prefix >> np.uint64(63), prefix & np.uint64((1 << 63) - 1), ~prefix)
    return u.view(np.float64)


def quantiles(source: Held | Stored, values: Values, n: int, q: list[float]) -> np.ndarray:
    """Of n values in one column, as np.quantile gives them."""
    at = np.array(q) * (n - 1)
    low = np.floor(at).astype(np.int64)
    got = order_statistics(source, values, np.concatenate([low, np.minimum(low + 1, n - 1)])[None])[0]
    a, b = got[: len(q)], got[len(q) :]
    return a + (b - a) * (at - low)


class Scores:
    """All pairs at given weights: counts of good and bad rows' scores, and from these the mean loss of pairs."""

    def __init__(self, source: Held | Stored, standard: Callable[[np.ndarray], np.ndarray], w: np.ndarray, bound: float):
        self.source, self.standard, self.w = source, standard, w
        reach = int(np.ceil(bound * np.abs(w).sum() / STEP)) + 2  # no score is beyond
        size = 2 * reach + 1

        def count(out, x, y, whole):
            u = standard(x) @ w / STEP
            k = np.floor(u).astype(np.int64)
            at = k + reach + size * (y == 1)
            np.add.at(out, at, 1 - (u - k))
            np.add.at(out, at + 1, u - k)

        counts = source.total(count, 2 * size).reshape(2, size)
        used = np.flatnonzero(counts.any(axis=0))
        self.first = int(used[0]) - reach
        counts = counts[:, used[0] : used[-1] + 1]
        self.n = np.rint(counts.sum(axis=1))
        bad, good = counts / self.n[:, None]
        apart = np.arange(1 - len(bad), len(bad)) * STEP
        share = 1 / (1 + np.exp(np.clip(apart, -700, 700)))  # of a pair that the good row leads by `apart`
        self.loss = float(good @ _along(bad, np.logaddexp(0, -apart)))
        #: By score, for a bad and a good row: the mean share that it has in the slope of its pairs' loss, and their curving.
        self.pull = np.array([_along(good, share[::-1]), -_along(bad, share)])
        self.curve = np.array([_along(other, share * (1 - share)) for other in (good, bad)])

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and second derivatives of the mean of log(1 + exp(-(good - bad) @ w)) over all pairs.

        The latter are nearly right: what two rows of a pair share is taken from sums of rows at every COARSE of score.
        """
        standard, w, n, pull, curve, first, width = self.standard, self.w, self.n, self.pull, self.curve, self.first, len(self.w)
        lowest = int(np.floor(first * STEP / COARSE))
        places = int(np.floor((first + pull.shape[1]) * STEP / COARSE)) - lowest + 2

        def add(out, x, y, whole):
            z = standard(x)
            s = z @ w
            label = (y == 1).astype(np.int64)
            k, by = _between(s / STEP - first, pull.shape[1])
            after = np.minimum(k + 1, pull.shape[1] - 1)
            pulls, curves = (((1 - by) * t[label, k] + by * t[label, after]) / n[label] for t in (pull, curve))
            k, by = _between(s / COARSE - lowest, places)
            shared, rows = np.zeros((2 * places, len(s))), np.arange(len(s))
            shared[k + places * label, rows] = (1 - by) / n[label]
            shared[k + 1 + places * label, rows] = by / n[label]
            out[:width] += pulls @ z
            out[width : width * (width + 1)] += ((z * curves[:, None]).T @ z).ravel()
            out[width * (width + 1) :] += (shared @ z).ravel()

        got = self.source.total(add, width * (1 + width + 2 * places), grouped=True).reshape(-1, width)
        bad, good = got[1 + width : 1 + width + places], got[1 + width + places :]
        share = 1 / (1 + np.exp(np.clip(np.subtract.outer(np.arange(places), np.arange(places)) * COARSE, -700, 700)))
        cross = good.T @ (share * (1 - share)) @ bad
        return got[0], got[1 : 1 + width] - cross - cross.T


def _between(u: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the place before it, and how far it is from there to the next."""
    k = np.clip(np.floor(u).astype(np.int64), 0, max(0, places - 2))
    return k, u - k


def _along(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each place i the sum over j of counts[j] times the kernel's value for i - j."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]


def descend(source: Held | Stored, standard: Callable[[np.ndarray], np.ndarray], width: int, decay: float, bound: float, enough: float = 1e-10) -> np.ndarray:
    """The weights of least loss over all pairs plus decay / 2 times their square, by Newton's method.

    It ends when the loss can't fall by more than `enough`.  `bound` is the most that `standard` gives.
    """
    at = Scores(source, standard, np.zeros(width), bound)
    while True:
        w, loss = at.w, at.loss + decay / 2 * (at.w @ at.w)
        gradient, second = at.slopes()
        gradient = gradient + decay * w
        curves, axes = np.linalg.eigh(second)
        way = axes @ ((gradient @ axes) / (np.maximum(curves, 0) + decay))
        falls, length = gradient @ way, 1.0
        while falls * length > enough:
            at = Scores(source, standard, w - length * way, bound)
            if at.loss + decay / 2 * (at.w @ at.w) <= loss - 1e-4 * length * falls:
                break
            length /= 2
        else:
            return w
