"""What depends on every base of a read, by running sums over a batch of reads.

All characters of a batch lie side by side in one array; sums run over the
whole array and are taken back to each read's own start, so the work is linear
in the bases whatever the reads' lengths are.  Nulls give nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_FAR = np.iinfo(np.int64).max


class Flat:
    """The characters of texts, and where each text that isn't empty starts."""

    def __init__(self, texts: pa.Array, reverse: bool = False):
        self.valid = texts.is_valid().to_numpy(zero_copy_only=False)
        some = pc.fill_null(texts, "")
        sizes = pc.utf8_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = "".join(some.to_pylist())
        code = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.sizes, self.code = sizes, code.astype(np.int64)
        self.rows = np.flatnonzero(sizes)
        if reverse:
            self.rows, self.code = self.rows[::-1], self.code[::-1]
        self.n = sizes[self.rows]
        self.starts = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.code)) - np.repeat(self.starts, self.n)

    def sums(self, d: np.ndarray) -> np.ndarray:
        """Running sums of ``d`` within each text."""
        total = np.cumsum(d)
        return total - np.repeat(total[self.starts] - d[self.starts], self.n)

    def first(self, where: np.ndarray) -> np.ndarray:
        """For each text the first place that fulfils ``where``."""
        return np.minimum.reduceat(np.where(where, self.place, _FAR), self.starts)

    def peak(self, s: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """For every text the first of the allowed places at which ``s`` is largest and above 0; -1: none."""
        out = np.full(len(self.sizes), -1, np.int64)
        if len(self.rows):
            top = np.maximum.reduceat(np.where(allowed, s, 0), self.starts)
            at = self.first(allowed & (s > 0) & (s == np.repeat(top, self.n)))
            out[self.rows] = np.where(at == _FAR, -1, at)
        return out

    def column(self, values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int32(), mask=~self.valid)


def _until_below_zero(flat: Flat, d: np.ndarray) -> np.ndarray:
    if not len(flat.rows):
        return flat.peak(d, d > 0)
    s = flat.sums(d)
    return flat.peak(s, flat.place < np.repeat(flat.first(s < 0), flat.n))


def quality_start(qual: Column, cutoff: int, base: int = 33) -> Column:
    """Behind the place up to which the sum of cutoff - quality is largest, summed from the 5' end until it falls below 0."""

    @F.arrow_udf("int")
    def start(q: pa.Array) -> pa.Array:
        flat = Flat(q)
        return flat.column(_until_below_zero(flat, cutoff + base - flat.code) + 1)

    return start(qual)


def quality_stop(qual: Column, cutoff: int, base: int = 33) -> Column:
    """As ``quality_start``, from the 3' end."""

    @F.arrow_udf("int")
    def stop(q: pa.Array) -> pa.Array:
        flat = Flat(q, reverse=True)
        return flat.column(flat.sizes - 1 - _until_below_zero(flat, cutoff + base - flat.code))

    return stop(qual)


def nextseq_stop(seq: Column, qual: Column, cutoff: int, base: int = 33) -> Column:
    """As ``quality_stop``, with every upper-case G just below the cutoff."""

    @F.arrow_udf("int")
    def stop(s: pa.Array, q: pa.Array) -> pa.Array:
        flat = Flat(q, reverse=True)
        # a read without qualities has none to go by
        bases = Flat(pc.if_else(q.is_valid(), s, pa.scalar(None, s.type)), reverse=True).code
        d = np.where(bases == ord("G"), 1, cutoff + base - flat.code)
        return flat.column(flat.sizes - 1 - _until_below_zero(flat, d))

    return stop(seq, qual)


def _tail(flat: Flat, letter: str) -> np.ndarray:
    """Length of a run of mostly ``letter``: +1 for it and -2 for others, at most a fifth of others, three places at least."""
    hit = flat.code == ord(letter)
    if not len(flat.rows):
        return np.zeros(len(flat.sizes), np.int64)
    size = flat.peak(flat.sums(np.where(hit, 1, -2)), flat.sums((~hit).astype(np.int64)) * 5 <= flat.place + 1) + 1
    return np.where(size < 3, 0, size)


def _tail_column(seq: Column, letter: str, last_first: bool) -> Column:
    @F.arrow_udf("int")
    def at(s: pa.Array) -> pa.Array:
        flat = Flat(s, reverse=last_first)
        size = _tail(flat, letter)
        return flat.column(flat.sizes - size if last_first else size)

    return at(seq)


def poly_a_start(seq: Column) -> Column:
    return _tail_column(seq, "A", True)


def poly_t_stop(seq: Column) -> Column:
    return _tail_column(seq, "T", False)


#: Chance of an error by quality.
CHANCES = np.array([10.0 ** (-q / 10) for q in range(94)])


def _expected_errors(q: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes; NaN for a null or a quality that isn't one."""
    flat = Flat(q)
    quality = flat.code - 33
    odd = (quality < 0) | (quality > 93)
    p = np.where(odd, np.nan, CHANCES[np.where(odd, 0, quality)])
    row = np.repeat(flat.rows, flat.n)
    whole = np.repeat(flat.n - flat.n % 4, flat.n)
    inner = flat.place < whole
    # bincount adds in order: four interleaved sums over whole groups of four
    lanes = np.bincount(row[inner] * 4 + flat.place[inner] % 4, p[inner], 4 * len(flat.sizes)).astype(float).reshape(-1, 4)
    total = lanes[:, 0] + lanes[:, 1] + lanes[:, 2] + lanes[:, 3]
    for k in range(3):  # then the rest
        left = ~inner & (flat.place - whole == k)
        total[row[left]] += p[left]
    total[~flat.valid] = np.nan
    return total, flat.sizes


def _tested(qual: Column, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    @F.arrow_udf("boolean")
    def fails(q: pa.Array) -> pa.Array:
        total, sizes = _expected_errors(q)
        return pa.array(test(total, sizes), pa.bool_(), mask=np.isnan(total))

    return fails(qual)


def expected_errors(qual: Column) -> Column:
    """Sum of 10 ** (-q / 10)."""

    @F.arrow_udf("double")
    def total(q: pa.Array) -> pa.Array:
        got = _expected_errors(q)[0]
        return pa.array(got, pa.float64(), mask=np.isnan(got))

    return total(qual)


def too_many_expected_errors(qual: Column, limit: float) -> Column:
    return _tested(qual, lambda total, sizes: total > limit)


def too_high_average_error(qual: Column, rate: float) -> Column:
    """An empty read passes."""
    return F.coalesce(_tested(qual, lambda total, sizes: np.divide(total, sizes, out=np.zeros_like(total), where=sizes > 0) > rate), F.lit(False))
