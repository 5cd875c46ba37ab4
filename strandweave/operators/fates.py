"""Filters: one ``fate`` a read or pair, that of the first filter which rejects it, or null if it is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import exprs, perbase

#: Filters in their order, as they are named in reports.
FATES = ("too_short", "too_long", "too_many_n", "too_many_expected_errors", "too_high_average_error_rate", "casava_filtered", "discard_trimmed", "discard_untrimmed")
PAIR_MODES = ("any", "both", "first")


def trimmed(p: str) -> Column:
    return F.size(f"{p}matches") > 0


def over_pair(test: Callable[[str], Column] | None, test2: Callable[[str], Column] | None, prefixes: tuple[str, ...], mode: str) -> Column:
    """A test on single reads, or on pairs in which any, both or the first read fail; a side without a test doesn't count."""
    if len(prefixes) == 1:
        return test(prefixes[0])
    if mode not in PAIR_MODES:
        raise ValueError(f"a pair filter is one of {', '.join(PAIR_MODES)}")
    if test2 is None:
        return test(prefixes[0])
    if test is None:
        return test2(prefixes[1])
    one, two = test(prefixes[0]), test2(prefixes[1])
    return one if mode == "first" else one & two if mode == "both" else one | two


def too_short(n: int | None):
    return None if n is None else lambda p: exprs.too_short(F.col(f"{p}sequence"), n)


def too_long(n: int | None):
    return None if n is None else lambda p: exprs.too_long(F.col(f"{p}sequence"), n)


def too_many_n(limit: float):
    return lambda p: exprs.too_many_n(F.col(f"{p}sequence"), limit)


def too_many_expected_errors(limit: float):
    return lambda p: F.coalesce(perbase.too_many_expected_errors(F.col(f"{p}qualities"), limit), F.lit(False))


def too_high_average_error(rate: float):
    if not 0 < rate < 1:
        raise ValueError("an average error rate lies between 0 and 1")
    return lambda p: perbase.too_high_average_error(F.col(f"{p}qualities"), rate)


def casava_filtered(p: str) -> Column:
    return exprs.casava_filtered(F.col(f"{p}name"))


def untrimmed(p: str) -> Column:
    return ~trimmed(p)


def first_of(tests: list[tuple[str, Column]]) -> Column:
    out = None
    for name, test in tests:
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(None).cast("string") if out is None else out
