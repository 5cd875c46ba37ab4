"""The plan of a trimming run: a specification, and the DataFrame that it makes of reads.

Steps follow one fixed order: cut, two-colour and quality trimming, adapters,
poly-A, length, N ends, names, capped qualities, renaming; then one fate for
each read or pair.  The result keeps every input row, with what reports and
side outputs need; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.adapters import Adapter, Linked
from ..operators import fates, matching, modifiers
from ..operators.matching import MATCHES, Cutter


@dataclass
class Side:
    """What is done to one read of a pair, or to single reads."""

    adapters: list[Adapter | Linked] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    #: (5', 3') cutoffs, or None
    quality: tuple[int, int] | None = None
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    poly_t: bool = False

    def __post_init__(self):
        if len(self.cut) > 2:
            raise ValueError("bases can't be removed from more than two ends")
        if len(self.cut) == 2 and self.cut[0] * self.cut[1] > 0:
            raise ValueError("bases can't be removed twice from one end")


@dataclass
class TrimSpec:
    first: Side = field(default_factory=Side)
    #: None for single reads
    second: Side | None = None
    times: int = 1
    action: str = "trim"
    index: bool = True
    both_strands: bool = False
    pair_adapters: bool = False
    nextseq: int | None = None
    quality_base: int = 33
    poly_a: bool = False
    trim_n: bool = False
    length_tag: str | None = None
    strip_suffixes: list[str] = field(default_factory=list)
    prefix: str = ""
    suffix: str = ""
    rename: str | None = None
    zero_cap: bool = False
    max_n: float | None = None
    max_expected_errors: float | None = None
    max_average_error: float | None = None
    discard_casava: bool = False
    #: None, "trimmed" or "untrimmed"
    discard: str | None = None
    #: untrimmed reads go to a sink of their own
    untrimmed_apart: bool = False
    pair_filter: str = "any"
    #: None, "name" (last adapter of the first read) or "both" (of either read)
    demultiplex: str | None = None
    prefilter: bool = True
    #: steps of one's own, after those that change sequences: each takes the table and a side's prefix ("", "r1_", "r2_") and returns the table
    modifiers: list[Callable[[DataFrame, str], DataFrame]] = field(default_factory=list)
    #: filters of one's own, after all others: a fate, and a predicate that takes a side's prefix and returns a condition
    filters: list[tuple[str, Callable[[str], Column]]] = field(default_factory=list)

    def __post_init__(self):
        if taken := {name for name, _ in self.filters} & {*fates.FATES, None}:
            raise ValueError(f"{taken.pop()} is the fate of another filter")
        if self.action not in matching.ACTIONS:
            raise ValueError(f"an action is one of {', '.join(matching.ACTIONS)}")
        if self.discard not in (None, "trimmed", "untrimmed"):
            raise ValueError("discard is None, trimmed or untrimmed")
        if self.discard and self.untrimmed_apart:
            raise ValueError("only one of discarding trimmed or untrimmed reads and a sink for untrimmed ones can be used")
        if self.demultiplex and self.discard == "trimmed":
            raise ValueError("trimmed reads can't be discarded when demultiplexing")
        if self.demultiplex == "both" and (self.pair_adapters or self.untrimmed_apart or not self.second):
            raise ValueError("demultiplexing by both reads needs pairs, without adapters in pairs and without a sink for untrimmed ones")
        if self.pair_adapters and (self.times != 1 or self.both_strands or not self.second):
            raise ValueError("adapters in pairs need paired reads, one round and one strand")
        if self.rename and (self.prefix or self.suffix):
            raise ValueError("renaming can't be combined with a prefix or suffix")
        if self.pair_filter not in fates.PAIR_MODES:
            raise ValueError(f"a pair filter is one of {', '.join(fates.PAIR_MODES)}")

    @property
    def sides(self) -> list[tuple[str, Side]]:
        return [("", self.first)] if self.second is None else [("r1_", self.first), ("r2_", self.second)]

    def cutter(self, side: Side) -> Cutter | None:
        return Cutter(side.adapters, self.times, self.action, self.index and not self.pair_adapters) if side.adapters else None


def _prepared(reads: DataFrame, spec: TrimSpec) -> DataFrame:
    """Columns of all sides with what later steps fill."""
    cols = [F.col("rid")]
    for k, (p, _) in enumerate(spec.sides, 1):
        of = {c: F.col(c if not p else f"{c}{k}") for c in ("name", "sequence", "qualities")}
        cols += [of[c].alias(f"{p}{c}") for c in of]
        cols.append(F.struct(*[of[c].alias(c) for c in of]).alias(f"{p}original"))
        cols += [F.lit(None).cast("string").alias(f"{p}{c}") for c in ("cut_prefix", "cut_suffix")]
        cols += [F.lit(0).alias(f"{p}quality_trimmed"), F.lit(0).alias(f"{p}poly_a_trimmed"), F.lit(None).cast("boolean").alias(f"{p}is_rc"), F.array().cast(MATCHES).alias(f"{p}matches")]
    return reads.select(*cols)


def _adapters(df: DataFrame, spec: TrimSpec) -> DataFrame:
    cutters = [(p, spec.cutter(side)) for p, side in spec.sides]
    suffix = None if spec.rename else " rc"
    if spec.pair_adapters:
        if cutters[0][1] is None or cutters[1][1] is None:
            raise ValueError("adapters in pairs need two lists of one length")
        return matching.search_pairs(df, "r1_", "r2_", cutters[0][1], cutters[1][1], spec.prefilter)
    if spec.both_strands and spec.second is not None and any(c for _, c in cutters):
        return matching.search_swapped(df, "r1_", "r2_", cutters[0][1], cutters[1][1], suffix, spec.prefilter)
    for p, c in cutters:
        if c is None:
            df = df.withColumn(f"{p}searched", F.col(f"{p}sequence"))
        elif spec.both_strands:
            df = matching.search_both_strands(df, p, c, suffix, spec.prefilter)
        else:
            df = matching.search_and_cut(df, p, c, spec.prefilter)
    return df


def _last_name(p: str, side: Side, none: str | None) -> Column:
    return matching.last_name(F.col(f"{p}matches"), [a.name for a in side.adapters], none)


def _names(df: DataFrame, spec: TrimSpec) -> DataFrame:
    sides = spec.sides
    if spec.trim_n:
        for p, _ in sides:
            df = modifiers.trim_n(df, p)
    for p, side in sides:
        if spec.length_tag:
            df = modifiers.length_tag(df, p, spec.length_tag)
        for s in spec.strip_suffixes:
            df = modifiers.strip_suffix(df, p, s)
        if spec.prefix or spec.suffix:
            df = modifiers.add_affixes(df, p, spec.prefix, spec.suffix, _last_name(p, side, "no_adapter"))
        if spec.zero_cap:
            df = modifiers.zero_cap(df, p, spec.quality_base)
    if spec.rename and spec.rename != "{header}":
        values = [
            modifiers.values_of(p, _last_name(p, side, "no_adapter"), matching.match_text(p, [isinstance(a, Linked) for a in side.adapters]), F.col(f"{p}is_rc")) for p, side in sides
        ]
        df = modifiers.rename(df, "", spec.rename, values[0]) if spec.second is None else modifiers.rename_pairs(df, "r1_", "r2_", spec.rename, *values)
    return df


def modified(reads: DataFrame, spec: TrimSpec) -> DataFrame:
    """All steps that change reads."""
    df = _prepared(reads, spec)
    sides = spec.sides
    for p, side in sides:
        for n in side.cut:
            df = modifiers.cut(df, p, n)
    for p, _ in sides:
        if spec.nextseq is not None:
            df = modifiers.nextseq_trim(df, p, spec.nextseq, spec.quality_base)
    for p, side in sides:
        if side.quality is not None:
            df = modifiers.quality_trim(df, p, *side.quality, spec.quality_base)
    df = _adapters(df, spec)
    for k, (p, side) in enumerate(sides):
        if spec.poly_a:
            df = modifiers.poly_a_trim(df, p, reverse=k == 1)
    for p, side in sides:
        if side.length is not None:
            df = modifiers.shorten(df, p, side.length)
    for p, _ in sides:
        for step in spec.modifiers:
            df = step(df, p)
    return _names(df, spec)


def filter_tests(spec: TrimSpec, has_qualities: bool = True) -> list[tuple[str, Column]]:
    """(fate, condition) in order; those on qualities are left out where there are none."""
    prefixes = tuple(p for p, _ in spec.sides)
    mode, out = spec.pair_filter, []

    def add(name: str, test, test2="same", how: str = mode) -> None:
        out.append((name, fates.over_pair(test, test if test2 == "same" else test2, prefixes, how)))

    second = spec.second or spec.first
    for name, make, n1, n2 in (("too_short", fates.too_short, spec.first.min_length, second.min_length), ("too_long", fates.too_long, spec.first.max_length, second.max_length)):
        if n1 is not None or n2 is not None:
            add(name, make(n1), make(n2))
    if spec.max_n is not None:
        add("too_many_n", fates.too_many_n(spec.max_n))
    if spec.max_expected_errors is not None and has_qualities:
        add("too_many_expected_errors", fates.too_many_expected_errors(spec.max_expected_errors))
    if spec.max_average_error is not None and has_qualities:
        add("too_high_average_error_rate", fates.too_high_average_error(spec.max_average_error))
    if spec.discard_casava:
        add("casava_filtered", fates.casava_filtered)
    if spec.demultiplex == "both":
        if spec.discard == "untrimmed":  # only pairs with adapters in both reads have a sink
            out.append(("discard_untrimmed", fates.untrimmed("r1_") | fates.untrimmed("r2_")))
    elif spec.demultiplex == "name":
        if spec.discard == "untrimmed":
            out.append(("discard_untrimmed", fates.untrimmed(prefixes[0])))
    elif spec.discard == "trimmed":
        add("discard_trimmed", fates.trimmed)
    elif spec.discard == "untrimmed" or spec.untrimmed_apart:
        one_sided = spec.second is not None and not (spec.first.adapters and spec.second.adapters)
        add("discard_untrimmed", fates.untrimmed, how="both" if one_sided else mode)
    for name, test in spec.filters:
        add(name, test)
    return out


def demultiplexed(spec: TrimSpec) -> Column:
    """The name that a read's or pair's sink goes by; null without demultiplexing."""
    if spec.demultiplex is None:
        return F.lit(None).cast("string")
    names = [_last_name(p, side, "unknown") for p, side in spec.sides]
    return F.concat(names[0], F.lit("-"), names[1]) if spec.demultiplex == "both" else names[0]


def trim(reads: DataFrame, spec: TrimSpec, has_qualities: bool = True) -> DataFrame:
    """``reads`` (rid, name, sequence, qualities; for pairs name1 ... qualities2) with all steps applied.

    Per read (pairs: with ``r1_`` and ``r2_`` before the names): name, sequence,
    qualities, original, cut_prefix, cut_suffix, quality_trimmed,
    poly_a_trimmed, is_rc, matches, searched; and fate and demux.
    """
    df = modified(reads, spec)
    return df.withColumns({"fate": fates.first_of(filter_tests(spec, has_qualities)), "demux": demultiplexed(spec)})


def written(result: DataFrame) -> DataFrame:
    """Rows that pass all filters."""
    return result.where(F.col("fate").isNull())
