"""Figures of a run: one aggregation whose size depends on adapters and read lengths, not on the number of reads.

Each result row becomes a few keyed counts (an array that is exploded); they are
summed before and after one shuffle.  ``Statistics`` holds the collected table.

Kinds of counts: ``fate`` (of reads or pairs; null: written), ``bp_in``,
``bp_out``, ``quality``, ``with_adapters``, ``rc``, ``poly_a`` (a: length),
``length`` (a: length of a written read), ``match`` (a: adapter, b: 0 for a
5' end or 1, c: removed length, d: errors, s: base before a 3' match) and
``adapter_rc`` (a: adapter).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import piece
from ..plans.trim import TrimSpec, filter_tests

_TYPE = "array<struct<kind:string,read:int,a:int,b:int,c:int,d:int,s:string,n:bigint>>"
KEYS = ["kind", "read", "a", "b", "c", "d", "s"]


def _row(kind: str, read: int, weight: Column | int = 1, a=None, b=None, c=None, d=None, s=None) -> Column:
    num = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    text = s if isinstance(s, Column) else F.lit(s)
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.struct(F.lit(kind).alias("kind"), F.lit(read).alias("read"), num(a).alias("a"), num(b).alias("b"), num(c).alias("c"), num(d).alias("d"), text.cast("string").alias("s"), weight.cast("long").alias("n"))


def _match(read: int, searched: Column):
    def row(x: Column) -> Column:
        removed = F.when(x["side"] == 0, x["rstop"]).otherwise(x["size"] - x["rstart"])
        base = F.when((x["side"] == 1) & (x["rstart"] > 0), piece(searched, x["offset"] + x["rstart"] - 1, x["offset"] + x["rstart"]))
        base = F.when(base.isin("A", "C", "G", "T"), base).otherwise(F.when(x["side"] == 1, ""))
        return _row("match", read, a=x["adapter"], b=x["side"], c=removed, d=x["errors"], s=base)

    return row


def _on_reverse(read: int, m: Column, rc: Column) -> Column:
    """A row for each match, whatever its number of parts, of a read that was turned."""
    first = F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["turn"] != x["turn"]))
    return F.when(rc, F.transform(first, lambda x: _row("adapter_rc", read, a=x["adapter"]))).otherwise(F.array().cast(_TYPE))


def counts(result: DataFrame, spec: TrimSpec) -> DataFrame:
    """kind, read, a, b, c, d, s, n."""
    out = F.col("fate").isNull()
    rows, more = [_row("fate", 0, s=F.col("fate"))], []
    for k, (p, side) in enumerate(spec.sides):
        size = F.length(f"{p}sequence")
        m = F.col(f"{p}matches")
        rows += [_row("bp_in", k, F.length(F.col(f"{p}original")["sequence"])), F.when(out, _row("bp_out", k, size)), F.when(out, _row("length", k, a=size))]
        rows.append(F.when(F.col(f"{p}quality_trimmed") > 0, _row("quality", k, F.col(f"{p}quality_trimmed"))))
        if spec.poly_a:
            rows.append(_row("poly_a", k, a=F.col(f"{p}poly_a_trimmed")))
        if side.adapters:
            rows.append(F.when(F.size(m) > 0, _row("with_adapters", k)))
            more += [F.transform(m, _match(k, F.col(f"{p}searched"))), _on_reverse(k, m, F.coalesce(F.col(f"{p}is_rc"), F.lit(False)))]
    if spec.both_strands:
        p = spec.sides[0][0]
        rows.append(F.when(F.coalesce(F.col(f"{p}is_rc"), F.lit(False)), _row("rc", 0)))
    each = F.flatten(F.array(F.filter(F.array(*rows), lambda x: x.isNotNull()), *more)) if more else F.filter(F.array(*rows), lambda x: x.isNotNull())
    return result.select(F.explode(each).alias("x")).select("x.*").groupBy(*KEYS).agg(F.sum("n").alias("n"))


@dataclass
class EndCounts:
    """Matches at one end of an adapter: removed length and errors, and bases before them."""

    errors: dict[int, Counter] = field(default_factory=lambda: defaultdict(Counter))
    bases: Counter = field(default_factory=Counter)

    @property
    def total(self) -> int:
        return sum(c.total() for c in self.errors.values())


class Statistics:
    def __init__(self, rows: list[tuple], spec: TrimSpec, has_qualities: bool = True):
        self.spec, self.paired = spec, spec.second is not None
        self.sides = [s for _, s in spec.sides]
        sums: dict[tuple[str, int], int] = defaultdict(int)
        self.fates: Counter = Counter()
        self.lengths: list[Counter] = [Counter(), Counter()]
        self.poly_a: list[Counter] = [Counter(), Counter()]
        self.ends: dict[tuple[int, int, int], EndCounts] = defaultdict(EndCounts)
        self.adapter_rc: Counter = Counter()
        for kind, read, a, b, c, d, s, n in rows:
            sums[kind, read] += n
            if kind == "fate":
                self.fates[s] += n
            elif kind == "length":
                self.lengths[read][a] += n
            elif kind == "poly_a":
                self.poly_a[read][a] += n
            elif kind == "adapter_rc":
                self.adapter_rc[read, a] += n
            elif kind == "match":
                end = self.ends[read, a, b]
                end.errors[c][d] += n
                if s is not None:
                    end.bases[s] += n
        both = range(len(self.sides))
        self.n = self.fates.total()
        self.written = self.fates[None]
        #: every filter that is in use, with 0 where it rejected nothing
        self.filtered = {name: self.fates[name] for name, _ in filter_tests(spec, has_qualities)}
        self.bp_in = [sums["bp_in", k] for k in both]
        self.bp_out = [sums["bp_out", k] for k in both]
        trims = [spec.nextseq is not None or s.quality is not None for s in self.sides]
        self.quality_trimmed = [sums["quality", k] if trims[k] else None for k in both]
        self.poly_a_bp = [sum(x * n for x, n in self.poly_a[k].items()) if spec.poly_a else None for k in both]
        self.with_adapters = [sums["with_adapters", k] if self.sides[k].adapters else None for k in both]
        self.reverse_complemented = sums["rc", 0] if spec.both_strands and any(s.adapters for s in self.sides) else None


def collect(result: DataFrame, spec: TrimSpec, has_qualities: bool = True) -> Statistics:
    return Statistics([tuple(r) for r in counts(result, spec).collect()], spec, has_qualities)
