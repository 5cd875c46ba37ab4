"""Adapter search over a column of sequences, and what is done with what was found.

The search is the only part that leaves the JVM: an Arrow UDF that gets the
sequences (null where a prefilter in SQL rules a match out) and returns the
parts of the matches.  Trimming, masking and all else are column expressions
over these.  Columns of a read carry a prefix (``p``), so that the same code
serves single reads and both reads of a pair.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.adapters import Adapter, Linked, Matcher, pair_rounds
from ..functions.exprs import piece, reverse_complement

NAMES = ["turn", "adapter", "part", "side", "astart", "astop", "rstart", "rstop", "score", "errors", "size", "offset"]
PART = "struct<" + ",".join(f"{n}:int" for n in NAMES) + ">"
MATCHES = f"array<{PART}>"
ACTIONS = ("trim", "retain", "mask", "lowercase", "crop", "none")
#: Prefilters of more strings than this aren't written as SQL; the search has them too.
MAX_PARTS = 64


@dataclass(eq=False)
class Cutter:
    """Adapters that are searched in one read of a pair or in single reads."""

    adapters: list[Adapter | Linked]
    times: int = 1
    action: str = "trim"
    index: bool = True
    payload: bytes = field(init=False, repr=False)

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"an action is one of {', '.join(ACTIONS)}")
        if self.action in ("retain", "crop") and self.times > 1:
            raise ValueError(f"action {self.action} can't be used with several rounds")
        if self.action == "crop" and any(isinstance(a, Linked) for a in self.adapters):
            raise ValueError("action crop can't be used with linked adapters")
        self.payload = pickle.dumps((_recipes(self.adapters), self.index))

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.adapters]


def _recipe(a: Adapter) -> dict:
    return {k: getattr(a, k) for k in ("kind", "sequence", "name", "max_errors", "min_overlap", "read_wildcards", "adapter_wildcards", "indels", "force_anywhere")}


def _recipes(adapters: list[Adapter | Linked]) -> list[tuple]:
    """What workers build the adapters from again; their tables stay where they are made."""
    return [(_recipe(a.front), _recipe(a.back), a.front_required, a.back_required, a.name) if isinstance(a, Linked) else (_recipe(a),) for a in adapters]


@lru_cache(maxsize=8)
def _built(payload: bytes) -> tuple[list, bool]:
    recipes, index = pickle.loads(payload)
    return [Adapter(**r[0]) if len(r) == 1 else Linked(Adapter(**r[0]), Adapter(**r[1]), *r[2:]) for r in recipes], index


@lru_cache(maxsize=8)
def _matcher(payload: bytes) -> Matcher:
    return Matcher(*_built(payload))


def _as_arrow(found: list[list[tuple]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.array([p for parts in found for p in parts], np.int32).reshape(-1, len(NAMES))
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(NAMES))], names=NAMES)
    return pa.ListArray.from_arrays(pa.array(ends), rows)


def _search(cutter: Cutter):
    payload, times = cutter.payload, cutter.times

    @F.arrow_udf(MATCHES)
    def search(seq: pa.Array) -> pa.Array:
        reads = seq.to_pylist()
        live = [i for i, r in enumerate(reads) if r is not None]
        found: list[list[tuple]] = [[] for _ in reads]
        if live:
            for i, f in zip(live, _matcher(payload).rounds([reads[i] for i in live], times)):
                found[i] = f
        return _as_arrow(found)

    return search


def prefilter(cutter: Cutter, seq: Column) -> Column | None:
    """A condition that every read with a match fulfils, or None if there is none that is worth it."""
    parts: dict[tuple, None] = {}
    for a in cutter.adapters:
        if isinstance(a, Linked) or a.prefilter.parts is None:
            return None
        parts |= dict.fromkeys(a.prefilter.parts)
    return _holds_one(parts, seq) if parts and len(parts) <= MAX_PARTS else None


def pair_prefilter(cutter1: Cutter, cutter2: Cutter, seq1: Column, seq2: Column) -> Column | None:
    """As ``prefilter``: for the i-th adapters of both, both reads must pass."""
    conditions, size = [], 0
    for adapters in zip(cutter1.adapters, cutter2.adapters):
        known = [(a.prefilter.parts, seq) for a, seq in zip(adapters, (seq1, seq2)) if not isinstance(a, Linked) and a.prefilter.parts]
        size += sum(len(parts) for parts, _ in known)
        if not known or size > MAX_PARTS:
            return None
        conditions.append(reduce(lambda a, b: a & b, [_holds_one(*x) for x in known]))
    return reduce(lambda a, b: a | b, conditions)


def _holds_one(parts, seq: Column) -> Column:
    """Whether one of the parts (text, from, to) is in its place in a sequence."""
    upper = F.upper(seq)
    windows = {None: upper}
    conditions = []
    for text, start, stop in parts:
        if start is None and stop is None:
            where = windows[None]
        elif stop is None:
            where = F.right(upper, F.lit(-start))
        else:
            where = F.left(upper, F.lit(stop))
        conditions.append(F.contains(where, F.lit(text)))
    return reduce(lambda a, b: a | b, conditions)


def found_in(cutter: Cutter, seq: Column, narrow: bool = True) -> Column:
    """Matches in a column of sequences."""
    known = prefilter(cutter, seq) if narrow else None
    return _search(cutter)(seq if known is None else F.when(known, seq))


def found_in_pairs(cutter1: Cutter, cutter2: Cutter, seq1: Column, seq2: Column, narrow: bool = True) -> Column:
    """struct (first, second) of matches of adapters in pairs."""
    payload1, payload2 = cutter1.payload, cutter2.payload
    known = pair_prefilter(cutter1, cutter2, seq1, seq2) if narrow else None
    # the first read is null where no pair of adapters can match
    seen = seq1 if known is None else F.when(known, seq1)

    @F.arrow_udf(f"struct<first:{MATCHES},second:{MATCHES}>")
    def search(a: pa.Array, b: pa.Array) -> pa.Array:
        live = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False))
        both = pair_rounds(_built(payload1)[0], _built(payload2)[0], *[x.take(pa.array(live)).to_pylist() for x in (a, b)])
        out: tuple[list, list] = [[] for _ in a], [[] for _ in a]
        for found, some in zip(out, both):
            for i, f in zip(live, some):
                found[i] = f
        return pa.StructArray.from_arrays([_as_arrow(x) for x in out], names=["first", "second"])

    return search(seen, seq2)


def last(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(-1))


def name_of(part: Column, names: list[str]) -> Column:
    """Name of a part's adapter; null without a part."""
    return F.get(F.array(*[F.lit(n) for n in names]), part["adapter"])


def last_name(matches: Column, names: list[str], none: str | None) -> Column:
    got = name_of(last(matches), names) if names else F.lit(None).cast("string")
    return F.coalesce(got, F.lit(none)) if none is not None else got


def _bounds(m: Column, action: str) -> tuple[Column, Column]:
    """What is left of a read, in its coordinates."""
    end = last(m)
    if action == "crop":
        return end["rstart"], end["rstop"]
    if action == "retain":  # one round; a linked adapter has one or two parts
        first = F.get(m, F.lit(0))
        start = F.when(first["side"] == 0, first["rstart"]).otherwise(0)
        return start, end["offset"] + F.when(end["side"] == 1, end["rstop"]).otherwise(end["size"])
    return end["offset"] + F.when(end["side"] == 0, end["rstop"]).otherwise(0), end["offset"] + F.when(end["side"] == 0, end["size"]).otherwise(end["rstart"])


def apply_action(df: DataFrame, p: str, action: str) -> DataFrame:
    """Changes ``sequence`` and ``qualities`` by ``matches``; ``searched`` keeps the sequence as it was searched."""
    m, seq, qual = F.col(f"{p}matches"), F.col(f"{p}sequence"), F.col(f"{p}qualities")
    df = df.withColumn(f"{p}searched", F.upper(seq) if action == "lowercase" else seq)
    if action == "none":
        return df
    start, stop = _bounds(m, action)
    hit = F.size(m) > 0
    df = df.withColumns({f"{p}_a": F.when(hit, start).otherwise(0), f"{p}_b": F.when(hit, stop).otherwise(F.length(seq))})
    a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
    inner = piece(seq, a, b)
    if action == "mask":
        df = df.withColumn(f"{p}sequence", F.when(hit, F.concat(F.repeat(F.lit("N"), a), inner, F.repeat(F.lit("N"), F.length(seq) - b))).otherwise(seq))
    elif action == "lowercase":
        whole = F.concat(F.lower(piece(seq, 0, a)), F.upper(inner), F.lower(piece(seq, b, F.length(seq))))
        df = df.withColumn(f"{p}sequence", F.when(hit, whole).otherwise(F.upper(seq)))
    else:
        df = df.withColumns({f"{p}sequence": inner, f"{p}qualities": piece(qual, a, b)})
    return df.drop(f"{p}_a", f"{p}_b")


def _score(m: Column) -> Column:
    return F.aggregate(m, F.lit(0), lambda s, x: s + x["score"])


def search_and_cut(df: DataFrame, p: str, cutter: Cutter, narrow: bool = True) -> DataFrame:
    return apply_action(df.withColumn(f"{p}matches", found_in(cutter, F.col(f"{p}sequence"), narrow)), p, cutter.action)


def search_both_strands(df: DataFrame, p: str, cutter: Cutter, suffix: str | None = " rc", narrow: bool = True) -> DataFrame:
    """Searches the read and its reverse complement and goes on with that of the higher score, the read if equal."""
    seq, qual, name = (F.col(f"{p}{c}") for c in ("sequence", "qualities", "name"))
    df = df.withColumns({f"{p}_fw": found_in(cutter, seq, narrow), f"{p}_rv": found_in(cutter, reverse_complement(seq), narrow)})
    df = df.withColumn(f"{p}is_rc", _score(F.col(f"{p}_rv")) > _score(F.col(f"{p}_fw")))
    rc = F.col(f"{p}is_rc")
    df = df.withColumns(
        {
            f"{p}matches": F.when(rc, F.col(f"{p}_rv")).otherwise(F.col(f"{p}_fw")),
            f"{p}sequence": F.when(rc, reverse_complement(seq)).otherwise(seq),
            f"{p}qualities": F.when(rc, F.reverse(qual)).otherwise(qual),
            f"{p}name": F.when(rc, F.concat(name, F.lit(suffix or ""))).otherwise(name),
        }
    ).drop(f"{p}_fw", f"{p}_rv")
    return apply_action(df, p, cutter.action)


def search_pairs(df: DataFrame, p1: str, p2: str, cutter1: Cutter, cutter2: Cutter, narrow: bool = True) -> DataFrame:
    """The i-th adapters of both lists must match both reads of a pair."""
    if len(cutter1.adapters) != len(cutter2.adapters):
        raise ValueError("adapters in pairs need two lists of one length")
    if not cutter1.adapters:
        raise ValueError("no adapters were given")
    action = "trim" if cutter1.action == "crop" else cutter1.action
    df = df.withColumn("_both", found_in_pairs(cutter1, cutter2, F.col(f"{p1}sequence"), F.col(f"{p2}sequence"), narrow))
    df = df.withColumns({f"{p1}matches": F.col("_both.first"), f"{p2}matches": F.col("_both.second")}).drop("_both")
    for p in (p1, p2):
        # without a match of the pair nothing is done, not even turned to upper case
        before = F.col(f"{p}sequence")
        df = apply_action(df.withColumn(f"{p}_was", before), p, action)
        if action == "lowercase":
            df = df.withColumn(f"{p}sequence", F.when(F.size(f"{p}matches") > 0, F.col(f"{p}sequence")).otherwise(F.col(f"{p}_was")))
        df = df.drop(f"{p}_was")
    return df


def search_swapped(df: DataFrame, p1: str, p2: str, cutter1: Cutter | None, cutter2: Cutter | None, suffix: str | None = " rc", narrow: bool = True) -> DataFrame:
    """Searches a pair as it is and with its reads exchanged, and goes on with that of the higher score, as it is if equal."""
    none = F.array().cast(MATCHES)
    for p, q, c in ((p1, p2, cutter1), (p2, p1, cutter2)):
        df = df.withColumns({f"{p}_fw": found_in(c, F.col(f"{p}sequence"), narrow) if c else none, f"{p}_sw": found_in(c, F.col(f"{q}sequence"), narrow) if c else none})
    total = lambda s: _score(F.col(f"{p1}{s}")) + _score(F.col(f"{p2}{s}"))
    df = df.withColumn("_swap", total("_sw") > total("_fw"))
    swap, new = F.col("_swap"), {}
    for p, q in ((p1, p2), (p2, p1)):
        new |= {f"{p}{c}": F.when(swap, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}")) for c in ("sequence", "qualities")}
        new |= {
            f"{p}name": F.when(swap, F.concat(F.col(f"{q}name"), F.lit(suffix or ""))).otherwise(F.col(f"{p}name")),
            f"{p}matches": F.when(swap, F.col(f"{p}_sw")).otherwise(F.col(f"{p}_fw")),
            f"{p}is_rc": swap,
        }
    df = df.withColumns(new).drop("_swap", *[f"{p}{s}" for p in (p1, p2) for s in ("_fw", "_sw")])
    for p, c in ((p1, cutter1), (p2, cutter2)):
        df = apply_action(df, p, c.action if c else "none")
    return df


def match_text(p: str, linked: list[bool]) -> Column:
    """The part of the read that the last match covers; of a linked adapter both parts with a comma between."""
    m, searched = F.col(f"{p}matches"), F.col(f"{p}searched")
    text = lambda x: piece(searched, x["offset"] + x["rstart"], x["offset"] + x["rstop"])
    end = last(m)
    single = F.coalesce(text(end), F.lit(""))
    if not any(linked):
        return single
    of = lambda part: F.coalesce(F.get(F.transform(F.filter(m, lambda x: (x["turn"] == end["turn"]) & (x["part"] == part)), text), F.lit(0)), F.lit(""))
    both = F.concat(of(0), F.lit(","), of(1))
    return F.when(F.coalesce(F.get(F.array(*[F.lit(x) for x in linked]), end["adapter"]), F.lit(False)), both).otherwise(single)


def rest_text(p: str) -> Column:
    """What lies before a 5' or behind a 3' adapter of the last round; null without a match."""
    end, searched = last(F.col(f"{p}matches")), F.col(f"{p}searched")
    before = piece(searched, end["offset"], end["offset"] + end["rstart"])
    return F.when(end["side"] == 0, before).otherwise(piece(searched, end["offset"] + end["rstop"], end["offset"] + end["size"]))


def wildcard_text(p: str, cutter: Cutter) -> Column:
    """The characters that the Ns of the last match's adapter stand for; null without a match. Not exact with indels."""
    places = [[i for i, c in enumerate(a.sequence) if c == "N"] for a in cutter.adapters]
    table = F.array(*[F.array(*[F.lit(i) for i in x]).cast("array<int>") for x in places])
    end, searched = last(F.col(f"{p}matches")), F.col(f"{p}searched")
    at = F.filter(F.get(table, end["adapter"]), lambda i: (i >= end["astart"]) & (i < end["astop"]) & (end["rstart"] + i - end["astart"] < end["size"]))
    return F.array_join(F.transform(at, lambda i: F.substring(searched, end["offset"] + end["rstart"] + i - end["astart"] + 1, F.lit(1))), "")
