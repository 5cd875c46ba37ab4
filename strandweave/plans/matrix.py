"""SQL (DuckDB) for error-tolerant matches: the alignment matrix as a recursive query over its columns.

A row holds one column of the matrix for one read.  A cell is one integer, cost
first, then the way by which it was reached, then score and origin, so the least
of three candidates is the one that the rules prefer.
"""

from __future__ import annotations

from ..functions.align import Ends

COST, WAY, SCORE, ZERO = 1 << 20, 1 << 18, 1 << 9, 256
#: A match's fields, as in the array ``matches``.
FIELDS = ("astart", "astop", "rstart", "rstop", "score", "errors")


def _cell(cost: int, score: int, origin: int) -> int:
    return cost * COST + (score + ZERO) * SCORE + origin + ZERO


def _cost(v: str) -> str:
    return f"({v} >> 20)"


def _score(v: str) -> str:
    return f"((({v} >> 9) & 511) - {ZERO})"


def _origin(v: str) -> str:
    return f"(({v} & 511) - {ZERO})"


def _offer(v: str, i: int, compare: str, end: str, rate: float, least: int, m: int, when: str) -> str:
    """The best cell so far, or the cell ``v`` of row i if it is better: a struct (cost, score, origin, stop, rstop)."""
    length = f"({i} + least({_origin(v)}, 0))"
    allowed = f"{when} and {length} >= {least} and {_cost(v)} <= {length} * cast({rate} as double)"
    near = f"({compare} <= best.origin + {m // 2} or {length} > best.stop + least(best.origin, 0))"
    new = f"{{'cost': cast({_cost(v)} as int), 'score': cast({_score(v)} as int), 'origin': cast({_origin(v)} as int), 'stop': {i}, 'rstop': cast({end} as int)}}"
    return f"case when {allowed} and (best is null or {near} and {_score(v)} > best.score) then {new} else best end"


def located(name: str, source: str, pattern: str, rate: float, flags: Ends, min_overlap: int = 3, text: str = "sequence") -> str:
    """CTEs; the last, ``name``, has rid and FIELDS of each match of ``pattern`` in ``text`` of ``source``.

    Both ends of reads are free, so the first column is that before the read and the last its end.
    """
    if not (flags & Ends.READ_START and flags & Ends.READ_STOP):
        raise ValueError("the ends of reads must be free")
    m, k, least = len(pattern), int(rate * len(pattern)), min(min_overlap, len(pattern))
    start_free = bool(flags & Ends.PATTERN_START)
    cells = [f"p{i}" for i in range(m + 1)]
    first = [_cell(0, 0, -i) if start_free else _cell(i, -2 * i, 0) for i in range(m + 1)]
    band = m if start_free else min(m, k + 1)
    none = "cast(null as struct(cost int, score int, origin int, stop int, rstop int))"
    ways = lambda i: (
        f"case when {i} > band then p{i} when substring(seq, t + 1, 1) = '{pattern[i - 1]}' then p{i - 1} + {SCORE} else "
        f"(least(p{i - 1} + {COST - SCORE}, n{i - 1} + {COST + WAY - 2 * SCORE}, p{i} + {COST + 2 * WAY - 2 * SCORE}) & ~{3 * WAY}) end"
    )
    column = f"select *, p0 + 1 as n0 from {name}_r where t < length(seq) and not done"
    for i in range(1, m + 1):  # one level a cell, as a cell needs the one above it
        column = f"select *, {ways(i)} as n{i} from ({column})"
    news = [f"n{i}" for i in range(m + 1)]
    reach = "greatest(0, " + ", ".join(f"case when {i} <= band and {_cost(f'n{i}')} <= {k} then {i} end" for i in range(1, m + 1)) + ")"
    column = f"select *, {reach} as reach, n0 as n from ({column})"
    taken = _offer(f"n{m}", m, _origin(f"n{m}"), "t + 1", rate, least, m, f"reach = {m}")
    column = f"select *, {taken} as taken from ({column})"
    exact = f"reach = {m} and taken is distinct from best and taken.cost = 0 and taken.origin >= 0"
    recursion = (
        f"{name}_r as (select rid, {text} as seq, 0 as t, {', '.join(f'cast({v} as int) as {c}' for v, c in zip(first, cells))}, cast({band} as int) as band, 0 as filled, {none} as best, false as done from {source}"
        f" union all select rid, seq, t + 1, {', '.join(news)}, cast(case when reach = {m} then {m} else reach + 1 end as int), band, taken, coalesce({exact}, false) from ({column}))"
    )
    at_end = "case filled " + " ".join(f"when {i} then {_origin(f'p{i}')}" for i in range(m + 1)) + " end"
    stale = f"case when t = 0 then 0 when done then {_origin(f'p{m}')} else {at_end} end"
    tail = f"select *, {stale} as stale from {name}_r where done or t >= length(seq)"
    for i in range(m, -1 if flags & Ends.PATTERN_STOP else m - 1, -1):
        tail = f"select * replace ({_offer(f'p{i}', i, 'stale', 'length(seq)', rate, least, m, f'filled >= {i}')} as best) from ({tail})"
    fields = {"astart": "greatest(0, -best.origin)", "astop": "best.stop", "rstart": "greatest(0, best.origin)", "rstop": "best.rstop", "score": "best.score", "errors": "best.cost"}
    return f"{recursion}, {name} as (select rid, {', '.join(f'cast({v} as int) as {c}' for c, v in fields.items())} from ({tail}) where best is not null)"


def mirrored(name: str, source: str, pattern: str, rate: float, flags: Ends, min_overlap: int = 3) -> str:
    """As ``located``, for the rightmost match: pattern and reads are turned around."""
    m = len(pattern)
    inner = located(f"{name}_m", source, pattern[::-1], rate, flags, min_overlap, "reverse(sequence)")
    return inner + (
        f", {name} as (select rid, {m} - x.astop as astart, {m} - x.astart as astop, cast(length(r.sequence) as int) - x.rstop as rstart,"
        f" cast(length(r.sequence) as int) - x.rstart as rstop, x.score, x.errors from {name}_m x join {source} r using (rid))"
    )
