"""The functions of ``perbase`` as built-in column expressions, which are quadratic in a read's length: twins for tests."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ints(n: Column, last_first: bool) -> Column:
    """Places 0 .. n - 1, or none."""
    up = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.reverse(up) if last_first else up).otherwise(F.array().cast("array<int>"))


def _best_prefix(steps: Column, none: Column, bonus: bool = False) -> Column:
    """``at`` of the first step at which the running sum of ``d`` is largest and above 0.

    Walks structs (at, d[, ok]); stops where the sum falls below 0, or, with
    ``bonus``, never stops but takes only steps that are ``ok``.
    """
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("top"), none.cast("int").alias("at"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"] + x["d"]
        up = (s > a["top"]) & x["ok"] if bonus else s > a["top"]
        new = F.struct(s.alias("s"), F.when(up, s).otherwise(a["top"]).alias("top"), F.when(up, x["at"]).otherwise(a["at"]).alias("at"), (F.lit(False) if bonus else s < 0).alias("over"))
        return F.when(a["over"], a).otherwise(new)

    return F.aggregate(steps, start, step, lambda a: a["at"])


def _quality_steps(qual: Column, cutoff: int, base: int, last_first: bool, seq: Column | None = None) -> Column:
    def one(i: Column) -> Column:
        d = F.lit(cutoff + base) - F.ascii(F.substring(qual, i + 1, F.lit(1)))
        if seq is not None:
            d = F.when(F.substring(seq, i + 1, F.lit(1)) == "G", F.lit(1)).otherwise(d)
        return F.struct((i if last_first else i + 1).alias("at"), d.cast("int").alias("d"))

    return F.transform(_ints(F.length(qual), last_first), one)


def quality_stop(qual: Column, cutoff: int, base: int = 33) -> Column:
    return _best_prefix(_quality_steps(qual, cutoff, base, True), F.length(qual))


def quality_start(qual: Column, cutoff: int, base: int = 33) -> Column:
    return _best_prefix(_quality_steps(qual, cutoff, base, False), F.lit(0))


def nextseq_stop(seq: Column, qual: Column, cutoff: int, base: int = 33) -> Column:
    """As quality_stop, with every upper-case G just below the cutoff."""
    return _best_prefix(_quality_steps(qual, cutoff, base, True, seq), F.length(qual))


def _tail_index(seq: Column, letter: str, last_first: bool) -> Column:
    """Where a run of mostly ``letter`` ends: +1 for it and -2 for others, at most a fifth of others, three places at least."""
    n = F.length(seq)
    steps = F.transform(_ints(n, last_first), lambda i: F.struct(i.alias("at"), (F.substring(seq, i + 1, F.lit(1)) == letter).alias("hit")))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("top"), F.lit(0).alias("len"), F.lit(0).alias("bad"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        s, bad, k = a["s"] + F.when(x["hit"], 1).otherwise(-2), a["bad"] + F.when(x["hit"], 0).otherwise(1), a["n"] + 1
        up = (s > a["top"]) & (bad * 5 <= k)
        return F.struct(s.alias("s"), F.when(up, s).otherwise(a["top"]).alias("top"), F.when(up, k).otherwise(a["len"]).alias("len"), bad.alias("bad"), k.alias("n"))

    size = F.aggregate(steps, start, step, lambda a: F.when(a["len"] < 3, 0).otherwise(a["len"]))
    return n - size if last_first else size


def poly_a_start(seq: Column) -> Column:
    return _tail_index(seq, "A", True)


def poly_t_stop(seq: Column) -> Column:
    return _tail_index(seq, "T", False)


def expected_errors(qual: Column) -> Column:
    """Sum of 10 ** (-q / 10), in four interleaved sums over whole groups of four, then the rest."""
    table = F.array(*[F.lit(10.0 ** (-q / 10)) for q in range(94)])
    p = F.transform(_ints(F.length(qual), False), lambda i: F.get(table, F.ascii(F.substring(qual, i + 1, F.lit(1))) - 33))
    whole = F.length(qual) - F.pmod(F.length(qual), F.lit(4))
    zero = F.lit(0.0)

    def lane(k: int) -> Column:
        return F.aggregate(F.filter(p, lambda x, i: (F.pmod(i, F.lit(4)) == k) & (i < whole)), zero, lambda a, x: a + x)

    four = lane(0) + lane(1) + lane(2) + lane(3)
    return F.aggregate(F.filter(p, lambda x, i: i >= whole), four, lambda a, x: a + x)


def too_many_expected_errors(qual: Column, limit: float) -> Column:
    return expected_errors(qual) > limit


def too_high_average_error(qual: Column, rate: float) -> Column:
    return F.coalesce(expected_errors(qual) / F.nullif(F.length(qual), F.lit(0)) > rate, F.lit(False))
