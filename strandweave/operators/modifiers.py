"""Steps that change a read, each from DataFrame to DataFrame.

A read's columns are ``name``, ``sequence`` and ``qualities`` with a prefix
(``p``); places are computed in a column of their own, so that both sequence and
qualities are cut at the same ones and no expression is evaluated twice.  Null
qualities (FASTA) stay null, and quality trimming leaves such reads alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, perbase
from ..functions.exprs import piece


def cut_to(df: DataFrame, p: str, start: Column | int, stop: Column | int, count: str | None = None) -> DataFrame:
    """Keeps [start, stop); ``count`` names a column that the number of removed bases is added to."""
    seq, qual = F.col(f"{p}sequence"), F.col(f"{p}qualities")
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    df = df.withColumns({f"{p}_a": lit(start).cast("int"), f"{p}_b": lit(stop).cast("int")})
    new = {f"{p}sequence": piece(seq, F.col(f"{p}_a"), F.col(f"{p}_b")), f"{p}qualities": piece(qual, F.col(f"{p}_a"), F.col(f"{p}_b"))}
    if count:
        new[count] = F.col(count) + F.length(seq) - F.greatest(F.col(f"{p}_b") - F.col(f"{p}_a"), F.lit(0))
    return df.withColumns(new).drop(f"{p}_a", f"{p}_b")


def cut(df: DataFrame, p: str, length: int) -> DataFrame:
    """Removes bases at the 5' end (length above 0) or the 3' end, and remembers them."""
    seq = F.col(f"{p}sequence")
    if length == 0:
        return df
    if length > 0:
        return cut_to(df.withColumn(f"{p}cut_prefix", F.left(seq, F.lit(length))), p, length, F.length(seq))
    at = F.greatest(F.length(seq) + length, F.lit(0))
    return cut_to(df.withColumn(f"{p}cut_suffix", piece(seq, at, F.length(seq))), p, 0, at)


def nextseq_trim(df: DataFrame, p: str, cutoff: int, base: int = 33) -> DataFrame:
    stop = F.coalesce(perbase.nextseq_stop(F.col(f"{p}sequence"), F.col(f"{p}qualities"), cutoff, base), F.length(f"{p}sequence"))
    return cut_to(df, p, 0, stop, f"{p}quality_trimmed")


def quality_trim(df: DataFrame, p: str, front: int, back: int, base: int = 33) -> DataFrame:
    qual, size = F.col(f"{p}qualities"), F.length(f"{p}sequence")
    start = F.coalesce(perbase.quality_start(qual, front, base), F.lit(0)) if front else F.lit(0)
    stop = F.coalesce(perbase.quality_stop(qual, back, base), size) if back else size
    df = df.withColumns({f"{p}_s": start, f"{p}_e": stop})
    empty = F.col(f"{p}_s") >= F.col(f"{p}_e")
    return cut_to(df, p, F.when(empty, 0).otherwise(F.col(f"{p}_s")), F.when(empty, 0).otherwise(F.col(f"{p}_e")), f"{p}quality_trimmed").drop(f"{p}_s", f"{p}_e")


def poly_a_trim(df: DataFrame, p: str, reverse: bool = False) -> DataFrame:
    """Removes a poly-A tail, or with ``reverse`` a poly-T head; ``poly_a_trimmed`` has its length."""
    seq = F.col(f"{p}sequence")
    df = df.withColumn(f"{p}_at", perbase.poly_t_stop(seq) if reverse else perbase.poly_a_start(seq))
    at = F.col(f"{p}_at")
    df = df.withColumn(f"{p}poly_a_trimmed", at if reverse else F.length(seq) - at)
    return (cut_to(df, p, at, F.length(seq)) if reverse else cut_to(df, p, 0, at)).drop(f"{p}_at")


def shorten(df: DataFrame, p: str, length: int) -> DataFrame:
    """Keeps the first bases, or with a length below 0 the last."""
    size = F.length(f"{p}sequence")
    return cut_to(df, p, 0, F.least(size, F.lit(length))) if length >= 0 else cut_to(df, p, F.greatest(size + length, F.lit(0)), size)


def trim_n(df: DataFrame, p: str) -> DataFrame:
    return cut_to(df, p, *exprs.n_ends(F.col(f"{p}sequence")))


def length_tag(df: DataFrame, p: str, tag: str) -> DataFrame:
    return df.withColumn(f"{p}name", exprs.length_tag(F.col(f"{p}name"), tag, F.col(f"{p}sequence")))


def strip_suffix(df: DataFrame, p: str, suffix: str) -> DataFrame:
    return df.withColumn(f"{p}name", exprs.strip_suffix(F.col(f"{p}name"), suffix))


def add_affixes(df: DataFrame, p: str, prefix: str, suffix: str, adapter: Column) -> DataFrame:
    return df.withColumn(f"{p}name", exprs.affixed(F.col(f"{p}name"), prefix, suffix, adapter))


def zero_cap(df: DataFrame, p: str, base: int = 33) -> DataFrame:
    return df.withColumn(f"{p}qualities", exprs.zero_cap(F.col(f"{p}qualities"), base))


def reverse_complement(df: DataFrame, p: str) -> DataFrame:
    return df.withColumns({f"{p}sequence": exprs.reverse_complement(F.col(f"{p}sequence")), f"{p}qualities": F.reverse(f"{p}qualities")})


def values_of(p: str, adapter: Column, text: Column, is_rc: Column) -> dict[str, Column]:
    """What the variables of a name's template stand for."""
    name = F.col(f"{p}name")
    ident, comment = exprs.header_parts(name)
    return {
        "header": name, "id": ident, "comment": comment, "cut_prefix": F.col(f"{p}cut_prefix"), "cut_suffix": F.col(f"{p}cut_suffix"),
        "adapter_name": adapter, "rc": F.when(is_rc, "rc").otherwise(""), "match_sequence": text,
    }


def rename(df: DataFrame, p: str, text: str, values: dict[str, Column]) -> DataFrame:
    return df.withColumn(f"{p}name", exprs.template(text, values))


def rename_pairs(df: DataFrame, p1: str, p2: str, text: str, values1: dict[str, Column], values2: dict[str, Column]) -> DataFrame:
    """One template for both names; ids must agree before and after."""
    from ..sources.fastx import names_match

    qualified = {f"r{k}.{n}": v for k, vals in ((1, values1), (2, values2)) for n, v in vals.items() if n not in ("id", "rc")}
    new = {}
    for k, (p, vals) in enumerate(((p1, values1), (p2, values2)), 1):
        own = {n: v for n, v in vals.items() if n != "rc"}
        new[f"{p}_new"] = exprs.template(text, own | qualified | {"rn": F.lit(str(k))})
    df = df.withColumns(new)
    bad_in = ~names_match(F.col(f"{p1}name"), F.col(f"{p2}name"))
    bad_out = ~names_match(F.col(f"{p1}_new"), F.col(f"{p2}_new"))
    fine = (
        F.when(bad_in, F.raise_error(F.concat(F.lit("input read ids aren't identical: "), f"{p1}name", F.lit(" and "), f"{p2}name")).cast("string"))
        .when(bad_out, F.raise_error(F.concat(F.lit("ids are no longer identical after renaming: "), f"{p1}_new", F.lit(" and "), f"{p2}_new")).cast("string"))
        .otherwise(F.col(f"{p1}_new"))
    )
    return df.withColumns({f"{p1}name": fine, f"{p2}name": F.col(f"{p2}_new")}).drop(f"{p1}_new", f"{p2}_new")
