"""Read modifiers and filters as column expressions.

Places in reads count from 0 and intervals are half-open; ``piece`` is the only
place where this meets SQL's counting from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM, _TO = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def piece(text: Column, start: Column | int, stop: Column | int) -> Column:
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.substring(text, start.cast("int") + 1, F.greatest(stop.cast("int") - start.cast("int"), F.lit(0)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _FROM, _TO))


def n_ends(seq: Column) -> tuple[Column, Column]:
    """Start and stop without upper-case Ns at the ends; a read of Ns only gets (length, 0)."""
    return F.length(F.regexp_extract(seq, "^N+", 0)), F.length(seq) - F.length(F.regexp_extract(seq, "N+$", 0))


def length_tag(name: Column, tag: str, seq: Column) -> Column:
    new = F.concat(F.lit(re.sub(r"([\\$])", r"\\\1", tag)), F.length(seq).cast("string"))
    return F.when(F.contains(name, F.lit(tag)), F.regexp_replace(name, F.lit(rf"\b{tag}[0-9]*\b"), new)).otherwise(name)


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), piece(name, 0, F.length(name) - len(suffix))).otherwise(name) if suffix else name


def affixed(name: Column, prefix: str, suffix: str, adapter: Column) -> Column:
    def fill(text: str) -> list[Column]:
        parts = text.split("{name}")
        return [x for i, p in enumerate(parts) for x in ([adapter] if i else []) + ([F.lit(p)] if p else [])]

    return F.concat(*fill(prefix), name, *fill(suffix))


def zero_cap(qual: Column, base: int = 33) -> Column:
    return F.translate(qual, "".join(map(chr, range(1, base))), chr(base) * (base - 1))


def header_parts(name: Column) -> tuple[Column, Column]:
    """Id and comment: split at the first white space; without a second word all is the id."""
    ws = r"[\s\x1c-\x1f\x85\xa0]+"
    two = F.regexp_extract(name, rf"(?s)^[\s\x1c-\x1f\x85\xa0]*([^\s\x1c-\x1f\x85\xa0]+){ws}([^\s\x1c-\x1f\x85\xa0].*)$", 2)
    one = F.regexp_extract(name, rf"(?s)^[\s\x1c-\x1f\x85\xa0]*([^\s\x1c-\x1f\x85\xa0]+){ws}", 1)
    return F.when(two == "", name).otherwise(one), two


VARIABLES = ("header", "id", "comment", "cut_prefix", "cut_suffix", "adapter_name", "rc", "match_sequence")


class InvalidTemplate(ValueError):
    pass


def template(text: str, values: dict[str, Column]) -> Column:
    """A name from a template whose variables stand in braces; ``\\t`` is a tab."""
    parts, at = [], 0
    text = text.replace(r"\t", "\t")
    for m in re.finditer(r"\{([^{}]*)\}|[{}]", text):
        if m[1] is None:
            raise InvalidTemplate(f"unbalanced brace in {text!r}")
        if m[1] not in values:
            raise InvalidTemplate(f"unknown variable {m[1]!r} in {text!r}")
        parts += [F.lit(text[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def too_short(seq: Column, n: int) -> Column:
    return F.length(seq) < n


def too_long(seq: Column, n: int) -> Column:
    return F.length(seq) > n


def too_many_n(seq: Column, limit: float) -> Column:
    """``limit`` below 1 is a share of the read; an empty read then passes."""
    count = F.length(seq) - F.length(F.translate(seq, "Nn", ""))
    return count > limit if limit >= 1 else F.coalesce(count / F.nullif(F.length(seq), F.lit(0)) > limit, F.lit(False))


def casava_filtered(name: Column) -> Column:
    at = F.instr(name, " ")
    return (at > 0) & (F.substring(name, at + 2, F.lit(3)) == ":Y:")
