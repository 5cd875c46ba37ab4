"""Adapter notation: ``name=SEQUENCE;option=value``, ``^``, ``$``, ``X``, ``...``, ``x{n}`` and adapter files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .adapters import Adapter, Linked

#: option -> the name under which it is kept, and a fixed value if it has one
OPTIONS = {
    **dict.fromkeys(["e", "error_rate", "max_error_rate", "max_errors"], ("max_errors", None)),
    **dict.fromkeys(["o", "min_overlap"], ("min_overlap", None)),
    "anywhere": ("anywhere", None),
    "rightmost": ("rightmost", None),
    "required": ("required", None),
    "optional": ("required", False),
    "indels": ("indels", None),
    "noindels": ("indels", False),
}
REGULAR = ("front", "back", "rightmost_front", "rightmost_back")


def parse_options(text: str) -> dict:
    out, given = {}, set()
    for item in filter(None, map(str.strip, text.split(";"))):
        key, eq, value = map(str.strip, item.partition("="))
        if key not in OPTIONS:
            raise KeyError(f"unknown option {key!r}")
        if eq and not value:
            raise ValueError(f"option {key!r} lacks a value")
        name, fixed = OPTIONS[key]
        if name in out:
            clash = key in ("optional", "required", "indels", "noindels") and not given & {key}
            raise (ValueError if clash else KeyError)(f"option {name!r} is given twice")
        given.add(key)
        out[name] = fixed if fixed is not None else True if not value else int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value)
    return out


def expand(text: str) -> str:
    """``x{n}`` stands for n times x."""
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if c in "{}":
            raise ValueError("a brace has to follow a character and be closed")
        got = re.compile(r"\{(\d+)\}").match(text, at + 1)
        if got:
            if int(got[1]) > 10000:
                raise ValueError(f"{got[1]} is too many")
            out, at = out + c * int(got[1]), got.end()
        else:
            out, at = out + c, at + 1
    return out


def parse_part(text: str, where: str) -> tuple[str | None, str, str, dict]:
    """One adapter without ``...``: its name, kind, sequence and options; where: front, back or anywhere."""
    if where not in ("front", "back", "anywhere"):
        raise ValueError("an adapter is searched front, back or anywhere")
    body, _, options = text.partition(";")
    name, eq, rest = body.partition("=")
    name, seq = (name.strip(), rest) if eq else (None, body)
    seq, opts = expand(seq.strip()), parse_options(options)
    rightmost = opts.pop("rightmost", False)
    if not seq.strip("X"):
        return name, where, seq, {}
    marks = []
    if seq.startswith("^"):
        marks, seq = marks + [("front", "anchored")], seq[1:]
    if seq[:1] in "xX" and seq:
        marks, seq = marks + [("front", "edge")], seq.lstrip("xX")
    if seq.endswith("$"):
        marks, seq = marks + [("back", "anchored")], seq[:-1]
    if seq[-1:] in "xX" and seq:
        marks, seq = marks + [("back", "edge")], seq.rstrip("xX")
    if len(marks) > 1:
        raise ValueError("only one of ^ADAPTER, ADAPTER$, XADAPTER and ADAPTERX can be used")
    side, mark = marks[0] if marks else (None, None)
    if mark and where == "anywhere":
        raise ValueError("an adapter that is searched anywhere can't be placed")
    if mark and side != where:
        raise ValueError("a 5' adapter can be placed as ^ADAPTER or XADAPTER, a 3' adapter as ADAPTER$ or ADAPTERX")
    if mark == "anchored" and "min_overlap" in opts:
        raise ValueError("an anchored adapter always matches whole; it can't have an overlap")
    if "min_overlap" in opts:
        opts["min_overlap"] = min(opts["min_overlap"], len(seq))
    if rightmost and (mark or where == "anywhere"):
        raise ValueError("rightmost goes with regular 5' and 3' adapters only")
    kind = {"anchored": {"front": "prefix", "back": "suffix"}.get(where), "edge": f"edge_{where}", None: f"rightmost_{where}" if rightmost else where}[mark]
    return name, kind, seq, opts


def make(text: str, where: str, name: str | None = None, **defaults) -> Adapter | Linked:
    """An adapter from its notation; ``defaults``: max_errors, min_overlap, read_wildcards, adapter_wildcards, indels, required."""
    if where not in ("front", "back", "anywhere"):
        raise ValueError("an adapter is searched front, back or anywhere")
    left, dots, right = text.partition("...")
    if dots and left and right:
        if where == "anywhere":
            raise ValueError("an adapter that is searched anywhere can't be linked")
        parts = [parse_part(left, "front"), parse_part(right, "back")]
        placed, built = [p[1] not in ("front", "back", "rightmost_front", "rightmost_back") for p in parts], []
        required = [True, True] if where == "front" else placed
        for i, (_, kind, seq, opts) in enumerate(parts):
            opts = defaults | opts
            required[i] = opts.pop("required", required[i])
            if opts.pop("anywhere", False) and kind in REGULAR:
                raise ValueError("anywhere can't be used within linked adapters")
            built.append(Adapter(kind, seq, "", **opts))
        return Linked(*built, *required, name=name if name is not None else parts[0][0] or "")
    if dots:
        if where == "anywhere":
            raise ValueError("'...' can't be used with an adapter that is searched anywhere")
        if not left and where == "front":
            raise ValueError("a 5' adapter can't begin with '...'")
        text, where = (right, where) if not left else (left, "front")
    own, kind, seq, opts = parse_part(text, where)
    if opts.pop("anywhere", False) and kind in REGULAR:
        opts["force_anywhere"] = True
    if "required" in opts:
        raise ValueError("required and optional can only be used within linked adapters")
    return Adapter(kind, seq, name if name is not None else own or "", **(defaults | opts))


def adapter_file(path: str) -> Iterator[tuple[str | None, str]]:
    from ..sources.fastx import open_file, parse_fasta

    with open_file(path) as f:
        for header, seq, _ in parse_fasta(f):
            words = header.split(None, 1)
            yield (words[0] if words else None), seq


def adapters(specs: list[tuple[str, str]], first_number: int = 1, **defaults) -> list[Adapter | Linked]:
    """Adapters from (where, notation) pairs; those without a name are numbered."""
    out = []
    for where, text in specs:
        got = re.match(r"(\^?)file(\$?):", text)
        if got and not (got[1] and got[2]):
            path, _, options = text[got.end() :].partition(";")
            out += [make(got[1] + seq + got[2], where, name, **(defaults | parse_options(options))) for name, seq in adapter_file(path)]
        else:
            out.append(make(text, where, **defaults))
    number = first_number
    for a in out:
        if not a.name:
            a.name, number = str(number), number + 1
        if isinstance(a, Linked):
            a.front.name = a.name
    return out
