"""Command line: ``python -m strandweave [options] -o OUT IN [IN2]``.

Options become a ``TrimSpec``; reads go through one Spark job that writes all
outputs and one that sums the statistics.  Exit codes: 0, 1 for bad data or
files, 2 for bad usage.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterator
from contextlib import redirect_stdout
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import spec as notation
from ..functions.adapters import Index, Linked, Matcher
from ..functions.exprs import InvalidTemplate
from ..operators import sinks
from ..operators.statistics import Statistics, collect
from ..sources import fastx, storage
from . import report
from .trim import Side, TrimSpec, trim


class UsageError(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise UsageError(message)


# Names, short forms, defaults and value names of options, by which command lines are written.
def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="strandweave", description="Trims adapters and more from sequencing reads.", allow_abbrev=False)
    add = p.add_argument
    add("--version", action="version", version=__version__)
    add("--debug", action="count", default=0, help="print the plan that Spark runs")
    add("--profile", action="store_true", help="print the seconds that the parts of a run take")
    add("-j", "--cores", type=int, default=0, help="cores of a local run (0: all)")
    add("--gc-content", type=float, default=50)
    add("--buffer-size", type=int, default=4_000_000, help="has no effect; Spark sizes its partitions")
    add("--no-index", dest="index", action="store_false")
    for read, flags in ((1, ("-a --adapter", "-g --front", "-b --anywhere")), (2, ("-A", "-G", "-B"))):
        for flag, where in zip(flags, ("back", "front", "anywhere")):
            add(*flag.split(), dest=f"adapters{read}", action="append", default=[], metavar="ADAPTER", type=lambda x, w=where: (w, x))
    add("-e", "--error-rate", "--errors", type=float, default=0.1)
    add("--no-indels", dest="indels", action="store_false")
    add("-n", "--times", type=int, default=1)
    add("-O", "--overlap", type=int, default=3)
    add("--match-read-wildcards", action="store_true")
    add("-N", "--no-match-adapter-wildcards", dest="adapter_wildcards", action="store_false")
    add("--action", choices=("trim", "retain", "mask", "lowercase", "crop", "none"), default="trim")
    add("--rc", "--revcomp", dest="both_strands", action="store_true")
    add("--no-trim", dest="action", action="store_const", const="none")
    add("--mask-adapter", dest="action", action="store_const", const="mask")
    add("-u", "--cut", action="append", type=int, default=[])
    add("-U", dest="cut2", action="append", type=int, default=[])
    add("--nextseq-trim", type=int)
    add("-q", "--quality-cutoff", metavar="[5'CUTOFF,]3'CUTOFF")
    add("-Q", dest="quality_cutoff2", metavar="[5'CUTOFF,]3'CUTOFF")
    add("--quality-base", type=int, default=33)
    add("--poly-a", action="store_true")
    add("-l", "--length", type=int)
    add("-L", dest="length2", type=int)
    add("--trim-n", action="store_true")
    add("--length-tag", metavar="TAG")
    add("--strip-suffix", action="append", default=[])
    add("-x", "--prefix", default="")
    add("-y", "--suffix", default="")
    add("--rename", metavar="TEMPLATE")
    add("-z", "--zero-cap", action="store_true")
    add("-m", "--minimum-length", metavar="LEN[:LEN2]")
    add("-M", "--maximum-length", metavar="LEN[:LEN2]")
    add("--max-n", type=float)
    add("--max-ee", "--max-expected-errors", dest="max_ee", type=float)
    add("--max-aer", "--max-average-error-rate", dest="max_aer", type=float)
    add("--discard-trimmed", "--discard", action="store_true")
    add("--discard-untrimmed", "--trimmed-only", action="store_true")
    add("--discard-casava", action="store_true")
    add("--quiet", action="store_true")
    add("--report", choices=("full", "minimal"))
    add("--json", metavar="FILE")
    add("-o", "--output", metavar="FILE")
    add("-p", "--paired-output", metavar="FILE")
    add("--fasta", action="store_true")
    add("--compression-level", type=int, default=1, help="of gz, xz and zst outputs that aren't sharded")
    add("-Z", dest="compression_level", action="store_const", const=1)
    add("--unordered", action="store_true", help="outputs needn't be in the order of inputs; nothing is shuffled then")
    add("--sharded", action="store_true", help="leave each output as a folder of parts")
    for name in ("info-file", "info-file-paired", "rest-file", "wildcard-file"):
        add(*(["-r"] if name == "rest-file" else []), f"--{name}", metavar="FILE")
    for name in ("too-short", "too-long", "untrimmed"):
        add(f"--{name}-output", metavar="FILE")
        add(f"--{name}-paired-output", metavar="FILE")
    add("--pair-adapters", action="store_true")
    add("--pair-filter", choices=("any", "both", "first"))
    add("--interleaved", action="store_true")
    add("inputs", nargs="*")
    return p


def cutoffs(text: str | None) -> tuple[int, int] | None:
    """INT[,INT] as (5', 3'); exactly 0 switches trimming off."""
    if text is None or text == "0":
        return None
    try:
        got = [int(x) for x in text.split(",")]
    except ValueError:
        raise UsageError(f"quality cutoff {text!r} isn't one or two numbers") from None
    if len(got) > 2:
        raise UsageError("one or two quality cutoffs are expected")
    return (0, got[0]) if len(got) == 1 else (got[0], got[1])


def lengths(text: str | None, paired: bool) -> tuple[int | None, int | None]:
    """LEN, LEN:LEN2, LEN: or :LEN2 for both reads."""
    if text is None:
        return None, None
    fields = text.split(":")
    try:
        got = [int(f) if f else None for f in fields]
    except ValueError:
        raise UsageError(f"length {text!r} isn't a number") from None
    if len(got) > 2 or (len(got) == 2 and got == [None, None]) or got == [None]:
        raise UsageError(f"{text!r} isn't LEN, LEN:LEN2, LEN: or :LEN2")
    if len(got) == 2 and not paired:
        raise UsageError("two lengths go with paired reads only")
    return (got[0], got[0]) if len(got) == 1 else (got[0], got[1])


def is_paired(a: argparse.Namespace) -> bool:
    marks = (a.paired_output, a.interleaved, a.adapters2, a.cut2, a.length2, a.pair_filter, a.untrimmed_paired_output, a.too_short_paired_output, a.too_long_paired_output, a.quality_cutoff2, a.info_file_paired)
    return any(bool(x) for x in marks)


def _demultiplex(a: argparse.Namespace, paired: bool) -> str | None:
    o, p = a.output or "", a.paired_output or ""
    if "{name}" in o and ("{name1}" in o or "{name2}" in o):
        raise UsageError("{name} can't be used together with {name1} and {name2}")
    if "{name1}" in o or "{name2}" in o or "{name1}" in p or "{name2}" in p:
        if not all(x in y for x in ("{name1}", "{name2}") for y in (o, p)):
            raise UsageError("{name1} and {name2} are needed in both output names")
        return "both"
    if "{name}" in o or "{name}" in p:
        if paired and not ("{name}" in o and "{name}" in p):
            raise UsageError("{name} is needed in both output names")
        return "name"
    return None


def check(a: argparse.Namespace, paired: bool) -> None:
    if a.quiet and a.report:
        raise UsageError("--quiet and --report can't be used together")
    if not a.inputs:
        raise UsageError("no input files were given")
    if len(a.inputs) > 2:
        raise UsageError(f"one or two input files are expected, not {len(a.inputs)}")
    if paired and not a.interleaved and len(a.inputs) == 1:
        raise UsageError("paired reads need two input files or --interleaved")
    if not paired and len(a.inputs) == 2:
        raise UsageError("two input files need two output files (-o and -p) or --interleaved")
    if a.interleaved and len(a.inputs) == 2 and a.paired_output:
        raise UsageError("--interleaved has no use with two input and two output files")
    if not paired and a.pair_adapters:
        raise UsageError("--pair-adapters goes with paired reads only")
    names = ("untrimmed", "too_short", "too_long")
    if paired and not a.interleaved:
        if not a.paired_output:
            raise UsageError("paired reads need a second output file (-p)")
        if not a.output:
            raise UsageError("-p needs -o")
        for n in names:
            if bool(getattr(a, f"{n}_output")) != bool(getattr(a, f"{n}_paired_output")):
                raise UsageError(f"none or both of the {n.replace('_', '-')} outputs are needed for paired reads")
    if a.overlap < 1:
        raise UsageError("the overlap must be at least 1")
    if not 0 <= a.gc_content <= 100:
        raise UsageError("GC content is a percentage")
    if a.pair_adapters and (a.times != 1 or a.both_strands):
        raise UsageError("--pair-adapters can't be used with --times or --revcomp")
    for n, length in (("too_short", a.minimum_length), ("too_long", a.maximum_length)):
        if length is None and (getattr(a, f"{n}_output") or getattr(a, f"{n}_paired_output")):
            raise UsageError(f"--{n.replace('_', '-')}-output needs a length")
    paths = [p for p in (a.output, a.paired_output, a.info_file, a.info_file_paired, a.rest_file, a.wildcard_file, *(getattr(a, f"{n}{m}_output") for n in names for m in ("", "_paired"))) if p and p not in ("-", os.devnull)]
    if twice := {p for p in paths if paths.count(p) > 1}:
        raise UsageError(f"{twice.pop()} is given for two outputs")


def to_spec(a: argparse.Namespace, paired: bool) -> TrimSpec:
    options = {"max_errors": a.error_rate, "min_overlap": a.overlap, "read_wildcards": a.match_read_wildcards, "adapter_wildcards": a.adapter_wildcards, "indels": a.indels}
    short, long = lengths(a.minimum_length, paired), lengths(a.maximum_length, paired)
    q1, q2 = cutoffs(a.quality_cutoff), cutoffs(a.quality_cutoff2)
    if paired and a.quality_cutoff is not None and a.quality_cutoff2 is None:
        q2 = q1
    l2 = a.length if a.length2 is None else a.length2
    if sum([a.discard_trimmed, a.discard_untrimmed, bool(a.untrimmed_output or a.untrimmed_paired_output)]) > 1:
        raise UsageError("only one of --discard-trimmed, --discard-untrimmed and --untrimmed-output can be used")
    demultiplex = _demultiplex(a, paired)
    try:
        first = notation.adapters(a.adapters1, **options)
        second = notation.adapters(a.adapters2, first_number=1 + sum(x.name.isdigit() and not _named(t) for x, t in zip(first, a.adapters1)), **options)
        if a.pair_adapters and len(first) != len(second):
            raise UsageError("--pair-adapters needs as many adapters for the first as for the second reads")
        spec = TrimSpec(
            first=Side(first, a.cut, q1, a.length, short[0], long[0]), second=Side(second, a.cut2, q2, l2, short[1], long[1]) if paired else None,
            times=a.times, action=a.action, index=a.index, both_strands=a.both_strands, pair_adapters=a.pair_adapters, nextseq=a.nextseq_trim, quality_base=a.quality_base,
            poly_a=a.poly_a, trim_n=a.trim_n, length_tag=a.length_tag, strip_suffixes=a.strip_suffix, prefix=a.prefix, suffix=a.suffix, rename=a.rename, zero_cap=a.zero_cap,
            max_n=a.max_n, max_expected_errors=a.max_ee, max_average_error=a.max_aer, discard_casava=a.discard_casava,
            discard="trimmed" if a.discard_trimmed else "untrimmed" if a.discard_untrimmed else None,
            untrimmed_apart=bool(a.untrimmed_output or a.untrimmed_paired_output) and demultiplex is None, pair_filter=a.pair_filter or "any", demultiplex=demultiplex,
        )
        for _, side in spec.sides:
            spec.cutter(side)  # what can't be combined shows before anything is read
        return spec
    except (ValueError, KeyError, InvalidTemplate) as e:
        raise UsageError(str(e).strip("'\"")) from e


def _named(given: tuple[str, str]) -> bool:
    return "=" in given[1].partition(";")[0] or "file:" in given[1] or "file$:" in given[1]


@dataclass
class Output:
    """Where the lines of a sink go."""

    sink: str
    path: str


def _is_fasta(path: str | None, forced: bool, input_fasta: bool) -> bool:
    name = (path or "").lower()
    for codec in (".gz", ".bz2", ".xz", ".zst"):
        name = name.removesuffix(codec)
    if path in (None, "-") and forced:
        return True
    if name.endswith((".fasta", ".fa", ".fna", ".csfasta", ".fsa")):
        return True
    if name.endswith((".fastq", ".fq", ".txt")):
        return input_fasta if name.endswith(".txt") else False
    return input_fasta


def plan_outputs(a: argparse.Namespace, spec: TrimSpec, input_fasta: bool) -> tuple[list[tuple[Column, Column]], list[Output]]:
    """Rows of (sink, lines) for the write and where each sink goes."""
    rows: list[tuple[Column, Column]] = []
    outs: list[Output] = []
    paired = spec.second is not None
    prefixes = [p for p, _ in spec.sides]

    def reads(condition: Column, sink: str | Column, path1: str | None, path2: str | None) -> None:
        """Records of both reads to two paths, or one after the other to one."""
        name = F.lit(sink) if isinstance(sink, str) else sink
        fasta = _is_fasta(path1, a.fasta, input_fasta)
        text = [sinks.record(p, fasta) for p in prefixes]
        if paired and path2 is not None:
            rows.append((F.when(condition, F.concat(name, F.lit(".1"))), F.array(text[0])))
            rows.append((F.when(condition, F.concat(name, F.lit(".2"))), F.array(text[1])))
        else:
            rows.append((F.when(condition, F.concat(name, F.lit(".1"))), F.array(*text)))

    def target(sink: str, path1: str | None, path2: str | None) -> None:
        outs.append(Output(f"{sink}.1", path1 or "-"))
        if paired and path2 is not None:
            outs.append(Output(f"{sink}.2", path2))

    names = [[x.name for x in s.adapters] for _, s in spec.sides]
    for k, path in ((0, a.info_file), (1, a.info_file_paired if a.info_file else None)):
        if path:
            rows.append((F.lit(f"info{k}"), sinks.info_lines(prefixes[k], names[k], [isinstance(x, Linked) for x in spec.sides[k][1].adapters])))
            outs.append(Output(f"info{k}", path))
    if (a.rest_file or a.wildcard_file) and any(isinstance(x, Linked) for x in spec.first.adapters):
        raise UsageError("rest and wildcard files can't be written for linked adapters")
    if a.rest_file:
        rows.append((F.lit("rest"), F.array(sinks.rest_line(prefixes[0]))))
        outs.append(Output("rest", a.rest_file))
    if a.wildcard_file:
        cutter = spec.cutter(spec.first)
        rows.append((F.lit("wildcard"), F.array(sinks.wildcard_line(prefixes[0], cutter)) if cutter else F.array().cast("array<string>")))
        outs.append(Output("wildcard", a.wildcard_file))
    fate = F.col("fate")
    for n in ("too_short", "too_long"):
        p1, p2 = getattr(a, f"{n}_output"), getattr(a, f"{n}_paired_output")
        if p1 or p2:
            reads(fate == n, n, p1, p2)
            target(n, p1, p2)
    if spec.untrimmed_apart:
        reads(fate == "discard_untrimmed", "untrimmed", a.untrimmed_output, a.untrimmed_paired_output)
        target("untrimmed", a.untrimmed_output, a.untrimmed_paired_output)
    if spec.demultiplex is None:
        reads(fate.isNull(), "out", a.output, a.paired_output)
        target("out", a.output, a.paired_output)
        return rows, outs
    reads(fate.isNull(), F.concat(F.lit("demux-"), "demux"), a.output, a.paired_output)
    fill = lambda path, **names: path and _replace(path, names)
    own, unknown = spec.discard != "untrimmed", ["unknown"]
    if spec.demultiplex == "both":
        for x in [*names[0], *(unknown if own else [])]:
            for y in [*names[1], *(unknown if own else [])]:
                target(f"demux-{x}-{y}", fill(a.output, name1=x, name2=y), fill(a.paired_output, name1=x, name2=y))
    else:
        for x in names[0]:
            target(f"demux-{x}", fill(a.output, name=x), fill(a.paired_output, name=x))
        if own:
            target("demux-unknown", a.untrimmed_output or fill(a.output, name="unknown"), a.untrimmed_paired_output or fill(a.paired_output, name="unknown"))
    return rows, outs


def _replace(path: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        path = path.replace("{" + k + "}", v)
    return path


def _input(path: str, spark: SparkSession) -> str:
    """A path; the standard input is copied to the shared folder first, where executors can read it."""
    if path != "-":
        return path
    target = storage.scratch(spark, "stdin")
    storage.write_chunks(spark, target, iter(lambda: sys.stdin.buffer.read(1 << 20), b""))
    return target


def warnings(a: argparse.Namespace, spec: TrimSpec, has_qualities: bool) -> Iterator[str]:
    """What a run leaves undone without failing."""
    if not has_qualities:
        for name in ("max_ee", "max_aer"):
            if getattr(a, name) is not None:
                yield f"--{name.replace('_', '-')} does nothing, as the input has no qualities"
    for _, side in spec.sides:
        cutter = spec.cutter(side)
        for index in (x for x in Matcher(side.adapters).plan if isinstance(x, Index)) if cutter and cutter.index else ():
            if index.ambiguous:
                some = ", ".join(sorted(index.ambiguous)[:3])
                yield f"{len(index.ambiguous)} sequences, such as {some}, are equally near to several adapters; reads with these aren't trimmed (--no-index takes the first adapter)"


def read_input(spark: SparkSession, a: argparse.Namespace, paired: bool) -> tuple[DataFrame, str]:
    paths = [_input(p, spark) for p in a.inputs]
    files = fastx._files(spark, paths[0])
    fmt = fastx.format_of(spark, [p for p, n in files if n])
    if paired and a.interleaved and len(paths) == 1:
        return fastx.read_interleaved(spark, paths[0], fmt), fmt
    if paired:
        return fastx.read_pairs(spark, *paths), fmt
    return fastx.read_reads(spark, paths[0], fmt), fmt


def run(argv: list[str], spark: SparkSession | None = None) -> Statistics:
    """A whole run; returns its statistics."""
    a = parser().parse_args(argv)
    paired = is_paired(a)
    check(a, paired)
    spec = to_spec(a, paired)
    spark = spark or storage.session(a.cores)
    reads, fmt = read_input(spark, a, paired)
    has_qualities = fmt != "fasta"
    rows, outs = plan_outputs(a, spec, fmt == "fasta")
    try:
        result = trim(reads, spec, has_qualities).persist(StorageLevel.MEMORY_AND_DISK)
    except InvalidTemplate as e:
        raise UsageError(str(e)) from e
    for text in warnings(a, spec, has_qualities):
        print(f"strandweave: warning: {text}", file=sys.stderr)
    if a.debug:
        with redirect_stdout(sys.stderr):
            result.explain("formatted")
    began, seconds = time.time(), {}
    folder = storage.scratch(spark, "sinks")
    try:
        sinks.write_sinks(result, rows, folder, ordered=not a.unordered)
        seconds["reading, trimming and writing"] = time.time() - began
        stats = collect(result, spec, has_qualities)
        seconds["statistics"] = time.time() - began - sum(seconds.values())
        for o in outs:
            storage.deliver(spark, f"{folder}/sink={storage.escaped(spark, o.sink)}", o.path, a.sharded, a.compression_level)
        seconds["joining parts to files"] = time.time() - began - sum(seconds.values())
    finally:
        result.unpersist()
        storage.drop(spark, folder)
    if a.json:
        head = {"tag": "Trimming report", "schema_version": report.OnLine([0, 3]), "engine_version": __version__, "command_line_arguments": argv, "cores": a.cores or spark.sparkContext.defaultParallelism,
                "input": {"path1": a.inputs[0], "path2": a.inputs[1] if len(a.inputs) > 1 else None, "paired": paired}}
        with open(a.json, "w") as f:
            f.write(report.dumps(report.json_report(stats, a.gc_content / 100, **head)) + "\n")
    if a.profile:
        print("\n".join(f"{s:9.2f} s {what}" for what, s in seconds.items()), file=sys.stderr)
    if not a.quiet:
        text = report.minimal_report(stats) if a.report == "minimal" else report.full_report(stats, a.gc_content / 100)
        print(text, file=sys.stderr if any(o.path == "-" for o in outs) else sys.stdout)
    return stats


def main(argv: list[str] | None = None) -> int:
    try:
        run(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"strandweave: error: {e}", file=sys.stderr)
        return 2
    except (OSError, ValueError, PySparkException) as e:
        print(f"strandweave: error: {str(e)[:2000]}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0
