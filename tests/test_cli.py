"""Whole runs from files to files."""

import gzip
import io
import json
import lzma
import sys

import pytest

from strandweave.plans import cli

READS = [("r1 one", "ACGTACGTTTAGGGCC", "IIIIIIIIIIIIIIII"), ("r2", "CCCCGGAGGGAA", "IIIIIIII####"), ("r3", "TTTT", "IIII"), ("r4", "AACCAACCAACC", "IIIIIIIIIIII")]


def fastq(reads):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads)


@pytest.fixture
def go(spark, tmp_path):
    (tmp_path / "in.fastq").write_text(fastq(READS))

    def run(*args, inputs=("in.fastq",), code=0):
        args = [a.replace("@", str(tmp_path) + "/") for a in args]
        assert cli.main([*args, *[str(tmp_path / i) for i in inputs]]) == code
        return lambda name: (tmp_path / name).read_text()

    return run


def test_trimming_with_side_outputs_and_reports(go, capsys):
    read = go("-a", "ad=AGGG", "-m", "5", "--too-short-output", "@short.fastq", "--info-file", "@info", "-r", "@rest", "--json", "@report.json", "-o", "@out.fastq")
    assert read("out.fastq") == fastq([("r1 one", "ACGTACGTTT", "I" * 10), ("r2", "CCCCGG", "IIIIII"), READS[3]])
    assert read("short.fastq") == fastq([READS[2]])
    assert read("rest") == "CC r1 one\nAA r2\n"
    assert read("info").splitlines()[2] == "r3\t-1\tTTTT\tIIII"
    got = json.loads(read("report.json"))
    assert got["read_counts"]["input"] == 4 and got["read_counts"]["filtered"]["too_short"] == 1 and got["adapters_read1"][0]["total_matches"] == 2
    text = capsys.readouterr().out
    assert "Reads with adapters:                         2 (50.0%)" in text and "=== Adapter ad ===" in text


def test_minimal_report(go, capsys):
    go("-a", "AGGG", "-q", "10", "--report=minimal", "-o", "@out.fastq")
    head, row = capsys.readouterr().out.strip().split("\n")
    assert dict(zip(head.split("\t"), row.split("\t"))) == {"status": "OK", "in_reads": "4", "in_bp": "44", "too_short": "0", "too_long": "0", "too_many_n": "0", "out_reads": "4", "w/adapters": "1", "qualtrim_bp": "4", "out_bp": "34"}


def test_demultiplexing_makes_all_files(go):
    read = go("--quiet", "-g", "a=^ACGT", "-g", "b=^CCCC", "-g", "c=^GGGG", "-o", "@{name}.fasta")
    assert read("a.fasta") == ">r1 one\nACGTTTAGGGCC\n" and read("b.fasta") == ">r2\nGGAGGGAA\n" and read("c.fasta") == ""
    assert read("unknown.fasta") == ">r3\nTTTT\n>r4\nAACCAACCAACC\n"


def test_compressed_output(go, tmp_path):
    go("--quiet", "-o", "@out.fastq.gz")
    assert gzip.open(tmp_path / "out.fastq.gz", "rt").read() == fastq(READS)
    for ext in ("xz", "zst", "bz2"):
        go("--quiet", "-o", f"@out.fastq.{ext}")
        go("--quiet", "-o", "@again.fastq", inputs=(f"out.fastq.{ext}",))
        assert (tmp_path / "again.fastq").read_text() == fastq(READS)


def test_pairs_to_two_files_and_interleaved(go, tmp_path):
    second = [(n, s[::-1], q) for n, s, q in READS]
    (tmp_path / "in2.fastq").write_text(fastq(second))
    read = go("--quiet", "-a", "AGGG", "-A", "CCAA", "-m", "3:9", "-o", "@o1.fastq", "-p", "@o2.fastq", inputs=("in.fastq", "in2.fastq"))
    assert read("o1.fastq").count("@r") == read("o2.fastq").count("@r") == 2
    read = go("--quiet", "--interleaved", "-o", "@i.fastq", inputs=("in.fastq", "in2.fastq"))
    assert read("i.fastq") == fastq([x for two in zip(READS, second) for x in two])
    read = go("--quiet", "--interleaved", "-o", "@j1.fastq", "-p", "@j2.fastq", inputs=("i.fastq",))
    assert read("j1.fastq") == fastq(READS) and read("j2.fastq") == fastq(second)
    read = go("--quiet", "-g", "a=^ACGT", "-G", "b=^AAGG", "-o", "@{name1}-{name2}.1.fastq", "-p", "@{name1}-{name2}.2.fastq", inputs=("in.fastq", "in2.fastq"))
    assert read("a-unknown.1.fastq").count("@r") == 1 and read("unknown-b.1.fastq").count("@r") == 1 and read("unknown-unknown.2.fastq").count("@r") == 2 and read("a-b.1.fastq") == ""


def test_standard_output(go, capfdbinary):
    go("--quiet", "--fasta", "-l", "2", "-o", "-")
    assert b">r1 one\nAC\n>r2\nCC\n>r3\nTT\n>r4\nAA\n" in capfdbinary.readouterr().out


def test_a_folder_of_parts(go, tmp_path):
    go("--quiet", "--sharded", "-o", "@parts.fastq")
    assert "".join(p.read_text() for p in sorted((tmp_path / "parts.fastq").glob("part-*"))) == fastq(READS)


@pytest.mark.parametrize(
    "args",
    [
        ["-a", "A{20000}"], ["-q", "x"], ["-m", "1:2"], ["-O", "0"], ["--gc-content", "110"], ["--discard-trimmed", "--discard-untrimmed"], ["--pair-adapters"], ["-p", "@x.fastq"], ["--too-short-output", "@s.fastq"],
        ["--rename={id}", "-x", "y"], ["--rename={bogus}"], ["-u", "1", "-u", "2"], ["--nothing"], ["-n", "2", "-a", "ACGT", "--action=retain"], ["--info-file", "@out.fastq"],
    ],
)
def test_usage_errors(go, args):
    go(*args, "-o", "@out.fastq", code=2)


def test_missing_and_broken_inputs(go, tmp_path):
    go("-o", "@out.fastq", inputs=("nothing.fastq",), code=1)
    (tmp_path / "bad.fastq").write_text("@r\nACGT\n+\nII\n")
    go("-o", "@out.fastq", inputs=("bad.fastq",), code=1)


def test_warnings(go, tmp_path, capfd):
    (tmp_path / "in.fasta").write_text(">r1\nACGTT\n>r2\nACGAT\n")
    go("--quiet", "--max-ee", "1", "-g", "a=^ACGT", "-g", "b=^ACGA", "-e", "1", "--no-indels", "-o", "@out.fasta", inputs=("in.fasta",))
    err = capfd.readouterr().err
    assert "--max-ee does nothing" in err and "equally near to several adapters" in err
    go("--quiet", "-a", "AGGG", "-o", "@out.fastq")
    assert "warning" not in capfd.readouterr().err


def test_plans_and_seconds(go, capfd):
    go("--quiet", "--debug", "--profile", "-q", "10", "-o", "@out.fastq")
    err = capfd.readouterr().err
    assert "ArrowEvalPython" in err and "statistics" in err


@pytest.mark.parametrize("suffix, opened", [("gz", gzip.open), ("xz", lzma.open)])
def test_levels_of_compression(go, tmp_path, suffix, opened):
    sizes = []
    for level in ("0", "9"):
        go("--quiet", "--compression-level", level, "-o", f"@out{level}.fastq.{suffix}")
        with opened(tmp_path / f"out{level}.fastq.{suffix}", "rt") as f:
            assert f.read() == fastq(READS)
        sizes.append((tmp_path / f"out{level}.fastq.{suffix}").stat().st_size)
    assert sizes[1] < sizes[0] or suffix == "xz"


def test_standard_input(go, tmp_path, monkeypatch):
    class Stdin:
        buffer = io.BytesIO(fastq(READS).encode())

    monkeypatch.setattr(sys, "stdin", Stdin)
    assert cli.main(["--quiet", "-l", "3", "-o", str(tmp_path / "out.fastq"), "-"]) == 0
    assert (tmp_path / "out.fastq").read_text() == fastq([(n, s[:3], q[:3]) for n, s, q in READS])
