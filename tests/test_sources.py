import bz2
import gzip
import lzma
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.sources import fastx


def records(n=160):
    rng = random.Random(1)
    out = []
    for i in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))
        out.append((f"r{i} c", s, "".join(chr(rng.randint(33, 73)) for _ in s)))
    return out


RECS = records()
FASTQ = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in RECS)
FASTA = "# a comment\n" + "".join(f">{n}\n" + "".join(s[i : i + 15] + "\n" for i in range(0, len(s), 15)) for n, s, _ in RECS)


@pytest.fixture
def split_size(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [1 << 20, 1500, 290])
@pytest.mark.parametrize("fmt", ["fastq", "fasta"])
def test_records_over_the_edges_of_splits(spark, tmp_path, split_size, size, fmt):
    split_size(size)
    f = tmp_path / f"x.{fmt}"
    f.write_text(FASTQ if fmt == "fastq" else FASTA)
    df = fastx.read_reads(spark, str(f), keep_place=True)
    assert [tuple(r)[1:4] for r in df.orderBy("rid").collect()] == [r if fmt == "fastq" else (*r[:2], None) for r in RECS]
    assert [r[0] for r in fastx.numbered(df).orderBy("rid").select("rid").collect()] == list(range(len(RECS)))


@pytest.mark.parametrize("ext", ["gz", "bz2", "xz", "zst"])
def test_compressed(spark, tmp_path, ext):
    f, data = tmp_path / f"x.fastq.{ext}", FASTQ.encode()
    half = FASTQ.index("@r80 ")  # two members
    pack = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.compress}[ext]
    f.write_bytes(pack(data[:half]) + pack(data[half:]))
    assert [tuple(r)[1:] for r in fastx.read_reads(spark, str(f)).orderBy("rid").collect()] == RECS


def test_folder_keeps_the_order_of_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.fastq").write_text(FASTQ.replace("@r", f"@f{k}r"))
    names = [r[0] for r in fastx.read_reads(spark, str(tmp_path)).orderBy("rid").select("name").collect()]
    assert names == [f"f{k}{n}" for k in (1, 2) for n, _, _ in RECS]


def test_sniffing():
    assert [fastx.sniff(x) for x in (b"@r", b"", b">x", b"#c", b"BAM\x01")] == ["fastq", "fastq", "fasta", "fasta", "bam"]
    with pytest.raises(fastx.FormatError):
        fastx.sniff(b"ACGT")


@pytest.mark.parametrize("ext", ["", ".gz", ".bz2", ".xz", ".zst"])
def test_format_of_a_folder_with_an_empty_first_part(spark, tmp_path, ext):
    """By the first part that holds anything, even if its first block is larger than what is fetched at once."""
    rng = random.Random(2)
    text = f">r {'x' * 10}\n{''.join(rng.choice('ACGT') for _ in range(400_000))}\n".encode()
    pack = {"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress, ".zst": zstandard.compress}[ext]
    (tmp_path / f"part-0.fasta{ext}").write_bytes(pack(b""))
    (tmp_path / f"part-1.fasta{ext}").write_bytes(pack(b"") + pack(text))
    assert fastx.head_bytes(spark, str(tmp_path / f"part-0.fasta{ext}")) == b""
    assert [(r.name, len(r.sequence)) for r in fastx.read_reads(spark, str(tmp_path)).collect()] == [("r xxxxxxxxxx", 400_000)]


def test_formats_of_files_from_a_table_with_an_empty_first_split(spark, tmp_path, split_size):
    """Spark writes an empty part for a first partition without rows; it isn't of another format."""
    from strandweave.plans import queries

    keys = pa.table({"o_orderkey": pa.array(range(40_000), pa.int64())})
    pq.write_table(keys, tmp_path / "orders.parquet", use_dictionary=False, compression="none")
    split_size(100_000)  # one row group, which the split in the middle reads
    got = {tuple(r) for r in queries.src4_formats(spark, str(tmp_path)).collect()}
    assert got == {("fastq", "fastq"), ("fasta", "fasta"), ("fastq gzip", "fastq")}


@pytest.mark.parametrize("text", ["@r\nACGT\n+\nII\n", "@r\nACGT\n+\n", "@r\nACGT\n-\nIIII\n", "@r\nACGT\n+x\nIIII\n", "@r\nAC\n+\nII\nr2\nAC\n+\nII\n"])
def test_broken_fastq(text):
    with pytest.raises(fastx.FormatError):
        list(fastx.parse_fastq(text.splitlines()))


def bam(reads):
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 0)
    code = "=ACMGRSVTWYHKDBN"
    for name, seq, qual in reads:
        nib = [code.index(c) for c in seq] + [0] * (len(seq) & 1)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 255, 0, 0, 4, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += bytes(a << 4 | b for a, b in zip(nib[::2], nib[1::2])) + (bytes([255] * len(seq)) if qual is None else bytes(ord(c) - 33 for c in qual))
        out += struct.pack("<i", len(body)) + body
    return out


def test_unaligned_bam(spark, tmp_path):
    reads = [("a", "ACGTN", "IIII#"), ("b", "ACG", None), ("c", "", "")]
    (tmp_path / "x.bam").write_bytes(gzip.compress(bam(reads)[:30]) + gzip.compress(bam(reads)[30:]))
    assert list(fastx.parse_bam(gzip.compress(bam(reads)))) == reads
    assert [tuple(r)[1:] for r in fastx.read_reads(spark, str(tmp_path / "x.bam")).orderBy("rid").collect()] == reads


def test_pairs(spark, tmp_path):
    one, two, short, other = (tmp_path / f"{k}.fastq" for k in ("1", "2", "short", "other"))
    one.write_text("@a/1 x\nAC\n+\nII\n@b/1\nGG\n+\nII\n")
    two.write_text("@a/2 y\nTT\n+\nII\n@b/2\nCC\n+\nII\n")
    short.write_text("@a/2\nTT\n+\nII\n")
    other.write_text("@a/2\nTT\n+\nII\n@c/2\nTT\n+\nII\n")
    got = fastx.read_pairs(spark, str(one), str(two)).orderBy("rid").collect()
    assert [(r.sequence1, r.sequence2) for r in got] == [("AC", "TT"), ("GG", "CC")]
    for bad in (short, other):
        with pytest.raises(PySparkException):
            fastx.read_pairs(spark, str(one), str(bad)).collect()
    mixed = tmp_path / "i.fastq"
    mixed.write_text("@a/1\nAC\n+\nII\n@a/2\nTT\n+\nII\n")
    assert [(r.sequence1, r.sequence2) for r in fastx.read_interleaved(spark, str(mixed)).collect()] == [("AC", "TT")]


@pytest.mark.parametrize("fmt, size, ext", [("fastq", 1 << 20, ""), ("fastq", 1500, ""), ("fastq", 290, ""), ("fasta", 1 << 20, ""), ("fasta", 290, ""), ("fastq", 290, ".gz"), ("fasta", 290, ".xz")])
def test_numbers_of_records_of_several_files(spark, tmp_path, split_size, fmt, size, ext):
    split_size(size)
    pack = {"": bytes, ".gz": gzip.compress, ".xz": lzma.compress}[ext]
    text = FASTQ + "\n" if fmt == "fastq" else FASTA
    for k, x in enumerate([text.replace("@r", "@0r"), "", text.replace("@r", "@2r"), text[: text.index("@r1 ")] if fmt == "fastq" else ">one\nAC\n"]):
        (tmp_path / f"{k} a+b.{fmt}{ext}").write_bytes(pack(x.encode()))
    numbered = fastx.read_numbered(spark, str(tmp_path)).orderBy("rid").collect()
    plain = fastx.read_reads(spark, str(tmp_path)).orderBy("rid").collect()
    assert [r.rid for r in numbered] == list(range(2 * len(RECS) + 1))
    assert [tuple(r)[1:] for r in numbered] == [tuple(r)[1:] for r in plain]
    assert [r.rid for r in fastx.numbered(fastx.read_reads(spark, str(tmp_path), keep_place=True)).orderBy("rid").collect()] == [r.rid for r in numbered]


def test_numbering_moves_no_records(spark, tmp_path, split_size):
    """However large the table: the only shuffles of records are those that bring two reads together."""
    for k in (1, 2):
        (tmp_path / f"{k}.fastq").write_text(FASTQ)
    split_size(1500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan(fastx.read_numbered(spark, str(tmp_path)))
        assert plan(fastx.read_pairs(spark, str(tmp_path), str(tmp_path))).count("SortMergeJoin") == 1
        both = plan(fastx.read_interleaved(spark, str(tmp_path)))
        assert "SortMergeJoin" not in both and "SortAggregate" not in both
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pair_up_needs_both_reads_once(spark):
    def reads(*rids):
        return spark.createDataFrame([(k, f"r{k // 2}/{k % 2 + 1}", "A" * k, "I" * k) for k in rids], "rid long, name string, sequence string, qualities string")

    got = fastx.pair_up(reads(3, 4, 0, 2, 5, 1)).orderBy("rid").collect()
    assert [(r.rid, r.name1, r.sequence1, r.name2, r.sequence2) for r in got] == [(k, f"r{k}/1", "A" * 2 * k, f"r{k}/2", "A" * (2 * k + 1)) for k in range(3)]
    for bad in ((0, 1, 2), (0, 1, 3), (0, 0)):
        with pytest.raises(PySparkException):
            fastx.pair_up(reads(*bad)).collect()


def test_names_match(spark):
    pairs = [("a/1 x", "a/2 y"), ("a", "a"), ("a1", "a4"), ("a1\tx", "a3"), ("1", "2"), ("", ""), ("a/1", "b/2"), ("a b", "a c"), ("é1", "é2"), ("a", "a1")]
    df = spark.createDataFrame(pairs, "a string, b string").select(fastx.names_match(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [True, True, False, True, True, True, False, True, True, False]


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.fastq").write_text("")
    assert fastx.read_reads(spark, str(tmp_path / "e.fastq")).count() == 0
