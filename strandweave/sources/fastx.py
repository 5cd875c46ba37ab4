"""Reads from FASTQ, FASTA and unaligned BAM files as DataFrames.

Plain, gzip and bzip2 text goes through Spark's text source, so that any file
system and split sizes work; a vectorised pass over each block frames records.
What crosses a block's edges is framed by a second pass that sends only the few
lines at the edges to Python's side of a join.  Files in xz, zstd or BAM are
read whole by one task each (2 GB at most a file).

Columns: ``rid`` (bigint, in the order of files by path and of records in them),
``name``, ``sequence``, ``qualities`` (null for FASTA).
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of ``rid`` below the number of the file.
PLACE_BITS = 43
TEXT_CODECS, WHOLE_CODECS = (".gz", ".bz2"), (".xz", ".zst")
SCHEMA = "f long, start long, i long, name string, sequence string, qualities string"
EDGES = "f long, start long, kind int, n long, lines array<string>"
TOTALS = "f long, start long, n long"


class FormatError(ValueError):
    pass


def decompressed(stream: io.BufferedIOBase, path: str) -> io.BufferedIOBase:
    if path.endswith(".gz"):
        return gzip.open(stream)
    if path.endswith(".bz2"):
        return bz2.open(stream)
    if path.endswith(".xz"):
        return lzma.open(stream)
    if path.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True))
    return stream


def open_file(path: str) -> io.TextIOWrapper:
    """A small text file on the driver, such as one of adapters."""
    return io.TextIOWrapper(decompressed(open(path, "rb"), path), encoding="ascii")


def sniff(head: bytes) -> str:
    """Format by the first bytes: fastq, fasta or bam."""
    if not head or head[:1] == b"@":
        return "fastq"
    if head[:1] in (b">", b"#"):
        return "fasta"
    if head[:4] == b"BAM\x01":
        return "bam"
    raise FormatError(f"neither FASTA, FASTQ nor unaligned BAM: it begins with {head[:4]!r}")


def parse_fasta(lines) -> Iterator[tuple[str, str, None]]:
    """Sequences may go over several lines; lines that begin with # before or between records are comments."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts), None
            name, parts = line[1:], []
        elif line and not line.startswith("#"):
            if name is None:
                raise FormatError(f"expected '>' at the beginning of a FASTA record, got {line[:50]!r}")
            parts.append(line)
    if name is not None:
        yield name, "".join(parts), None


def parse_fastq(lines) -> Iterator[tuple[str, str, str]]:
    rows = [x.rstrip("\r\n") for x in lines]
    while rows and not rows[-1]:
        rows.pop()
    table = fastq_rows(pa.array(rows, pa.string()))
    yield from zip(*(c.to_pylist() for c in table))


def fastq_rows(lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Names, sequences and qualities of whole records of four lines each."""
    if len(lines) % 4:
        raise FormatError("a FASTQ file ends within a record")
    at = np.arange(0, len(lines), 4)
    head, seq, plus, qual = (lines.take(pa.array(at + k)) for k in range(4))
    for col, mark in ((head, "@"), (plus, "+")):
        ok = pc.starts_with(col, mark)
        if not pc.all(ok).as_py() and len(col):
            raise FormatError(f"expected a FASTQ line that begins with {mark!r}, got {col.filter(pc.invert(ok))[0].as_py()[:50]!r}")
    if not pc.all(pc.equal(pc.binary_length(seq), pc.binary_length(qual))).as_py() and len(seq):
        raise FormatError("sequence and qualities of a FASTQ record differ in length")
    second = pc.utf8_slice_codeunits(plus, 1)
    odd = pc.and_(pc.not_equal(second, ""), pc.not_equal(second, pc.utf8_slice_codeunits(head, 1)))
    if pc.any(odd).as_py():
        raise FormatError("the second header of a FASTQ record differs from the first")
    return pc.utf8_slice_codeunits(head, 1), seq, qual


def _phase(lines: pa.Array) -> int | None:
    """The first line that a FASTQ record begins at: a header, and two lines on a plus; a sequence begins with neither."""
    some = lines.slice(0, 8).to_pylist()
    for p in range(min(4, len(some))):
        if some[p].startswith("@") and p + 2 < len(some) and some[p + 2].startswith("+"):
            return p
    return None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Runs of lines of one block."""
    for batch in batches:
        f, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lines = pc.utf8_rtrim(batch.column(2), characters="\r")
        cuts = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(f)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield (int(f[a]), int(start[a])), lines.slice(a, b - a)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, bool]]:
    """Runs with a mark on a block's first."""
    key = None
    for k, lines in _runs(batches):
        yield k, lines, k != key
        key = k


def _join(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays([p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in parts])


NONE = pa.array([], pa.string())


class _Frame:
    """Cuts a block's lines into records; ``head``: lines before the first record, ``rest``: lines after the last whole one.

    With ``count`` FASTQ records are only counted, and checked where they are read.
    """

    def __init__(self, fmt: str, first: bool, count: bool = False):
        self.fmt, self.rest, self.head, self.n, self.count = fmt, NONE, None, 0, count and fmt == "fastq"
        if first:
            self.head = NONE

    def _start(self, lines: pa.Array) -> int | None:
        if self.fmt == "fastq":
            return _phase(lines)
        hit = np.flatnonzero(pc.starts_with(lines, ">").to_numpy(zero_copy_only=False))
        return int(hit[0]) if len(hit) else None

    def feed(self, lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array] | None:
        lines = _join([self.rest, lines])
        if self.head is None:
            p = self._start(lines)
            if p is None:
                self.rest = lines
                return None
            self.head, lines = lines.slice(0, p), lines.slice(p)
        if self.fmt == "fastq":
            whole = len(lines) // 4 * 4
            if whole and len(lines) == whole and not lines[whole - 1].as_py() and whole >= 4 and lines[whole - 2].as_py() != "+" and not lines[whole - 2].as_py():
                whole -= 4  # blank lines at the end
            if self.count:
                self.rest, self.n = lines.slice(whole), self.n + whole // 4
                return None
            out = fastq_rows(lines.slice(0, whole))
        else:
            hit = np.flatnonzero(pc.starts_with(lines, ">").to_numpy(zero_copy_only=False))
            whole = int(hit[-1]) if len(hit) else 0
            out = fasta_rows(lines.slice(0, whole))
        self.rest = lines.slice(whole)
        self.n += len(out[0])
        return out


def fasta_rows(lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    rows = list(parse_fasta(lines.to_pylist()))
    return pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.nulls(len(rows), pa.string())


def final_rows(fmt: str, lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Records of all lines that are left at a file's end."""
    if fmt == "fasta":
        return fasta_rows(lines)
    rows = lines.to_pylist()
    while rows and not rows[-1]:
        rows.pop()
    return fastq_rows(pa.array(rows, pa.string()))


def _batch(key: tuple[int, int], at: int, rows: tuple[pa.Array, pa.Array, pa.Array]) -> pa.RecordBatch:
    n = len(rows[0])
    cols = [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.arange(at, at + n)), *(r.cast(pa.string()) for r in rows)]
    return pa.RecordBatch.from_arrays(cols, names=["f", "start", "i", "name", "sequence", "qualities"])


def _inner(fmt: str, whole: bool):
    """Records that lie within blocks; with ``whole`` a block is a file and nothing is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frame = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if whole and frame is not None:
                yield _batch(key, frame.n, final_rows(fmt, frame.rest))

        for k, lines, new in _blocks(batches):
            if new:
                yield from close()
                key, frame = k, _Frame(fmt, whole or k[1] == 0)
            at = frame.n
            rows = frame.feed(lines)
            if rows is not None and len(rows[0]):
                yield _batch(k, at, rows)
        yield from close()

    return run


def _edges(fmt: str):
    """For each block the lines before its first record (kind 0) and those after its last whole one (kind 1), with the number of records between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frame = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if frame is not None:
                none = frame.head is None  # no record begins here: all lines go to the block before
                head, rest = (frame.rest, NONE) if none else (frame.head, frame.rest)
                kinds = [0] if none else [0, 1]
                cols = [pa.array([key[0]] * len(kinds), pa.int64()), pa.array([key[1]] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array([frame.n] * len(kinds), pa.int64()),
                        pa.array([head.to_pylist(), rest.to_pylist()][: len(kinds)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["f", "start", "kind", "n", "lines"])

        for k, lines, new in _blocks(batches):
            if new:
                yield from close()
                key, frame = k, _Frame(fmt, k[1] == 0, count=True)
            frame.feed(lines)
        yield from close()

    return run


def _totals(fmt: str):
    """Numbers of records of blocks that are whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frame = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if frame is not None:
                yield _total([key], [frame.n + len(final_rows(fmt, frame.rest)[0])])

        for k, lines, new in _blocks(batches):
            if new:
                yield from close()
                key, frame = k, _Frame(fmt, True, count=True)
            frame.feed(lines)
        yield from close()

    return run


def _total(keys: list[tuple[int, int]], counts: list[int]) -> pa.RecordBatch:
    cols = [pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=["f", "start", "n"])


def _totals_over_edges(fmt: str):
    """Numbers of records of blocks in which one begins, those over its end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, start, n, lines = (c.to_pylist() for c in batch.columns)
            yield _total(list(zip(f, start)), [a + len(final_rows(fmt, pa.array(x, pa.string()))[0]) for a, x in zip(n, lines)])

    return run


def _across(fmt: str):
    """Records of lines gathered over an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, start, n, lines in zip(*(c.to_pylist() for c in batch.columns)):
                rows = final_rows(fmt, pa.array(lines, pa.string()))
                if len(rows[0]):
                    yield _batch((f, start), n, rows)

    return run


def _whole_files(fmt: str):
    """Records of files whose bytes are in rows (f, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if fmt == "bam":
                    rows, at = parse_bam(content), 0
                    while some := [r for _, r in zip(range(20_000), rows)]:
                        yield _batch((f, 0), at, tuple(pa.array([r[j] for r in some], pa.string()) for j in range(3)))
                        at += len(some)
                    continue
                frame, text = _Frame(fmt, True), io.TextIOWrapper(decompressed(io.BytesIO(content), path), encoding="ascii")
                while some := text.readlines(1 << 24):
                    at, rows = frame.n, frame.feed(pa.array([x.rstrip("\r\n") for x in some], pa.string()))
                    if rows is not None and len(rows[0]):
                        yield _batch((f, 0), at, rows)
                yield _batch((f, 0), frame.n, final_rows(fmt, frame.rest))

    return run


_BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)


def parse_bam(content: bytes) -> Iterator[tuple[str, str, str | None]]:
    """Records of a BAM file (its blocks are gzip members); null qualities where they are left out."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if data[:4] != b"BAM\x01":
        raise FormatError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    for _ in range(n_ref):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    while at < len(data):
        size, _, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", data, at)
        if flag & 1:
            raise FormatError("BAM files of paired reads aren't read")
        name = data[at + 36 : at + 36 + l_name - 1].decode("ascii")
        s = at + 36 + l_name + 4 * n_cigar
        packed = np.frombuffer(data, np.uint8, (l_seq + 1) // 2, s)
        seq = _BASES[np.stack([packed >> 4, packed & 15], 1).ravel()[:l_seq]].tobytes().decode("ascii")
        q = np.frombuffer(data, np.uint8, l_seq, s + (l_seq + 1) // 2)
        yield name, seq, None if l_seq and q[0] == 255 else (q + 33).astype(np.uint8).tobytes().decode("ascii")
        at += 4 + size


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a path or glob with their sizes, in order of path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    out = []
    for s in found:
        for x in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            if x.isFile() and not x.getPath().getName().startswith(("_", ".")):
                out.append((x.getPath().toString(), x.getLen()))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def _opened(head: bytes, path: str):
    """A decompressor that can be fed piece by piece (as often as there are members) for a file with these first bytes; None: plain."""
    if head[:2] == b"\x1f\x8b" or path.endswith(".gz"):
        return lambda: zlib.decompressobj(31)
    if path.endswith(".zst"):
        import zstandard

        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return bz2.BZ2Decompressor if path.endswith(".bz2") else lzma.LZMADecompressor if path.endswith(".xz") else None


def head_bytes(spark: SparkSession, path: str, n: int = 4) -> bytes:
    """The first bytes of a file once decompressed; as much is fetched as it takes, a block or empty members before them included."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    out, make, coder = b"", None, None
    try:
        raw = bytes(stream.readNBytes(1 << 16))
        make = _opened(raw, path)
        if make is None:
            return raw[:n]
        while raw and len(out) < n:
            coder = coder or make()
            out += coder.decompress(raw)
            raw = coder.unused_data if coder.eof else b""
            coder = None if coder.eof else coder
            raw = raw or bytes(stream.readNBytes(1 << 16))
    finally:
        stream.close()
    return out[:n]


def format_of(spark: SparkSession, paths: list[str]) -> str:
    """By the first file that holds anything once decompressed: an empty one, such as an empty part of a folder, may be of any format."""
    return sniff(next((h for h in (head_bytes(spark, p) for p in paths) if h), b""))


def _scan(spark: SparkSession, path: str, fmt: str | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None, bool]:
    """Records (f, start, i, ...); a row a file (f, ord) if there are several; a row a block (f, start, n) where that takes no framing; whether ``i`` is gapless."""
    files = _files(spark, path)
    fmt = fmt or format_of(spark, [p for p, n in files if n])
    order, totals = spark.createDataFrame([(p, k) for k, (p, _) in enumerate(files)], "path string, ord long"), None
    # the sources' metadata and the listing write local paths in two ways; a plus is itself in both
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    raw = spark.read.format("binaryFile").load([p for p, _ in files])
    if fmt == "bam" or any(p.endswith(WHOLE_CODECS) for p, _ in files):
        whole, paths = True, raw.select(F.xxhash64("path").alias("f"), bare(F.col("path")).alias("p"))
        framed = raw.select(F.xxhash64("path").alias("f"), "path", "content").mapInArrow(_whole_files(fmt), SCHEMA)
    else:
        # only names are read here, not contents
        paths = raw.select(F.xxhash64("_metadata.file_path").alias("f"), bare(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).alias("p"))
        text = spark.read.option("lineSep", "\n").text([p for p, _ in files])
        lines = text.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("start"), "value")
        most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        whole = all(p.endswith(".gz") for p, _ in files) or (sum(n for _, n in files) <= most and not any(p.endswith(".bz2") for p, _ in files) and _one_split(spark, files, most))
        framed = lines.mapInArrow(_inner(fmt, whole), SCHEMA)
        if whole:
            totals = lines.mapInArrow(_totals(fmt), TOTALS)
        else:
            gathered = _over_edges(lines, fmt)
            framed = framed.unionByName(gathered.where(F.size("lines") > 0).mapInArrow(_across(fmt), SCHEMA))
            totals = gathered.mapInArrow(_totals_over_edges(fmt), TOTALS)
    if len(files) == 1:
        return framed, None, totals, whole
    return framed, paths.join(F.broadcast(order.select(bare(F.col("path")).alias("p"), "ord")), "p").select("f", "ord"), totals, False


def _with_order(df: DataFrame, order: DataFrame | None) -> DataFrame:
    """The number of each row's file; the table of files has been listed on the driver and so is small enough for every task."""
    return df.withColumn("ord", F.lit(0).cast("long")) if order is None else df.join(F.broadcast(order), "f")


def read_reads(spark: SparkSession, path: str, fmt: str | None = None, keep_place: bool = False) -> DataFrame:
    """rid, name, sequence, qualities of a file, a folder or a glob; the format is taken from the content of the first file that has any."""
    framed, order, _, dense = _scan(spark, path, fmt)
    rid = F.shiftleft("ord", PLACE_BITS) + F.col("start") + F.col("i")
    out = _with_order(framed, order).select(rid.alias("rid"), "name", "sequence", "qualities", *(["ord", "start", "i"] if keep_place else []))
    return out.withMetadata("rid", {"dense": dense})


def read_numbered(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """As ``read_reads``, with gapless ``rid``: 0 for the first record and so on.

    Nothing but a row a block is shuffled or sent to all tasks: its number of
    records, and how many there are before it.
    """
    framed, order, totals, dense = _scan(spark, path, fmt)
    if dense:
        return framed.select(F.col("i").alias("rid"), "name", "sequence", "qualities")
    if totals is None:
        totals = framed.groupBy("f", "start").agg(F.count("*").alias("n"))
    base = _before(_with_order(totals, order)).select("f", "start", "base")
    return framed.join(F.broadcast(base), ["f", "start"]).select((F.col("base") + F.col("i")).alias("rid"), "name", "sequence", "qualities")


def _before(counts: DataFrame) -> DataFrame:
    """``base``: the sum of ``n`` over the blocks before each, a row a block."""
    before = Window.orderBy("ord", "start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _bytes(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def _one_split(spark: SparkSession, files: list[tuple[str, int]], most: int) -> bool:
    """Whether Spark's split size, which shrinks with the cores there are, leaves every file whole."""
    cost = _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    cores = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    split = min(most, max(cost, sum(n + cost for _, n in files) // cores))
    return all(n <= split or p.endswith(".gz") for p, n in files)


def _over_edges(lines: DataFrame, fmt: str) -> DataFrame:
    """Lines of records that go over the edges of blocks (f, start, n, lines): a few a block are gathered, in order of blocks; ``n`` records lie before them in the block."""
    edges = lines.mapInArrow(_edges(fmt), EDGES)
    upto = Window.partitionBy("f").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = edges.withColumn("from", F.max(F.when((F.col("kind") == 1) | (F.col("start") == 0), F.col("start"))).over(upto))
    return run.groupBy("f", F.col("from").alias("start")).agg(
        F.max(F.when(F.col("start") == F.col("from"), F.col("n"))).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "lines"))), lambda x: x["lines"])).alias("lines")
    )


def numbered(reads: DataFrame) -> DataFrame:
    """``rid`` made gapless: 0 for the first record and so on; ``reads`` has places (ord, start, i).

    The counts per block are summed in order, a row a block.
    """
    if reads.schema["rid"].metadata.get("dense"):
        return reads.drop("ord", "start", "i")
    base = _before(reads.groupBy("ord", "start").agg(F.count("*").alias("n"))).select("ord", "start", "base")
    return reads.join(F.broadcast(base), ["ord", "start"]).withColumn("rid", F.col("base") + F.col("i")).drop("ord", "start", "i", "base")


def names_match(a: Column, b: Column) -> Column:
    """Whether two headers have one id: up to the first white space, without a last 1, 2 or 3 if both have one."""
    a, b = (F.substring_index(F.substring_index(c, " ", 1), "\t", 1) for c in (a, b))
    digit = lambda c: F.right(c, F.lit(1)).isin("1", "2", "3")
    bare = lambda c: F.left(c, F.length(c) - 1)
    return (a == b) | (digit(a) & digit(b) & (bare(a) == bare(b)))


def _checked_pairs(df: DataFrame) -> DataFrame:
    """rid, name1 ... qualities2; fails where a mate is missing or has another id."""
    missing = F.col("name1").isNull() | F.col("name2").isNull()
    fine = (
        F.when(missing, F.raise_error(F.lit("the inputs of paired reads differ in their numbers of reads")).cast("string"))
        .when(~names_match(F.col("name1"), F.col("name2")), F.raise_error(F.concat(F.lit("reads are improperly paired: "), "name1", F.lit(" and "), "name2")).cast("string"))
        .otherwise(F.col("name1"))
    )
    return df.withColumn("name1", fine).select("rid", *[f"{c}{k}" for k in (1, 2) for c in ("name", "sequence", "qualities")])


def read_pairs(spark: SparkSession, path1: str, path2: str, fmt: str | None = None) -> DataFrame:
    """Two files in lock-step: rid, name1, sequence1, qualities1, name2, sequence2, qualities2."""
    sides = []
    for k, p in ((1, path1), (2, path2)):
        df = read_numbered(spark, p, fmt)
        sides.append(df.select("rid", *[F.col(c).alias(f"{c}{k}") for c in ("name", "sequence", "qualities")]))
    return _checked_pairs(sides[0].join(sides[1], "rid", "full"))


def read_interleaved(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One file in which first and second reads alternate."""
    return pair_up(read_numbered(spark, path, fmt))


def pair_up(reads: DataFrame) -> DataFrame:
    """Reads of gapless ``rid``, two and two: each is sorted once and sees the next one of its pair only."""
    of = Window.partitionBy(F.expr("rid div 2")).orderBy("rid")
    row, second = F.struct("rid", "name", "sequence", "qualities"), F.pmod("rid", F.lit(2)) == 1
    both = reads.select("rid", row.alias("row")).select("rid", "row", F.lag("rid").over(of).alias("last"), F.lead("row").over(of).alias("next")).where("last is null")
    one = F.when(~second, F.col("row"))
    two = F.when(second, F.col("row")).when(F.col("next")["rid"] == F.col("rid") + 1, F.col("next"))
    both = both.select(F.expr("rid div 2").alias("rid"), one.alias("r1"), two.alias("r2"))
    return _checked_pairs(both.select("rid", *[F.col(f"r{k}")[c].alias(f"{c}{k}") for k in (1, 2) for c in ("name", "sequence", "qualities")]))
