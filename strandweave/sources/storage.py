"""Folders that all executors share, and delivering written folders as files."""

from __future__ import annotations

import lzma
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..operators import sinks


def session(cores: int = 0) -> SparkSession:
    """The running session, or a local one."""
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.master(f"local[{cores or '*'}]").config("spark.ui.enabled", "false").appName("strandweave").getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs in this process."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a sink's parts in their order."""
    p, fs = _fs(spark, folder)
    found = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((x.toString() for x in found if x.getName().startswith("part-")), key=lambda x: (len(x), x))


def chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of any file system."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        while some := stream.readNBytes(size):
            yield bytes(some)
    finally:
        stream.close()


def write_chunks(spark: SparkSession, path: str, some: Iterable[bytes]) -> None:
    p, fs = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        for c in some:
            stream.write(bytearray(c))
    finally:
        stream.close()


def _packed(kind: str, level: int | None, some: Iterable[bytes]) -> Iterator[bytes]:
    if kind == "xz":
        coder = lzma.LZMACompressor(preset=6 if level is None else level)
    else:
        import zstandard

        coder = zstandard.ZstdCompressor(level=3 if level is None else level).compressobj()
    for c in some:
        yield coder.compress(c)
    yield coder.flush()


def deliver(spark: SparkSession, folder: str, target: str, sharded: bool = False, level: int | None = None) -> None:
    """Moves a sink's parts to ``target``: a folder (sharded), one file, or the standard output (``-``)."""
    if sharded and target != "-":
        src, fs = _fs(spark, folder)
        dst, _ = _fs(spark, target)
        fs.delete(dst, True)
        if not (fs.exists(src) and fs.rename(src, dst)):
            fs.mkdirs(dst)
        return
    if target == "-" or target.endswith((".xz", ".zst")):
        some = (c for part in parts(spark, folder) for c in chunks(spark, part))
        if target == "-":
            for c in some:
                sys.stdout.buffer.write(c)
            sys.stdout.flush()
        else:
            write_chunks(spark, target, _packed(target.rpartition(".")[2], level, some))
    else:
        sinks.gather(spark, parts(spark, folder), target, level)
    # local files have a checksum file beside them
    if target != "-":
        p, fs = _fs(spark, target)
        side = spark._jvm.org.apache.hadoop.fs.Path(p.getParent() or ".", f".{p.getName()}.crc")
        if fs.exists(side):
            fs.delete(side, False)
