"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and
    all runs in this one process (tests) a temporary folder takes its place.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The committed files survive the loss of any executor, and what follows
    doesn't compute ``df`` again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        drop_path(df.sparkSession, df.written_to)


#: What worker processes keep between tasks: a cached function for each name.
CACHES: dict = {}


def keep_only(name: str | None) -> None:
    """In a worker: let go of what other operators than ``name`` keep, as workers outlive stages."""
    others = [f for n, f in CACHES.items() if n != name and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """In a worker: hand memory that is free to the system; Arrow and the C library keep it otherwise, and idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` (batches to batches) that hands its memory back at its end."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def hadoop_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    if not hadoop_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def append_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that appears whole, by a rename; False if there is one of that name, which is never replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = to.getFileSystem(conf)
    stream = fs.create(part, False)
    stream.write(text.encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    try:  # without an option to overwrite
        context.rename(fs.makeQualified(part), fs.makeQualified(to), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        fs.delete(part, False)
        if fs.exists(to):
            return False
        raise
    return True


def n_words(text: Column) -> Column:
    """Number of words as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_groups(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of ``values`` of about ``limit`` bytes, each of one value at least."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)
