"""Trimming of reads that keep coming.

Every step works on one read or pair, so a stream needs no state and no
watermark: each micro-batch is trimmed, its fates are written by partition, and
its counts are kept under the batch's number, so that a batch that is replayed
after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.statistics import KEYS, Statistics, counts
from ..plans.trim import TrimSpec, trim

READS = "rid long, name string, sequence string, qualities string"
PAIRS = "rid long, " + ", ".join(f"{c}{k} string" for k in (1, 2) for c in ("name", "sequence", "qualities"))
COUNTS = "kind string, read int, a int, b int, c int, d int, s string, n long"


def stream_of(spark: SparkSession, path: str, paired: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of reads or pairs as they arrive in a folder."""
    return spark.readStream.schema(PAIRS if paired else READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def trim_stream(reads: DataFrame, spec: TrimSpec, path: str, checkpoint: str, start: Callable | None = None) -> StreamingQuery:
    """Writes ``path/reads/batch=<n>`` (with a column fate) and ``path/counts/batch=<n>``.

    A folder is written as a whole and replaced if its batch comes again.
    ``start`` may change the writer, for instance its trigger.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = trim(batch, spec).persist()
        try:
            prefixes = [p for p, _ in spec.sides]
            kept = result.select("rid", "fate", "demux", *[f"{p}{c}" for p in prefixes for c in ("name", "sequence", "qualities")])
            kept.write.mode("overwrite").parquet(f"{path}/reads/batch={number}")
            counts(result, spec).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        finally:
            result.unpersist()

    writer = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (start(writer) if start else writer).start()


def statistics(spark: SparkSession, spec: TrimSpec, path: str) -> Statistics:
    """Figures of all batches so far."""
    got = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    return Statistics([tuple(r) for r in got.groupBy(*KEYS).agg(F.sum("n").alias("n")).collect()], spec)
