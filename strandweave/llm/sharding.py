"""Shards of near-equal bytes by sampled splitters.

Records are ordered by the key (hash of the text, hash of the id), so equal
texts lie side by side.  A size-weighted sample of keys gives quantile
boundaries; the records of each range are summed exactly; ranges that hold more
than twice their share (one text with very many copies) are subdivided by the
second half of the key.  Exact prefix sums over the ranges then place every
record: shard ``s`` takes the records whose middle byte falls into the s-th
part of all bytes, so that a shard differs from the mean by less than the
longest record.

Nulls: a null text counts as empty (16 bytes of overhead remain); a null id is
hashed as such.  Rows that repeat are placed one by one.  An empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Bytes of a range, unless there would be fewer than LEAST_RANGES; keys drawn a range.
RANGE_BYTES, LEAST_RANGES, DRAWS = 1 << 30, 1024, 32


def boundaries(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 distinct keys that cut the weighted sample into n equal parts."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, cum = keys[order], np.cumsum(weights[order])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, n) / n)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def assign_shards(
    df: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int | None = None,
    draws: int | None = None,
) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, grown_shard.

    The number of ranges, each sorted in a task, grows with all bytes (about a
    GB each), and so do ``draws``, the expected number of sampled keys.  These
    and sums per range (at most 3 * ``ranges`` rows) are all that reaches the
    driver: for 100 TB about 3 million keys and 300,000 sums.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("shard"), F.col(id_col)).alias("h2"),
        ),
        "shard-keys",
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = ranges or max(LEAST_RANGES, -(-total // RANGE_BYTES))
    draws = draws or DRAWS * ranges
    # the draw is by key, so rows that repeat count as one with their summed size
    weighed = keys.groupBy("h1", "h2").agg(F.sum("size").alias("w"))
    u = F.pmod(F.xxhash64(F.lit("draw"), "h1", "h2"), F.lit(1 << 40)) / float(1 << 40)
    unit = max(total, 1) / draws
    drawn = weighed.where(u < F.col("w") / unit).select("h1", "w").toPandas()
    cuts = boundaries(drawn["h1"].to_numpy(np.int64), np.maximum(drawn["w"].to_numpy(float), unit), ranges)

    @F.pandas_udf("int")
    def range_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, h.to_numpy(np.int64), side="right").astype(np.int32))

    ranged = keys.withColumn("rng", range_of("h1"))
    share = max(total, 1) / ranges
    sums = ranged.groupBy("rng").agg(F.sum("size").alias("bytes")).collect()
    over = {r["rng"]: int(-(-r["bytes"] // share)) for r in sums if r["bytes"] > 2 * share}
    parts = spark.createDataFrame(list(over.items()) or [(-1, 1)], "rng int, parts int")
    frac = F.pmod(F.xxhash64(F.lit("part"), "h2"), F.lit(1 << 30)).cast("long")
    celled = ranged.join(F.broadcast(parts), "rng", "left").withColumn(
        "sub", F.coalesce((frac * F.col("parts") / F.lit(1 << 30)).cast("int"), F.lit(0))
    )
    cells = sorted(tuple(r) for r in celled.groupBy("rng", "sub").agg(F.sum("size"), F.count("*")).collect())
    base, b, n = [], 0, 0
    for rng, sub, size, count in cells:
        base.append((rng, sub, b, n))
        b, n = b + size, n + count
    base_df = spark.createDataFrame(base or [(-1, 0, 0, 0)], "rng int, sub int, b0 long, n0 long")
    w = Window.partitionBy("rng", "sub").orderBy("h1", "h2", "doc_id", "size")
    # twice the middle byte, in whole numbers
    middle = (F.col("b0") + F.col("run") - F.col("size")) * 2 + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(2 * max(total, 1)).cast("decimal(20,0)")).cast("int"))
    placed = materialise(
        celled.withColumn("run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rn", F.row_number().over(w))
        .join(F.broadcast(base_df), ["rng", "sub"])
        .select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("rn") - 1).alias("at")),
        "shard-placed",
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
