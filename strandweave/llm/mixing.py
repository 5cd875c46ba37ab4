"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents are
ordered by that key (range-sorted: the key's first hex digits are its range, so
many of them that a range has about ``RANGE_ROWS`` rows at most),
word counts are summed per range and then prefix-summed, and each source is cut
at its exact budget.  Budgets above a source's size repeat whole epochs first.

Targets share the sum of all sizes by weight.  A target stops at ``max_epochs``
times its source's size and the excess goes to the others by weight until none
is above.  The document that a budget ends in is taken in part (its first
words), so each source's taken words are its target rounded down.

Nulls: a null source is a source of its own, last in order; a null text has
size 0; a null id takes the key of the empty string.  Repeated rows are taken
one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, n_words

#: Rows that a range, which one task sorts where a budget ends in it, should have at most; hex digits that make a range at least.
RANGE_ROWS, LEAST_DIGITS = 1 << 18, 3


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: one row per source (source, source_size); adds weight and target.

    Filling runs over sources ordered by size a weight: those before the first
    whose share fits are stopped at their limit, the rest share what is left.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rn"))
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rn") - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("rn", F.row_number().over(name)).withColumn("weight", pick)
    run = (
        ranked.withColumn("capped", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - max_epochs * F.col("capped")).cast("double") / F.col("rest").cast("double"))
    )
    fits = run.where(F.col("level") * F.col("weight") <= F.lit(float(max_epochs)) * F.col("source_size")).agg(F.min(F.struct("capped", "rn", "level")).alias("first"))
    level = F.coalesce(F.col("first.level"), F.lit(0.0))
    return ranked.crossJoin(F.broadcast(fits.select(level.alias("level")))).select(
        "source", "source_size", "weight", F.least(F.lit(float(max_epochs)) * F.col("source_size"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, part, taken.

    ``epochs`` whole passes and then the first ``part`` words; taken is their sum in words.
    """
    return _decide(df, id_col, source_col, text_col, max_epochs, weights).drop("dk")


def _decide(df: DataFrame, id_col: str, source_col: str, text_col: str, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``mix`` with dk, the hash of the text, by which those of one id are told apart."""
    sized = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
            F.xxhash64(F.col(text_col)).alias("dk"),
        ),
        "mix-sizes",
    )
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    sized = sized.withColumn("rng", F.substring("key", 1, digits))
    per_range = sized.groupBy("source", "rng").agg(F.sum("size").alias("words"))
    per_range = materialise(per_range, "mix-ranges")
    sources = source_targets(per_range.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialise(
        sources.withColumn("epochs", whole).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-plan"
    )
    p = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, 0)
    # where each source's budget ends: the first range whose prefix sum passes it
    ends = (
        per_range.withColumn("upto", F.sum("words").over(p))
        .alias("r")
        .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .where(F.col("upto") > F.col("budget"))
        .groupBy("p.source")
        .agg(F.min(F.struct("rng", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    )
    plan = materialise(
        plan.alias("p")
        .join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .select("p.*", F.col("end.rng").alias("end_rng"), F.col("end.before").alias("before")),
        "mix-ends",
    )
    rows = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.epochs", "p.budget", "p.end_rng", "p.before")
    inner = Window.partitionBy("source", "rng").orderBy("key", "doc_id", "size", "dk").rowsBetween(Window.unboundedPreceding, 0)
    at_end = rows.where(F.col("rng") == F.col("end_rng")).withColumn("start", F.col("before") + F.sum("size").over(inner) - F.col("size"))
    cut = at_end.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("start")))).drop("start")
    # sources of size 0 have no end; their documents have nothing to take
    others = rows.where(F.coalesce(F.col("rng") != F.col("end_rng"), F.lit(True))).withColumn(
        "part", F.when(F.coalesce(F.col("rng") < F.col("end_rng"), F.lit(False)), F.col("size")).otherwise(0)
    )
    return others.unionByName(cut).select(
        "doc_id", "dk", "source", "size", "source_size", "target", "epochs", F.col("part").cast("long").alias("part"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    )


def apply_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` as the mix takes them: once an epoch, and the one a budget ends in cut after its last word taken.

    Each row has a decision of its own; those of rows with equal id, source and
    text differ in ``part`` at most and are dealt out by the other columns' hash.
    """
    got = _decide(df, id_col, source_col, text_col, **options)
    # one string as the key, nulls included, so that the window and the join share a shuffle
    named = lambda i, s, k: F.to_json(F.struct(i.alias("i"), s.alias("s"), k.alias("k")), {"ignoreNullFields": "false"})
    got = got.groupBy(named(F.col("doc_id"), F.col("source"), F.col("dk")).alias("whose")).agg(F.max("epochs").alias("epochs"), F.max("size").alias("size"), F.sum("part").alias("parts"))
    got = materialise(got.where("size > 0 and (epochs > 0 or parts > 0)"), "mix-taken")
    who = named(F.col(id_col), F.col(source_col), F.xxhash64(F.col(text_col))).alias("who")
    rows = df.select(F.struct("*").alias("row"), who, F.col(text_col).alias("text"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("who").orderBy(F.xxhash64("row"))) - 1)
    each = rows.join(got.hint("merge"), F.col("who") == F.col("whose"))
    # whole parts first, then the one in which the budget ends
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("parts") - F.col("at") * F.col("size")))
    each = each.withColumn("part", part)
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = each.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    text = F.when((F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size")), head).otherwise(F.col("text"))
    return each.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s),
w AS (SELECT *, (rn - 1) % 3 + 1 AS weight FROM r),
f AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(weight) OVER (ORDER BY source_size / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
         sum(source_size) OVER ()::BIGINT AS total
  FROM w),
l AS (SELECT *, (total - 3 * capped)::DOUBLE / rest::DOUBLE AS level FROM f),
one AS (SELECT level FROM l WHERE level * weight <= 3.0::DOUBLE * source_size ORDER BY capped, rn LIMIT 1),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM one) * weight) AS target FROM w),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS start
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - start)))::BIGINT AS taken FROM p
"""
