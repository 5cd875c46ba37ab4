"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) to (id, component), the smallest id reachable; only ids with an edge.

    Alternates large-star and small-star steps: every node hands its larger
    (or smaller) neighbours to the least one.  A node's least neighbour comes
    from a grouped minimum and is joined back, so a node with very many
    neighbours is summed before the shuffle and its join can be split.  The
    result of each round is written to the shared folder.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state, before = _state(e), e
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = before, materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        before = e
        release(old)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
