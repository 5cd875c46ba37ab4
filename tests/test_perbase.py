"""Running sums over batches against built-in expressions and known results."""

import random

import builtin_perbase as plain
import pytest
from pyspark.sql import functions as F

from strandweave.functions import perbase


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(11)
    rows = [(None, None), ("", ""), ("A", "!"), ("AAA", "~~~"), ("TTT", "###"), ("GGGGG", "IIIII"), ("AAAXA", "\u00e9II!~")]
    for n in [1, 2, 3, 4, 5, 7, 30, 60, 200] * 30:
        seq = "".join(rng.choice("ACGTNGg" if rng.random() < 0.5 else "AAAAT") for _ in range(n)) + "A" * rng.choice([0, 0, 2, 9])
        rows.append((seq, "".join(rng.choice("!#+5?IJ~" if i % 7 else "#") for i in range(len(seq)))))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, s string, q string").repartition(3)


@pytest.mark.parametrize(
    "name, columns, more",
    [("quality_start", "q", (15,)), ("quality_stop", "q", (20,)), ("quality_stop", "q", (20, 40)), ("nextseq_stop", "sq", (22,)), ("poly_a_start", "s", ()), ("poly_t_stop", "s", ()),
     ("expected_errors", "q", ()), ("too_many_expected_errors", "q", (2.5,)), ("too_high_average_error", "q", (0.05,))],
)
def test_against_built_in_expressions(reads, name, columns, more):
    got, want = (getattr(m, name)(*[F.col(c) for c in columns], *more) for m in (perbase, plain))
    bad = reads.where("s is not null").select("*", got.alias("got"), want.alias("want")).where(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert bad == []


def test_known_places(spark):
    q = spark.createDataFrame([("".join(chr(33 + x) for x in (42, 40, 26, 27, 8, 7, 11, 4, 2, 3)),)], "q string")
    assert q.select(perbase.quality_stop(F.col("q"), 10)).first()[0] == 4
    assert spark.createDataFrame([("A" * 3,), ("TAA",), ("CAAAAGAAA",)], "s string").select(perbase.poly_a_start(F.col("s")).alias("x")).collect() == [(0,), (3,), (1,)]


def test_nulls_stay(reads):
    none = reads.where("s is null")
    assert none.select(perbase.quality_stop(F.col("q"), 5), perbase.poly_a_start(F.col("s")), perbase.too_many_expected_errors(F.col("q"), 1)).first() == (None, None, None)
