"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Base statistics are counted inside each row.  For each (language, source) the
transformed statistic vectors get a minimum-covariance-determinant estimate:
from two starts (median and MAD; mean and covariance of all), concentration
steps keep the half of the vectors that lies nearest and estimate again; of the
two results the one with the smaller determinant counts.  A reweighting step
follows, and vectors beyond ``LIMIT`` in squared Mahalanobis distance are
rejected.

The vectors are whole numbers (thousandths) and sums are exact, so results
don't depend on the order of rows.  Quantiles come from counts per bin, summed
before the shuffle; no group is gathered in one task.  ``LEAST`` is added to
each scale, for statistics that are 0 in most documents: there the nearer half
has no spread at all, and without it one repeated window would be an outlier.
It is small enough that every statistic can reject by itself below the bounds of
the base rules.

Groups of fewer than ``MIN_GROUP`` vectors are pooled by language, then all
together; below ``MIN_FIT`` nothing is rejected.  Null language or source is a
value of its own; a null text has counts of 0 and fails the base rules.  Rows
that repeat are judged alike.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

P = 4
STEPS = 4
MIN_GROUP, MIN_FIT = 50, 10
#: 0.9999 and 0.975 quantiles of chi-squared with 4 degrees of freedom, and the
#: factor that makes the covariance of the nearer half that of a normal sample.
LIMIT, REWEIGHT, HALF_FACTOR = 23.5127, 11.1433, 2.109
#: Least scale of each statistic: log word length, root shares of symbols, of
#: repeated words, and of repeated lines (a tenth of the words counts as all).
LEAST = (0.02, 0.03, 0.1, 0.1)
SCALE = 1000
BINS = 16384
X = [f"x{i}" for i in range(P)]


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def base_counts(text: str) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column named.

    Repeated windows: 33 bits of each window's hash with its place in the low
    bits are sorted; windows whose bits agree with a neighbour's are compared
    by their words.
    """
    t = f"coalesce({text}, '')"
    keys = "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, w[i + 1], w[i + 2]), 31) | cast(i as bigint)))"
    alike = "(j > 0 and shiftright(ks[j - 1], 31) = shiftright(k, 31)) or (j < size(ks) - 1 and shiftright(ks[j + 1], 31) = shiftright(k, 31))"
    places = "transform(filter(ks, (k, j) -> " + alike + "), k -> cast(k & 2147483647 as int))"
    windows = "sort_array(transform(ps, p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) as g, p as p)))"
    twice = "sort_array(transform(filter(gs, (x, j) -> (j > 0 and gs[j - 1].g = x.g) or (j < size(gs) - 1 and gs[j + 1].g = x.g)), x -> x.p))"
    covered = "aggregate(ds, struct(0L as c, -3 as at), (a, p) -> struct(a.c + least(3, p - a.at) as c, p as at), a -> a.c)"
    repeat = _let(keys, "ks", _let(places, "ps", f"if(size(ps) = 0, 0L, {_let(windows, 'gs', _let(twice, 'ds', covered))})"))
    lines = _let(rf"filter(split({t}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')", "ls", "size(ls) - size(array_distinct(ls))")
    words = rf"regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+', 0)"
    of_words = _let(words, "w", f"struct(cast(size(w) as bigint) as n_words, {repeat} as n_repeat_words)")
    return F.expr(
        _let(
            of_words,
            "b",
            f"struct(b.n_words as n_words, cast(length(regexp_replace({t}, '[\\\\x20\\\\x09-\\\\x0D]+', '')) as bigint) as word_chars,"
            f" cast(length(regexp_replace({t}, '[^#*$%&|<>]+', '')) as bigint) as n_symbols, cast({lines} as bigint) as n_dup_lines, b.n_repeat_words as n_repeat_words)",
        )
    )


def vectors() -> list[Column]:
    """Transformed statistics in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.least(F.col("n_dup_lines") * 10 / n, F.lit(1.0)))]
    return [F.round(c * SCALE).cast("long").alias(x) for c, x in zip(raw, X)]


def _moments() -> list[Column]:
    return [F.count("*").alias("m"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i in range(P) for j in range(i + 1)]]


def _cholesky(df: DataFrame) -> DataFrame:
    """Columns c_i_j (covariance, lower half) to l_i_j and the determinant's root ``det``."""
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))  # noqa: B023
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return df.withColumn("det", reduce(lambda a, i: a * F.col(f"l_{i}_{i}"), range(1, P), F.col("l_0_0")))


PARAMS = [*[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)], "det"]


def _fit(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Moments to centre and Cholesky factor of the scaled covariance with the least scales added."""
    m = F.greatest(F.col("m"), F.lit(1)).cast("double")
    out = sums.select(
        *keys,
        *[(F.col(f"s_{x}") / m).alias(f"m_{i}") for i, x in enumerate(X)],
        *[((F.col(f"q_{i}_{j}") / m - F.col(f"s_{X[i]}") / m * (F.col(f"s_{X[j]}") / m)) * factor + (SCALE * LEAST[i]) ** 2 * (i == j)).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)],
    )
    return _cholesky(out).select(*keys, *PARAMS)


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2`` by forward substitution."""
    for i in range(P):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"y_{k}"), range(i), F.col(X[i]) - F.col(f"m_{i}"))  # noqa: B023
        df = df.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", reduce(lambda a, i: a + F.col(f"y_{i}") * F.col(f"y_{i}"), range(1, P), F.col("y_0") * F.col("y_0"))).drop(*[f"y_{i}" for i in range(P)])


def _at_half(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, cut: the least value that half of a group's rows don't exceed; rows are counted per value first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("r", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return run.where(F.col("r") * 2 >= F.col("t")).groupBy(*keys).agg(F.min(value).alias("cut"))


def mcd(rows: DataFrame) -> DataFrame:
    """rows (g, x0..) to (g, n, centre and factor) after concentration and reweighting."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    # start 0: medians and median absolute deviations
    long = rows.select("g", F.posexplode(F.array(*X)).alias("j", "v"))
    medians = materialise(_at_half(long, ["g", "j"], "v").withColumnRenamed("cut", "med"), "mcd-medians")
    mads = _at_half(long.join(medians, ["g", "j"]).select("g", "j", F.abs(F.col("v") - F.col("med")).alias("v")), ["g", "j"], "v")
    wide = medians.join(mads, ["g", "j"]).groupBy("g").agg(
        *[F.max(F.when(F.col("j") == i, F.col("med"))).cast("double").alias(f"m_{i}") for i in range(P)], *[F.max(F.when(F.col("j") == i, F.col("cut"))).cast("double").alias(f"d_{i}") for i in range(P)]
    )
    zero = [((F.col(f"d_{i}") * 1.4826) ** 2 + (SCALE * LEAST[i]) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    one = _cholesky(wide.select("g", *[f"m_{i}" for i in range(P)], *zero)).select("g", F.lit(0).alias("start"), *PARAMS)
    two = _fit(rows.groupBy("g").agg(*_moments()), ["g"], 1.0).select("g", F.lit(1).alias("start"), *PARAMS)
    fits = materialise(one.unionByName(two), "mcd-starts")
    for _ in range(STEPS):
        near = _distance(rows.join(fits, "g")).withColumn("bin", F.least(F.col("d2") * 64, F.lit(float(BINS))).cast("int")).select("g", "start", "bin", *X)
        cuts = _at_half(near, ["g", "start"], "bin")
        fits = materialise(_fit(near.join(cuts, ["g", "start"]).where("bin <= cut").groupBy("g", "start").agg(*_moments()), ["g", "start"], HALF_FACTOR), "mcd-step")
    best = fits.groupBy("g").agg(F.min_by(F.struct(*PARAMS), F.struct("det", "start")).alias("p")).select("g", "p.*")
    inside = _distance(rows.join(best, "g")).where(F.col("d2") <= REWEIGHT)
    final = _fit(inside.groupBy("g").agg(*_moments()), ["g"], 1.0)
    return materialise(final.join(sizes, "g"), "mcd-final")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, distance (null where no estimate was held against it)."""
    counted = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), base_counts(f"`{text_col}`").alias("b")).select("doc_id", "lang", "source", "b.*")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = materialise(counted.withColumn("base_failed", failed).select("*", *vectors()), "outlier-stats")
    passed = stats.where("not base_failed")
    by = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.struct(F.lit("own").alias("level"), F.col("lang"), F.col("source"))
    pool = F.struct(F.lit("lang").alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source"))
    rest = F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    pooled = Window.partitionBy("lang")
    groups = by.withColumn("small", F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)).over(pooled)).select(
        "lang", "source", F.to_json(F.when(F.col("n") >= MIN_GROUP, own).when(F.col("small") >= MIN_GROUP, pool).otherwise(rest), {"ignoreNullFields": "false"}).alias("g")
    )
    groups = materialise(groups, "outlier-groups")
    s, q = stats.alias("s"), groups.alias("q")
    same = F.col("s.lang").eqNullSafe(F.col("q.lang")) & F.col("s.source").eqNullSafe(F.col("q.source"))
    rows = materialise(s.where("not base_failed").join(q, same).select("s.doc_id", "g", *[f"s.{x}" for x in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *X]]), "outlier-rows")
    fits = mcd(rows.select("g", *X))
    held = _distance(rows.join(fits, "g", "left"))
    bad = (F.col("n") >= MIN_FIT) & (F.col("d2") > LIMIT)
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = held.select(*keep, (~F.coalesce(bad, F.lit(False))).alias("kept"), F.round("d2", 6).alias("distance"))
    return good.unionByName(stats.where("base_failed").select(*keep, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
