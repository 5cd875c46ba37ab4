"""A training corpus from ``documents``: language, lines, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; its result is written as Parquet and read again as the next one's docs.

In all stages a row is a document: rows that share an id but not a text are
several, a null id is no copy of another, and an empty table gives an empty one.
Columns besides those of documents pass through; their names must not begin with
two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, langid, linededup, mixing, neardup
from strandweave.llm.common import documents, materialise, release

#: Documents in which no language has this share of the words are rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or without letters, and those without a prevailing language.

    Learns from the labelled rows that op3 learns from; without any label all go.
    Rows that repeat are judged alike.
    """
    model = langid.train(docs, learnable=langid.remainder() != 2)
    return docs.where(langid.accepted(docs, model, LEAST_SCORE))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines seen before.

    A document that loses lines and has none of full length left goes, unless
    one of its shorter lines is in no earlier document (by id and hash of the
    text): what is left of a copy goes, and every line stays where it is first.
    A null text has no lines and stays; a null id sorts first; rows of one id and
    text are one document here and lose the same lines.
    """
    gone = linededup.removed_lines(docs)
    texts = docs.select("doc_id", F.xxhash64("text").alias("dk"), F.split("text", "\n").alias("ls"))
    line = F.btrim("line", F.lit(linededup.SPACE)).alias("l")
    short = texts.select("doc_id", "dk", F.explode("ls").alias("line")).select("doc_id", "dk", line)
    short = short.where((F.length("l") > 0) & (F.length("l") < linededup.MIN_CHARS))
    first = short.groupBy("l").agg(F.min(F.struct("doc_id", "dk")).alias("o")).select("o.doc_id", "o.dk").distinct()
    full = F.size(F.filter("ls", lambda x: F.length(F.btrim(x, F.lit(linededup.SPACE))) >= linededup.MIN_CHARS))
    sizes = texts.select("doc_id", "dk", full.alias("n")).distinct()
    # decided by numbers of lines, so that the reduced texts needn't be written before the result
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.dk") == F.col(f"{b}.dk"))
    bare = gone.alias("g").join(sizes.alias("s").hint("merge"), same("g", "s")).where(F.size("gone") == F.col("n")).select("g.doc_id", "g.dk")
    goes = bare.alias("b").join(first.alias("f").hint("merge"), same("b", "f"), "left_anti").select("doc_id", "dk").withColumn("goes", F.lit(True))
    marked = gone.alias("g").join(goes.alias("b").hint("merge"), same("g", "b"), "left").select("g.doc_id", "g.dk", F.when(F.col("goes").isNull(), F.col("gone")).alias("gone"))
    marked = materialise(marked, "lines-marked")
    release(gone)
    out = linededup.without_lines(docs, marked)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id, then hash of the text, of each group; rows with null id stay.

    Rows of one id with several texts are several documents; those of one id and
    text are one, the first by language and source.
    """
    from pyspark.sql import Window

    keyed = docs.withColumn("__dk", F.xxhash64("text"))
    node = F.xxhash64("doc_id", F.lit("near"), "text")
    nodes = keyed.where("doc_id is not null").select("doc_id", "__dk", "text", node.alias("__node"))
    found = neardup.near_duplicates(nodes, width=5, id_col="__node").select(F.col("doc_id").alias("__node"), F.col("component_id").alias("__g")).distinct()
    ids = nodes.select("doc_id", "__dk", "__node").distinct()
    least = ids.join(found.hint("merge"), "__node").groupBy("__g").agg(F.min(F.struct("doc_id", "__dk")).alias("__o"))
    kept = materialise(least.select(F.col("__o.doc_id").alias("doc_id"), F.col("__o.__dk").alias("__dk")), "near-kept")
    one = F.row_number().over(Window.partitionBy("doc_id", "__dk").orderBy("lang", "source"))
    rows = keyed.join(kept.hint("merge"), ["doc_id", "__dk"], "left_semi").withColumn("__one", one).where("__one = 1")
    return rows.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, once an epoch.

    A null source is one of its own, last in order; null and empty texts have no
    words to take and go.  Of rows of one id, source and text, each is taken for
    itself; the one in which a budget ends is cut after its last word taken.
    """
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, held against it by decoding; a null text has none, and every row stands alone."""
    return bpe.encode_rows(docs, ["doc_id", "lang", "source"])


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: The labels come from a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
