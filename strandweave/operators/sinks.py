"""What a run writes: reads by fate and demultiplexing, and side outputs, in one pass and one write.

Every line of output is a row (sink, text); a row of the result makes one row
for each sink that it goes to.  One write, partitioned by sink and ordered by
``rid``, makes all files; ``gather`` then joins the parts of a sink to one file
where a single file is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import piece, reverse_complement
from .matching import Cutter, name_of, rest_text, wildcard_text


def record(p: str, fasta: bool) -> Column:
    """A read as text, without the last line's end."""
    name, seq, qual = (F.col(f"{p}{c}") for c in ("name", "sequence", "qualities"))
    if fasta:
        return F.concat(F.lit(">"), name, F.lit("\n"), seq)
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def rest_line(p: str) -> Column:
    """Rest and name; null where there is no match or nothing is left."""
    rest = rest_text(p)
    return F.when(F.length(rest) > 0, F.concat(rest, F.lit(" "), F.col(f"{p}name")))


def wildcard_line(p: str, cutter: Cutter) -> Column:
    return F.when(F.size(f"{p}matches") > 0, F.concat(wildcard_text(p, cutter), F.lit(" "), F.col(f"{p}name")))


def info_lines(p: str, names: list[str], linked: list[bool]) -> Column:
    """Lines of tab-separated fields: one for each part of a match, or one for a read without."""
    m, rc, original = F.col(f"{p}matches"), F.col(f"{p}is_rc"), F.col(f"{p}original")
    flag = F.when(rc.isNull(), "").when(rc, "1").otherwise("0")
    turned = F.coalesce(rc, F.lit(False))
    seq = F.when(turned, reverse_complement(original["sequence"])).otherwise(original["sequence"])
    qual = F.coalesce(F.when(turned, F.reverse(original["qualities"])).otherwise(original["qualities"]), F.lit(""))
    linked_ = F.array(*[F.lit(x) for x in linked]) if linked else F.array(F.lit(False))

    def line(x: Column, i: Column) -> Column:
        # what is left after the parts before this one, in places of the original read
        earlier = F.exists(F.slice(m, F.lit(1), i), lambda y: y["side"] == 1)
        start, stop = x["offset"], F.when(earlier, x["offset"] + x["size"]).otherwise(F.length(seq))
        a, b = F.least(start + x["rstart"], stop), F.least(start + x["rstop"], stop)
        cuts = ((start, a), (a, b), (b, stop))
        suffix = F.when(F.get(linked_, x["adapter"]), F.concat(F.lit(";"), (x["part"] + 1).cast("string"))).otherwise("")
        name = F.concat(name_of(x, names), suffix) if names else F.lit("")
        fields = [F.col(f"{p}name"), x["errors"].cast("string"), x["rstart"].cast("string"), x["rstop"].cast("string"), *[piece(seq, *c) for c in cuts], name, *[piece(qual, *c) for c in cuts], flag]
        return F.concat_ws("\t", *fields)

    none = F.concat_ws("\t", F.col(f"{p}name"), F.lit("-1"), F.col(f"{p}sequence"), F.coalesce(F.col(f"{p}qualities"), F.lit("")))
    return F.when(F.size(m) > 0, F.transform(m, line)).otherwise(F.array(none))


def routed(rows: list[tuple[Column, Column]]) -> Column:
    """Array of (sink, text) from (sink, text or array of texts); a null sink or text makes no row."""

    def lines(sink: Column, text: Column) -> Column:
        some = F.when(sink.isNotNull(), text).otherwise(F.array().cast("array<string>"))
        return F.transform(some, lambda t: F.struct(sink.alias("sink"), t.alias("text")))

    return F.filter(F.flatten(F.array(*[lines(*r) for r in rows])), lambda x: x["text"].isNotNull())


def write_sinks(result: DataFrame, rows: list[tuple[Column, Column]], path: str, ordered: bool = True, compression: str | None = None) -> None:
    """Writes ``path/sink=<name>/part-*``; rows: (sink, array of texts), in the order of their lines."""
    if ordered:
        result = result.repartitionByRange("rid").sortWithinPartitions("rid")
    lines = result.select("rid", F.posexplode(routed(rows)).alias("pos", "line")).select("rid", "pos", "line.sink", "line.text")
    lines = lines.sortWithinPartitions("sink", "rid", "pos") if ordered else lines
    writer = lines.select("sink", "text").write.partitionBy("sink").option("lineSep", "\n")
    (writer.option("compression", compression) if compression else writer).text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def gather(spark: SparkSession, parts: list[str], target: str, level: int | None = None) -> None:
    """Joins a sink's parts in their order to one file; a sink without parts gives an empty file.

    The bytes are copied between streams of the file system.  A ``.gz`` or
    ``.bz2`` target is compressed on the way, gzip by ``level``.
    """
    jvm, conf = spark._jvm, spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    if level is not None:
        levels = jvm.org.apache.hadoop.io.compress.zlib.ZlibCompressor.CompressionLevel
        conf.setEnum("zlib.compress.level", next(x for x in levels.values() if x.compressionLevel() == level))
    dst, out_fs = _fs(spark, target)
    out = out_fs.create(dst, True)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(dst)
    if codec is not None:
        out = codec.createOutputStream(out)
    try:
        for part in parts:
            q, fs = _fs(spark, part)
            stream = fs.open(q)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()
