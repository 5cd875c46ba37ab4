"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line (without white space at its ends, ``min_chars`` characters or more) goes
if an earlier one, by document and place, is equal or within one edit
(insertion, deletion or substitution of a character); shorter lines stay.

Equal lines are collapsed by hash.  Of two lines within one edit, one holds an
unchanged half of the shorter; lines that share no half-line key with another
are left out first.  Of the rest, the variants with one character deleted are
emitted as hashed keys, for each segment of ``SEGMENT`` characters outside of
which a line equals another.  Lines that give the same variant by deleting the
same place are all within one edit of each other, and a line that is another's
variant is within one edit of it; so in each group of equal keys it is enough to
hold every member against the earliest (and a full line against the earliest of
its extensions), which takes as many comparisons as there are members.  Each
comparison is verified by edit distance.

Nulls: a null text stays null; a null id sorts first.  Rows of one id and one
text are one document; rows of one id with several texts are several.  Empty
lines stay.  An empty table gives no rows.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

MIN_CHARS, SEGMENT = 20, 64
SPACE = " \t\r\x0b\x0c"
ORD = ["doc_id", "dk", "pos"]


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.col(text_col)
    return (
        df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("dk"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select(*ORD, F.btrim("line", F.lit(SPACE)).alias("l"))
        .withColumn("n", F.length("l"))
        .where(F.col("n") >= min_chars)
        .withColumn("h1", F.xxhash64("l"))
        .withColumn("h2", F.xxhash64(F.lit("second"), "l"))
    )


def _half_keys() -> Column:
    keys = []
    for m in (F.expr("n div 2"), F.expr("(n - 1) div 2")):
        m = m.cast("int")
        keys += [F.xxhash64(F.lit("head"), F.left("l", m)), F.xxhash64(F.lit("tail"), F.right("l", m))]
    return F.array_distinct(F.array(*keys))


def _near(cand: DataFrame) -> DataFrame:
    """Of distinct lines (h1, h2, ord, l, n): those within one edit of an earlier one, written to the shared folder."""
    seg, step = F.col("s"), SEGMENT
    spread = cand.select("h1", "h2", "n", "ord", "l", F.explode(F.expr(f"sequence(0, n div {step})")).alias("s"))
    head = F.expr(f"substring(l, 1, s * {step})")
    roles = spread.select(
        "*", F.explode(F.array(F.struct(F.lit("long").alias("role"), F.xxhash64(seg, "n", head, F.expr(f"substring(l, s * {step} + {step + 1})")).alias("k")),
                               F.struct(F.lit("short").alias("role"), F.xxhash64(seg, F.col("n") + 1, head, F.expr(f"substring(l, s * {step} + {step})")).alias("k")))).alias("r")
    ).select("h1", "h2", "n", "ord", "s", "r.role", "r.k", F.expr(f"substring(l, s * {step} + 1, {step})").alias("part"))
    roles = materialise(roles.where("role = 'short' or part <> ''"), "lines-segments")
    shared = roles.where(F.col("n") >= step - 1).groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    # nothing surrounds the one segment of a line that is shorter: all of one length have one key, which says nothing
    short = F.col("n") < step
    open_ = roles.where(short).unionByName(roles.where(~short).join(shared, "k", "left_semi"))
    deleted = open_.where("role = 'long'").select(
        "h1", "h2", "ord",
        F.explode(F.expr("""
            flatten(transform(sequence(1, length(part)), i -> transform(
              array(xxhash64(k, concat(left(part, i - 1), substring(part, i + 1)))),
              v -> array(struct('D' as kind, v as key), struct('S' as kind, xxhash64(v, i, n) as key)))[0]))""")).alias("v"),
    )
    full = open_.where("role = 'short'").select("h1", "h2", "ord", F.struct(F.lit("F").alias("kind"), F.xxhash64("k", F.left("part", F.lit(step - 1))).alias("key")).alias("v"))
    variants = materialise(deleted.unionByName(full).select("h1", "h2", "ord", "v.kind", "v.key"), "lines-variants")
    release(roles)
    who = F.struct("ord", "h1", "h2")
    firsts = variants.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, who)).alias(k) for k in "SDF"])
    partner = F.when(F.col("kind") == "S", F.col("S")).when(F.col("kind") == "D", F.col("F")).otherwise(F.col("D"))
    pairs = (
        variants.join(firsts, "key").withColumn("p", partner).where("p.ord < ord").select("h1", "h2", F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2")).distinct()
    )
    texts = cand.select("h1", "h2", "l")
    other = cand.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("l").alias("pl"))
    edits = F.levenshtein("l", "pl", 1)
    near = materialise(pairs.join(texts, ["h1", "h2"]).join(other, ["p1", "p2"]).where(edits.between(0, 1)).select("h1", "h2").distinct(), "lines-near")
    release(variants)
    return near


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, dk (hash of the text), gone: the places of the lines that go; documents that lose none are left out.

    It is written to the shared folder, and what was written on the way is deleted.
    """
    lines = _lines(df, id_col, text_col, min_chars)
    classes = materialise(
        lines.withColumn("halves", _half_keys()).groupBy("h1", "h2").agg(F.min(F.struct(*ORD)).alias("ord"), F.count("*").alias("copies"), F.first("halves").alias("halves")),
        "lines-classes",
    )
    halves = classes.select("h1", "h2", F.explode("halves").alias("k"))
    shared = halves.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    some = halves.join(shared, "k", "left_semi").select("h1", "h2").distinct()
    wanted = materialise(classes.join(some, ["h1", "h2"]).select("h1", "h2", "ord"), "lines-wanted")
    places = wanted.groupBy("ord.doc_id", "ord.dk").agg(F.collect_list(F.struct("ord.pos", "h1", "h2")).alias("at"))
    text = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("dk", F.xxhash64("text"))
    cand = materialise(
        text.alias("d")
        .join(places.hint("merge").alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.dk") == F.col("p.dk")))
        .select("d.doc_id", "d.dk", F.split("text", "\n").alias("ls"), "at")
        .select("doc_id", "dk", "ls", F.explode("at").alias("a"))
        .select("a.h1", "a.h2", F.struct("doc_id", "dk", "a.pos").alias("ord"), F.btrim(F.expr("ls[a.pos]"), F.lit(SPACE)).alias("l"))
        .dropDuplicates(["h1", "h2"])
        .withColumn("n", F.length("l")),
        "lines-candidates",
    )
    release(wanted)
    near = _near(cand)
    release(cand)
    marked = near.withColumn("near", F.lit(True))
    affected = classes.where("copies > 1").select("h1", "h2", "ord").join(marked, ["h1", "h2"], "full").select("h1", "h2", "ord", F.coalesce("near", F.lit(False)).alias("near"))
    gone = materialise(
        lines.join(affected, ["h1", "h2"])
        .where(F.col("near") | (F.struct(*ORD) > F.col("ord")))
        .groupBy("doc_id", "dk")
        .agg(F.collect_set("pos").alias("gone")),
        "lines-gone",
    )
    release(classes, near)
    return gone


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with its text column reduced, plus n_lines, n_removed and n_left (lines of ``min_chars`` that stay).

    Columns of ``df`` that have these names are replaced.
    """
    return without_lines(df, removed_lines(df, id_col, text_col, min_chars), id_col, text_col, min_chars)


def without_lines(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """What ``dedup_lines`` returns, for the places that ``removed_lines`` gives; documents whose ``gone`` is null there go."""
    gone = gone.select(F.col("doc_id").alias("i"), F.col("dk").alias("k"), "gone", F.col("gone").isNull().alias("whole"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").withColumn("lines", F.split("text", "\n"))
    joined = joined.where(~F.coalesce("whole", F.lit(False)))
    left = F.expr("array_sort(array_except(sequence(0, size(lines) - 1), gone))")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda p: F.get(F.col("lines"), p)))
    out = joined.select("row", "text", F.col("gone").isNull().alias("same"), F.size("lines").alias("n"), F.size("gone").alias("g"), kept.alias("kept"))
    own = [F.col("row")[c].alias(c) for c in df.columns if c not in (text_col, "n_lines", "n_removed", "n_left")]
    text = F.when(F.col("same"), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(text_col)
    return out.select(
        *own,
        text,
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.when(F.col("same"), 0).otherwise(F.col("g")).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.filter("kept", lambda x: F.length(F.btrim(x, F.lit(SPACE))) >= min_chars)), F.lit(0)).cast("long").alias("n_left"),
    )


def line_digests(df: DataFrame) -> DataFrame:
    out = dedup_lines(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM x),
t AS (SELECT doc_id, text, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM e),
o AS (SELECT *, length(l) AS n FROM t WHERE length(l) >= 20),
c AS (SELECT l, n, min((doc_id, pos)) AS ord FROM o GROUP BY l, n),
k AS (SELECT *, 'p' || left(l, n // 2) AS k FROM c UNION SELECT *, 's' || right(l, n // 2) FROM c
      UNION SELECT *, 'p' || left(l, (n - 1) // 2) FROM c UNION SELECT *, 's' || right(l, (n - 1) // 2) FROM c),
p AS (SELECT DISTINCT a.l AS a, a.n AS na, b.l AS b, b.n AS nb, a.ord AS oa, b.ord AS ob FROM k a JOIN k b ON a.k = b.k AND a.l <> b.l AND a.n - b.n IN (0, 1)),
v AS (SELECT * FROM p WHERE len(list_filter(range(1, na + 1), lambda i: left(a, i - 1) = left(b, i - 1) AND substr(a, i + 1) = substr(b, CASE WHEN na = nb THEN i + 1 ELSE i END))) > 0),
near AS (SELECT DISTINCT CASE WHEN oa > ob THEN a ELSE b END AS l FROM v),
m AS (SELECT o.doc_id, o.pos, (o.l IN (SELECT l FROM near)) OR (o.doc_id, o.pos) > c.ord AS gone FROM o JOIN c ON o.l = c.l),
r AS (SELECT t.doc_id, t.text, t.pos, t.line, coalesce(m.gone, false) AS gone FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.pos = m.pos),
g AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(length(kept), 0)::BIGINT AS n_chars_kept, md5(kept) AS text_md5
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
