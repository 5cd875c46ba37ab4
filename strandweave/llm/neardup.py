"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles gives ``ROWS * BANDS`` MinHash samples.
Bands of samples propose candidates; the samples are also folded into a parity
bitmap (odd sketch), and the population count of two bitmaps' XOR estimates
their similarity well where it is high, so that most false candidates end
there.  What remains is confirmed on the full shingle sets.

Equal sets are collapsed first.  Then links are found in rounds, each linear in
the members of buckets.  Every bucket proposes the pairs of its members with its
smallest id; confirmed links give components.  Buckets in which no component has
half of the members elect a centre, the member whose sketch is nearest to the
majority of all its sketches (the text that the others are copies of, where
there is one), and propose the pairs with that.  What is mixed even then and
has at most ``GROUP`` members is compared in full within one task: those outside
the largest component with all of other components, by sketches, then those with
a candidate by their full sets, with as many links as join components.  Larger buckets are split by ``SPLITS``
keys of further MinHash samples each, again and again (a pair shares about 13 of
the 50 buckets and all of them have to fail), and after ``LEVELS`` such steps by
blocks of ``GROUP`` against blocks.  Each bucket is split by other keys.  So no pair that shares a bucket stays
unexamined unless it is connected already.  Two documents of similarity 0.8
share none of the 50 buckets with a probability of 3e-7.

Words: runs of characters other than ASCII white space, A-Z in lower case.  A
text with fewer words than a shingle is one shingle; without words (or null) it
is linked with nothing.  Rows with equal ids are one node; a row with null id is
linked with nothing and kept.  An empty table gives no rows.  Only the id and
text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, keep_only, materialise, release
from .graph import components

ROWS, BANDS, BITS = 6, 50, 1024
SAMPLES = ROWS * BANDS
#: Estimates below this (nearly five standard deviations under 0.8) end a candidate.
LEAST_ESTIMATE = 0.65
#: XOR population counts above this mean a lower estimate.
MOST_ODD = math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - LEAST_ESTIMATE) / BITS)))
#: Members of a bucket that are compared in one task, as many shingles counting as one more; members from which on a bucket elects a centre.
GROUP, SHINGLES, ELECT = 4096, 2048, 16
#: Keys that a larger bucket is split by, and how often at most.
SPLITS, LEVELS = 8, 3
#: Words of at most so many bytes are remembered, so many before the cache starts anew; bytes split at a time.
WORD_BYTES, MAX_WORDS, CHUNK = 64, 200_000, 1 << 22

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)
_ODD = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) > MAX_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, width: int, words: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts, at, text = [], 0, text or b""
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        some = text[at:end].lower().split()
        parts.append(np.fromiter(map(words.__getitem__, some), np.uint64, len(some)))
        at = end
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = len(w)
    if not n:
        return w
    size = min(n, width)
    acc = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        acc += w[i : n - size + 1 + i] * _ODD[i]
    return np.unique(_mix(acc))


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        h = np.multiply.outer(_MUL, x[a : a + 512])
        h += _ADD[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64) * _ODD[40]
    for i, col in enumerate(sig.reshape(BANDS, ROWS).T):
        acc = acc + (col.astype(np.uint64) + np.uint64(1)) * _ODD[i]
    return _mix(acc).view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    bits = _mix(sig.astype(np.uint64) + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _ODD[41]) % np.uint64(BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        words, none = Words(), np.zeros(0, np.int64)
        for batch in batches:
            n, f1, f2, bands, odd = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, width, words)
                sig = samples(s) if len(s) else None
                n.append(len(s))
                f1.append(int(s.sum().view(np.int64)))
                f2.append(int(_mix(s * _ODD[42]).sum().view(np.int64)))
                bands.append(none if sig is None else band_keys(sig))
                odd.append(none if sig is None else odd_sketch(sig))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "n", "f1", "f2", "bands", "odd"],
            )

    return giving_back(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingles(t, width, words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "s"])

    return giving_back(run)


def _splits(level: int):
    """Rows (doc_id, s) to (doc_id, splits): band keys of MinHash samples that no other level has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [band_keys(samples(_mix(np.frombuffer(s.as_buffer(), np.uint64) * _ODD[43] + _ODD[44 + level]))) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "splits"])

    return giving_back(run)


KEYS = ["k", "i", "j"]
COLUMNS = [*KEYS, "own", "doc_id", "g", "n", "odd", "bands", "split"]
BLOCKS = "k long, i int, j int, own int, doc_id long, g long, n long, odd array<long>, bands array<long>, split array<long>"


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the columns ``names``, by which they are sorted."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        keys = [batch.column(n).to_numpy() for n in names]
        turn = 1 + np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) if len(batch) else []
        for s, e in zip([0, *turn], [*turn, len(batch)]):
            if e > s:
                now = tuple(int(x[s]) for x in keys)
                if held and now != key:
                    yield pa.concat_tables(held)
                    held = []
                key = now
                held.append(pa.Table.from_batches([batch.slice(s, e - s)]))
    if held:
        yield pa.concat_tables(held)


def _wide(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy().reshape(len(rows), -1)


def _off_centre(odd: np.ndarray) -> np.ndarray:
    """For each sketch the bits in which it differs from the majority."""
    bits = np.unpackbits(np.ascontiguousarray(odd).view(np.uint8), axis=1)
    return (bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1)


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, j, doc_id, odd) for each (k, j): the member nearest to the majority, and how far it is off."""
    for rows in _groups(batches, ["k", "j"]):
        off = _off_centre(_wide(rows, "odd"))
        at = int(np.argmin(off))
        yield pa.RecordBatch.from_arrays([pa.array([rows.column("k")[0].as_py()], pa.int64()), pa.array([rows.column("doc_id")[at].as_py()], pa.int64()), pa.array([int(off[at])], pa.int64())], names=["k", "c", "off"])


class _Block:
    """Members of a bucket that are held against each other: those of one part, or of two parts across."""

    def __init__(self, rows: pa.Table, percent: int):
        c = {n: rows.column(n).to_numpy() for n in ("k", "i", "j", "own", "doc_id", "g", "n")}
        self.doc_id, self.n, self.root, self.percent = c["doc_id"], c["n"], c["g"].copy(), percent
        self.odd = _wide(rows, "odd").view(np.uint64)  # of negative numbers numpy counts the bits of the absolute value
        self.bands = _wide(rows, "bands")
        found = np.flatnonzero((self.bands == c["k"][0]).all(0))
        self.place = int(found[0]) if len(found) else 0  # what a bucket was split into has none
        # a shared band counts as examined unless its bucket is so large that it is split
        self.earlier = self.bands[:, : self.place]
        self.unsplit = ~np.isin(self.earlier, rows.column("split").combine_chunks().flatten().to_numpy())
        self.one = c["i"][0] == c["j"][0]
        self.xs, self.ys = np.flatnonzero(c["own"] == c["i"][0]), np.flatnonzero(c["own"] == c["j"][0])
        # each pair once: from the one that is farther from the largest component, then by the distance from the
        # majority (a likely centre comes first, so that most pairs are connected when their turn comes)
        off = _off_centre(self.odd)
        if self.one:
            groups, size = np.unique(self.root, return_counts=True)
            largest = self.root == groups[np.argmax(size)]
            order = np.lexsort((off, largest))
            self.xs = order[: len(order) - int(largest.sum())]
        else:
            order = np.argsort(off, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.xs = self.xs[np.argsort(self.rank[self.xs])]

    def near(self, x: int) -> np.ndarray:
        """Members of other components that sketches don't tell apart from ``x`` and that share no earlier band with it."""
        y = self.ys[self.rank[self.ys] > self.rank[x]] if self.one else self.ys
        y = y[self.root[y] != self.root[x]]
        n = self.n[x]
        y = y[np.minimum(self.n[y], n) * 100 >= np.maximum(self.n[y], n) * self.percent]
        y = y[np.bitwise_count(self.odd[y] ^ self.odd[x]).sum(1, dtype=np.int64) <= MOST_ODD]
        return y[~((self.earlier[y] == self.earlier[x]) & self.unsplit[x]).any(1)]


def _across(percent: int):
    """Of the rows of blocks: those that have a pair to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, KEYS):
            block, touched = _Block(rows, percent), np.zeros(len(rows), bool)
            for x in block.xs:
                y = block.near(x)
                touched[y] = True
                touched[x] |= len(y) > 0
            yield from rows.filter(pa.array(touched)).combine_chunks().to_batches()

    return giving_back(run)


def _links(percent: int):
    """Of the rows of blocks with their full sets ``s``: links that join components, at most one a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, KEYS):
            block = _Block(rows, percent)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("s")]
            a, b = [], []
            for x in block.xs:
                for y in block.near(x):
                    if block.root[x] == block.root[y]:
                        continue
                    both = _shared(sets[x], sets[y])
                    if both * 100 >= (len(sets[x]) + len(sets[y]) - both) * percent:
                        a.append(int(block.doc_id[x]))
                        b.append(int(block.doc_id[y]))
                        block.root[block.root == block.root[y]] = block.root[x]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b) if a else [], pa.int64()), pa.array(np.maximum(a, b) if a else [], pa.int64())], names=["a", "b"])

    return giving_back(run)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that aren't empty."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of intersections of sorted sets."""
    return pa.array([_shared(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair)) for pair in zip(a, b)], pa.int64())


def _odd_count(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its component), kept.

    Links have 100 * intersection >= percent * union.  Bands and the odd-sketch
    bound are laid out for ``percent`` of 80 or more.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 or more")
    steps: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        steps.append(materialise(df, name))
        return steps[-1]

    docs = df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    sketched = materialise(docs.mapInArrow(_sketch(width), "doc_id long, n long, f1 long, f2 long, bands array<long>, odd array<long>"), "near-sketches")
    inner, own = sketched.where("n > 0 and doc_id is not null"), ["n", "f1", "f2"]
    # written, so that the join reads two plain shuffles and a set with very many copies can be split
    several = inner.groupBy(own).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    several = step(several, "near-classes")
    members = step(inner.select("doc_id", *own).join(several, own, "left").withColumn("rep", F.coalesce("rep", "doc_id")), "near-members")
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # an id with several texts is one node: a class whose least id it is stands under it
    others = members.where("doc_id <> rep").select("doc_id", *own).distinct()
    reps = step(inner.join(others, ["doc_id", *own], "left_anti").dropDuplicates(["doc_id", *own]), "near-reps")
    buckets = reps.select("doc_id", "n", F.explode("bands").alias("k"))
    centres = buckets.groupBy("k").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("d")).where("c <> d")
    full = step(buckets.join(centres.select("k", "c"), "k").select("k", "doc_id", "n", "c"), "near-buckets")  # only buckets of two and more
    about = reps.select("doc_id", "n", "odd", "bands")

    # one shuffle of the texts brings the full sets of all documents that share a bucket
    ids = full.select("doc_id").distinct()
    sets = step(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, s binary").dropDuplicates(), "near-sets")

    def star(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b): those whose sketches, then full sets are similar enough."""
        # written first, so that the join of a centre with very many members can be split
        near = step(
            step(pairs.distinct(), f"{name}-pairs")
            .join(about.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
            .join(about.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .where(_odd_count("oa", "ob") <= MOST_ODD)
            .select("a", "b").distinct(),
            f"{name}-near",
        )
        shared = (
            near.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
            .withColumn("common", _common("sa", "sb"))
        )
        union = (F.octet_length("sa") + F.octet_length("sb")) / 8 - F.col("common")
        return step(shared.where(F.col("common") * 100 >= union * percent).select("a", "b").distinct(), name)

    def mixed(at: DataFrame, found: DataFrame) -> DataFrame:
        """(k, doc_id, n, g, m, top) of the buckets of (k, doc_id, n) whose members are in several components g; m: size, top: members of the largest."""
        placed = at.select("k", "doc_id", "n").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k", "doc_id", "n", F.coalesce("component", "doc_id").alias("g"))
        parts = placed.groupBy("k", "g").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        size = F.greatest(F.sum("c"), F.ceil(F.sum("s") / SHINGLES)).alias("m")
        several = parts.groupBy("k").agg(F.count("*").alias("parts"), size, F.max("c").alias("top")).where("parts > 1")
        return step(placed.join(several.select("k", "m", "top"), "k"), "near-mixed")

    def stars(found: DataFrame) -> DataFrame:
        return found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))

    found = components(star(full.where("doc_id <> c").select(F.col("c").alias("a"), F.col("doc_id").alias("b")), "near-first"))
    open_ = mixed(full, found)
    large = open_.where((F.col("m") >= ELECT) & (F.col("top") * 2 < F.col("m")))
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / GROUP)).cast("int")
        voters = large.join(about.drop("n"), "doc_id").select("k", part.alias("j"), "doc_id", "odd")
        elected = voters.repartition("k", "j").sortWithinPartitions("k", "j", "doc_id").mapInArrow(giving_back(_elect), "k long, c long, off long").groupBy("k").agg(F.min(F.struct("off", "c")).alias("x"))
        centred = large.join(step(elected.select("k", "x.c"), "near-elected"), "k").where("doc_id <> c")
        second = star(centred.select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")), "near-second")
        found = components(stars(found).unionByName(second))
        open_ = mixed(open_, found)
    links = stars(found)

    split = open_.where(F.col("m") > GROUP).groupBy("doc_id").agg(F.collect_set("k").alias("split"))
    any_split = not split.isEmpty()

    def compared(at: DataFrame, whole: bool) -> DataFrame:
        """Links of the buckets ``at`` by full comparison; unless ``whole``, in blocks."""
        if whole:
            parts = at.select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "doc_id", "g")
        else:
            at = at.withColumn("blocks", F.ceil(F.col("m") / GROUP).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
            at = at.select("k", "doc_id", "g", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            parts = at.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "g")
        none = F.array().cast("array<long>")
        blocks = parts.join(about.hint("merge"), "doc_id")
        blocks = blocks.join(split, "doc_id", "left").withColumn("split", F.coalesce("split", none)) if any_split else blocks.withColumn("split", none)
        blocks = blocks.select(COLUMNS)
        across = step(blocks.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_across(percent), BLOCKS), "near-across")
        # a document's set goes once to each block that has a pair of it, not to each pair
        more = across.join(sets, "doc_id").select(*COLUMNS, "s").repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_links(percent), "a long, b long")
        return step(more.distinct(), "near-more")

    if any_split:
        split = step(split, "near-split")
    links = links.unionByName(compared(open_.where(F.col("m") <= GROUP), True))
    for level in range(LEVELS):
        large = open_.where(F.col("m") > GROUP)
        if large.isEmpty():
            break
        keys = sets.join(large.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_splits(level), "doc_id long, splits array<long>")
        place = F.pmod(F.xxhash64("k") + F.col("turn"), F.lit(BANDS)).cast("int")
        turns = large.select("k", "doc_id", "n").join(keys, "doc_id").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        finer = turns.select(F.xxhash64("k", "turn", F.get("splits", place)).alias("k"), "doc_id", "n").distinct()
        open_ = mixed(step(finer, "near-finer"), found)
        links = links.unionByName(compared(open_.where(F.col("m") <= GROUP), True))
    else:
        if not open_.where(F.col("m") > GROUP).isEmpty():
            links = links.unionByName(compared(open_.where(F.col("m") > GROUP), False))
    whole = components(links.unionByName(same))
    release(*steps)
    counts = sketched.select("doc_id", F.col("n").alias("n_shingles"))
    return (
        counts.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
