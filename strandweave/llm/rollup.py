"""Token-count rollups that are maintained from signed changes.

A change is a row (source, lang, tokenizer, docs, tokens) whose counts may be
negative: an insert adds, a delete subtracts, a revised count subtracts the old
figure and adds the new one, possibly under another tokenizer version.  A batch
of changes is summed per key (partial sums before the shuffle, so a hot source
costs one row a task) and written to a folder of its own below ``path/data``.
It counts from the moment at which the next numbered file of ``path/log`` names
it; such a file appears at once, by a rename that never replaces another, so a
batch is there or not, whatever dies when, and of two writers one starts over.
The log is all that there is to the state: any process that opens the folder
sees the same batches and totals, and a batch in the log is never applied again.

Totals are additive: the sum over all folders that count.  ``compact`` writes
that sum to one folder and logs it with the names of all batches it covers,
which stay refused; readers go on from the last such entry.  ``vacuum`` deletes
folders that no longer count; it isn't for times at which others commit.

Nulls: null keys are keys of their own; null counts are 0.  An empty batch is
committed as such.  Repeated changes in one batch each count.

Counts are those of real tokenizers: a text is cut at spaces, each distinct
chunk of a batch is counted once for all versions, and chunks are summed.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_once, drop_path, list_names, materialise, read_text, scratch
from .idfile import GROUP, TIED, Chunks, library

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
#: Tokenizer versions and their files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


@dataclass
class State:
    version: int = 0
    batches: set[str] = field(default_factory=set)
    folders: list[str] = field(default_factory=list)


class TokenRollup:
    """Additive totals in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def state(self) -> State:
        """What the log says, from its last compaction on."""
        now = State()
        for version in sorted((int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/log") if n.endswith(".json")), reverse=True):
            entry = json.loads(read_text(self.spark, self._entry(version)))
            now.version = max(now.version, version)
            now.batches |= set(entry["batches"])
            now.folders.append(entry["folder"])
            if entry["whole"]:
                break
        return now

    @property
    def batches(self) -> list[str]:
        return sorted(self.state().batches)

    def committed(self, batch: str) -> bool:
        return batch in self.state().batches

    def _write(self, changes: DataFrame) -> str:
        folder = uuid.uuid4().hex
        summed = changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
            F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("d_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("d_tokens")
        )
        summed.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _log(self, version: int, folder: str, batches: list[str], whole: bool) -> bool:
        return append_once(self.spark, self._entry(version), json.dumps({"folder": folder, "batches": batches, "whole": whole}))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before."""
        state, folder = self.state(), None
        while batch not in state.batches:
            folder = folder or self._write(changes)
            if self._log(state.version + 1, folder, [batch], False):
                return True
            state = self.state()  # another writer was first
        return False

    def compact(self) -> None:
        """Put the sum of all batches into one folder; a commit that comes between makes it start over."""
        while True:
            state = self.state()
            total = self._read(state).select(*KEYS, F.col("d_docs").alias("docs"), F.col("d_tokens").alias("tokens"))
            if self._log(state.version + 1, self._write(total), sorted(state.batches), True):
                return

    def vacuum(self) -> None:
        """Delete what doesn't count any more."""
        state = self.state()
        for name in list_names(self.spark, f"{self.path}/data"):
            if name not in state.folders:
                drop_path(self.spark, f"{self.path}/data/{name}")
        for version in range(state.version - len(state.folders), 0, -1):
            drop_path(self.spark, self._entry(version))

    def _read(self, state: State) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in state.folders]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self, zeros: bool = False) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose documents are all gone are left out."""
        out = self._read(self.state()).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out if zeros else out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


class Counter:
    """Numbers of tokens of texts by one tokenizer; special strings as its library has them by default."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                self.chunks = Chunks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
            self.special, self.encode = [], self.chunks.whole
        else:
            lib = library(path)
            self.chunks, self.special, self.encode = lib.chunks, lib.special, lambda text: lib.encode([text])[0]

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 2

    def counts(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.chunks.ids(chunks)), np.int64, len(chunks)) // 2


@cache
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(path)


def count_tokens(texts: pa.Array, counters: list[Counter]) -> list[np.ndarray]:
    """For each counter the numbers of tokens of all texts (none is null)."""
    out = [np.zeros(len(texts), np.int64) for _ in counters]
    whole = pc.match_substring_regex(texts, TIED)  # can't be cut at their spaces
    for special in {s for c in counters for s in c.special}:
        whole = pc.or_(whole, pc.match_substring(texts, special))
    whole = whole.to_numpy(zero_copy_only=False) | any(c.chunks is None for c in counters)
    for i in np.flatnonzero(whole):
        text = texts[i].as_py()
        for o, c in zip(out, counters):
            o[i] = c.count(text)
    rest = np.flatnonzero(~whole)
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[rest])
    start = 0
    while start < len(rest):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP, "right")))
        some = rest[start:end]
        cut = pc.split_pattern(texts.take(pa.array(some)), " ")
        at = cut.offsets.to_numpy()
        numbered = cut.values.dictionary_encode()
        words, index = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        first = np.zeros(len(index), bool)
        first[at[:-1]] = True  # has no space before it
        used = np.bincount(index[~first], minlength=len(words)) > 0
        chunks = [" " + w if u else "" for w, u in zip(words, used.tolist())]
        starts = [words[i] for i in index[at[:-1]].tolist()]
        for o, c in zip(out, counters):
            each = c.counts(chunks)[index]
            each[at[:-1]] = c.counts(starts)
            o[some] = np.add.reduceat(each, at[:-1])
        start = end
    return out


def _counted(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(p) for p in paths]
        for batch in batches:
            t1, t2 = count_tokens(pc.fill_null(batch.column(4), ""), counters)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(t1), pa.array(t2)], names=["doc_id", "source", "lang", "copy", "t1", "t2"])

    return run


def document_rollup(df: DataFrame, path: str | None = None, versions: dict[str, str] | None = None) -> TokenRollup:
    """The rollup of a table of documents after three batches, the second sent twice.

    Insert all under the first tokenizer version; delete all but one of equal
    texts (the one with the least doc_id, source, lang stays; null texts are no
    copies); recount under the second version those of the rest for which it
    counts otherwise.  Equal texts of one source and language are one row from
    the first shuffle on, which holds only partial sums.
    """
    spark = df.sparkSession
    (old, new), paths = zip(*[(v, public_tokenizers.path(f)) for v, f in (versions or VERSIONS).items()])
    rows = df.selectExpr("cast(doc_id as bigint) as doc_id", "cast(source as string) as source", "cast(lang as string) as lang", "md5(cast(text as binary)) as copy", "text")
    counted = rows.mapInArrow(_counted(list(paths)), "doc_id long, source string, lang string, copy string, t1 long, t2 long")
    who = F.struct("doc_id", "source", "lang")
    alike = materialise(counted.groupBy("copy", "source", "lang", "t1", "t2").agg(F.count("*").alias("n"), F.min(who).alias("least")), "rollup-alike")
    # written, so that the join reads two plain shuffles
    several = alike.where("copy is not null").groupBy("copy").agg(F.min("least").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    several = materialise(several.select("copy", "first"), "rollup-copies")
    stays = F.when(F.col("first").isNull(), F.col("n")).otherwise((F.col("least") == F.col("first")).cast("int"))
    rows = materialise(alike.join(several, "copy", "left").select("source", "lang", "t1", "t2", "n", stays.cast("long").alias("kept")), "rollup-kept")

    def batch(version: str, docs, tokens: str, where: str = "true") -> DataFrame:
        return rows.where(where).select("source", "lang", F.lit(version).alias("tokenizer"), docs.alias("docs"), (docs * F.col(tokens)).alias("tokens"))

    n, kept = F.col("n"), F.col("kept")
    gone, other = batch(old, kept - n, "t1", "kept < n"), "t1 <> t2 and kept > 0"
    out = TokenRollup(spark, path or scratch(spark, "rollup"))
    out.commit("1-insert", batch(old, n, "t1"))
    out.commit("2-delete", gone)
    out.commit("3-revise", batch(old, -kept, "t1", other).unionByName(batch(new, kept, "t2", other)))
    out.commit("2-delete", gone)
    return out
