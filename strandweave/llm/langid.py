"""Language of words and documents by a linear-chain conditional random field.

Features of a word: its byte n-grams with marks at both ends (those that touch a
mark are its affixes) and membership in lexicons of the languages.  Weights and
transitions are learned together by gradient ascent on the likelihood of
sequences spliced from windows of labelled documents of different languages, so
that transitions within and between languages are both seen.  Prediction runs
forward-backward over the whole text: segments of ``SEGMENT`` words are reduced
to matrices, these are chained for each document, and the segments are then
walked together.  A document's label is the one with the most expected words.

Learning reads a bounded sample: of each label at most ``docs_per_label``
documents, ``windows`` windows of ``width`` words (and at most ``window_bytes``
bytes) each, drawn by hash of id and text.  These are parameters of ``train``.
Every label is learned; more than ``MAX_LANGS`` are refused, since the weights
have a column for each.  Prediction reads every word of every text.

Nulls and texts without a letter get ``und`` with score 0; rows with null id or
label aren't learned from.  Without any label all is ``und``.  Each row is
predicted by itself, so ties, repeats and hot sources need no care.  Only the
id, text and label columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_groups, give_back, giving_back, keep_only

DOCS_PER_LANG, MAX_LANGS, WINDOWS, WIDTH, WINDOW_BYTES = 300, 256, 6, 24, 4096
ORDERS, TABLE = (2, 3, 4, 5), 1 << 16
SPLICE, ROUNDS, RATE, DECAY = 4, 50, 0.15, 1e-4
SEGMENT, GROUP, MAX_WORDS = 64, 1 << 21, 150_000
LETTER = regex.compile(r"\p{L}")
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def lettered(words: list[bytes]) -> np.ndarray:
    """Whether a word has a letter; any byte above 127 counts as part of one."""
    return np.array([w.upper() != w or not w.isascii() for w in words], bool)


def ngrams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: table rows (0: none) at every byte place, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.frombuffer(b"\2" + b"\3\2".join(words) + b"\3", np.uint8).astype(np.uint32) + np.uint32(1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(raw))  # bytes to the word's end
    for n in ORDERS:
        h = np.zeros(len(raw), np.uint32)
        for i in range(n):
            h[: len(raw) - i] = (h[: len(raw) - i] ^ raw[i:]) * _K[i]
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(2 * n + 1)) >> np.uint32(16)
        yield np.where(left >= n, 1 + h.astype(np.int32) % (TABLE - 1), 0), starts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels; row 0 is zero
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # for each, its language
    lexical: np.ndarray  # language of the lexicon x labels
    trans: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of words; zero for those without letters."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        if words:
            for rows, starts in ngrams(words):
                out += np.add.reduceat(self.weights[rows], starts, axis=0)
            if len(self.lexicon):
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
                hit = self.lexicon[at] == h
                out[hit] += self.lexical[self.member[at[hit]]]
            out[~lettered(words)] = 0
        return out


def learn(samples: list[tuple[str, list[bytes]]], seed: int = 7) -> Model | None:
    """samples: (label, words of a window)."""
    samples = sorted((x, w) for x, w in samples if w)
    labels = sorted({x for x, _ in samples})
    if not samples:
        return None
    n, rng = len(labels), np.random.default_rng(seed)
    rng.shuffle(samples)
    # half of the windows make the lexicons, so that membership isn't a matter of course in the others
    count: dict[bytes, Counter] = {}
    for x, ws in samples[::2]:
        for w in ws:
            count.setdefault(w, Counter())[x] += 1
    entries = sorted((xxhash.xxh3_64_intdigest(w), labels.index(top)) for w, c in count.items() for top, k in [c.most_common(1)[0]] if k >= 2 and k >= 0.9 * c.total())
    lexicon, member = np.array([h for h, _ in entries], np.uint64), np.array([m for _, m in entries], np.int32)
    rest = samples[1::2] or samples
    # sequences of windows, cut at random places, of one or several languages
    length, seqs = SPLICE * WIDTH, []
    for i in range(0, len(rest), SPLICE):
        some, seq = rest[i : i + SPLICE], []
        same = rng.random() < 0.5
        for x, ws in sorted(some, key=lambda s: s[0]) if same else some:
            seq += [(w, labels.index(x)) for w in ws[: rng.integers(max(1, len(ws) // 3), len(ws) + 1)]]
        seqs.append(seq[:length])
    seqs.sort(key=len, reverse=True)
    number: dict[bytes, int] = {}
    words = np.full((len(seqs), length), -1, np.int64)
    gold = np.zeros((len(seqs), length), np.int64)
    for r, seq in enumerate(seqs):
        for t, (w, y) in enumerate(seq):
            words[r, t], gold[r, t] = number.setdefault(w, len(number)), y
    vocab = list(number)
    model = Model(labels, np.zeros((TABLE, n), np.float32), lexicon, member, np.zeros((n, n), np.float32), np.eye(n, dtype=np.float32))
    grams = list(ngrams(vocab))
    owner = np.repeat(np.arange(len(vocab)), np.diff(np.append(grams[0][1], len(grams[0][0]))))
    sure = lettered(vocab)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
    at = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0))
    hit = (lexicon[at] == h) & sure if len(lexicon) else np.zeros(len(vocab), bool)
    live = (words >= 0).sum(0)  # sequences are sorted by length
    params = [model.weights, model.lexical, model.trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = max(1, int((words >= 0).sum()))
    for step in range(1, ROUNDS + 1):
        em = model.emissions(vocab)
        e = np.exp(em - em.max(1, keepdims=True))[words]
        a = np.exp(model.trans - model.trans.max())
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        prev = np.full((len(seqs), n), 1 / n, np.float32)
        for t in range(length):
            m = live[t]
            x = (prev[:m] @ a) * e[:m, t]
            alpha[:m, t] = x / x.sum(1, keepdims=True)
            prev = alpha[:, t]
        res = np.zeros((len(vocab), n))
        seen, expected = np.zeros((n, n)), np.zeros((n, n))
        for t in range(length - 1, -1, -1):
            m = live[t]
            if t + 1 < length and (k := live[t + 1]):
                nxt = e[:k, t + 1] * beta[:k, t + 1]
                b = nxt @ a.T
                beta[:k, t] = b / b.sum(1, keepdims=True)
                pair = alpha[:k, t, :, None] * a * nxt[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                np.add.at(seen, (gold[:k, t], gold[:k, t + 1]), 1)
            g = alpha[:m, t] * beta[:m, t]
            g /= g.sum(1, keepdims=True)
            g = -g
            g[np.arange(m), gold[:m, t]] += 1
            for y in range(n):
                res[:, y] += np.bincount(words[:m, t], g[:, y], len(vocab))
        res[~sure] = 0
        grad_w = np.zeros((TABLE, n))
        for rows, _ in grams:
            for y in range(n):
                grad_w[:, y] += np.bincount(rows, res[owner, y], TABLE)
        grad_l = np.zeros((n, n))
        if hit.any():
            np.add.at(grad_l, member[at[hit]], res[hit])
        for p, g, u, v in zip(params, (grad_w, grad_l, seen - expected), first, second):
            g = (g / total - DECAY * p).astype(np.float32)
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        model.weights[0] = 0
    return model


def posteriors(em: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; ``em``: scores of all documents' words in a row, ``sizes``: words of each."""
    n = em.shape[1]
    e = np.exp(em - em.max(1, keepdims=True)) if len(em) else em
    a = np.exp(trans - trans.max())
    segs = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), segs)
    ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
    begin = (np.cumsum(sizes) - sizes)[doc] + ordinal * SEGMENT
    size = np.minimum(SEGMENT, sizes[doc] - ordinal * SEGMENT)
    order = np.argsort(-size, kind="stable")  # longest first, so that those still running are a prefix
    begin_o, live = begin[order], np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
    prod = np.broadcast_to(np.eye(n, dtype=np.float32), (len(doc), n, n)).copy()
    several = int((segs > 1).sum())
    if several:
        for t in range(SEGMENT):
            m = live[t]
            x = np.matmul(prod[:m], a) * e[begin_o[:m] + t][:, None, :]
            prod[:m] = x / x.sum((1, 2), keepdims=True)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    prod = prod[back]
    into, after = np.full((len(doc), n), 1 / n, np.float32), np.ones((len(doc), n), np.float32)
    if several:
        for j in range(1, int(segs.max())):
            s = np.flatnonzero(ordinal == j) if j < 4 else (np.cumsum(segs) - segs)[segs > j] + j
            x = np.matmul(into[s - 1][:, None, :], prod[s - 1])[:, 0]
            into[s] = x / x.sum(1, keepdims=True)
        for j in range(int(segs.max()) - 2, -1, -1):
            s = (np.cumsum(segs) - segs)[segs > j + 1] + j
            x = np.matmul(prod[s + 1], after[s + 1][:, :, None])[:, :, 0]
            after[s] = x / x.sum(1, keepdims=True)
    out = np.empty_like(e)
    prev = into[order]
    for t in range(SEGMENT):
        m = live[t]
        x = (prev[:m] @ a) * e[begin_o[:m] + t]
        x /= x.sum(1, keepdims=True)
        out[begin_o[:m] + t] = x
        prev[:m] = x
    nxt = after[order]
    for t in range(SEGMENT - 1, -1, -1):
        m = live[t]
        at = begin_o[:m] + t
        g = out[at] * nxt[:m]
        out[at] = g / g.sum(1, keepdims=True)
        x = (e[at] * nxt[:m]) @ a.T
        nxt[:m] = x / x.sum(1, keepdims=True)
    return out


class _Vocabulary(dict):
    """Words to rows of a table of scores that grows with them."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class Predictor:
    def __init__(self, model: Model):
        self.model, self.vocab = model, _Vocabulary()
        self.scores, self.sure = np.zeros((0, len(model.labels)), np.float32), np.zeros(0, bool)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each word, words of each text, and which words have letters."""
        if len(self.vocab) > MAX_WORDS:
            self.vocab, self.scores, self.sure = _Vocabulary(), self.scores[:0], self.sure[:0]
        split = [words_of(t) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((i for s in split for i in map(self.vocab.__getitem__, s)), np.int64, int(sizes.sum()))
        if self.vocab.new:
            self.scores = np.concatenate([self.scores, self.model.emissions(self.vocab.new)])
            self.sure = np.concatenate([self.sure, lettered(self.vocab.new)])
            self.vocab.new = []
        return posteriors(self.scores[ids], sizes, self.model.trans), sizes, self.sure[ids]

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Label, share of expected words, and changes of label along the text."""
        post, sizes, sure = self.words(texts)
        ends = np.cumsum(sizes)
        mass = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(np.where(sure[:, None], post, 0), axis=0, dtype=np.float64)])
        mass = mass[ends] - mass[ends - sizes]
        doc, best = np.repeat(np.arange(len(sizes)), sizes)[sure], post[sure].argmax(1)
        turn = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
        turns = np.bincount(doc[1:][turn], minlength=len(sizes))
        labels, scores = [], []
        for t, m in zip(texts, mass):
            if t is None or LETTER.search(t) is None:
                labels.append("und")
                scores.append(0.0)
            else:
                k = int(m.argmax())
                labels.append(self.model.labels[k])
                scores.append(float(min(1.0, max(0.0, m[k] / max(m.sum(), 1e-9)))))
        return labels, scores, turns.tolist()


def _windows(windows: int, width: int, window_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, out = [], []
            for doc_id, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                for i in range(windows):
                    at = xxhash.xxh3_64_intdigest(f"{doc_id}:{i}") % max(1, len(words) - width + 1)
                    labels.append(label)
                    out.append(b" ".join(words[at : at + width])[:window_bytes])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["label", "w"])

    return run


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", learnable=None,
    docs_per_label: int = DOCS_PER_LANG, windows: int = WINDOWS, width: int = WIDTH, window_bytes: int = WINDOW_BYTES,
) -> Model | None:
    """Learn from a bounded sample of the labelled rows for which ``learnable`` (a Column) holds.

    At most docs_per_label * windows * window_bytes bytes of each label reach the
    driver.  Rows of one id, text and label are one document.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    if learnable is not None:
        rows = rows.where(learnable)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(F.col(text_col)).alias("dk"))
    # all labels, MAX_LANGS rows at most, with the share of their documents that is drawn from
    labels = rows.groupBy("label").agg(F.count("*").alias("n"))
    labels = labels.sparkSession.createDataFrame(labels.limit(MAX_LANGS + 1).collect(), labels.schema)
    if labels.count() > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} labels")
    share = F.least(F.lit(1.0), F.lit(4.0 * docs_per_label) / F.col("n")).alias("share")
    drawn = F.xxhash64(F.lit("langid"), "doc_id", "dk")
    w = Window.partitionBy("label").orderBy("drawn", "doc_id", "dk")
    # four times the documents wanted by a threshold on the draw, then the lowest of them: what is shuffled doesn't grow with the table
    some = rows.select("doc_id", "dk", "label", drawn.alias("drawn")).join(F.broadcast(labels.select("label", share)), "label").where((F.col("drawn") / float(1 << 64) + 0.5) <= F.col("share")).distinct()
    ids = some.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= docs_per_label).select("label", "doc_id", "dk")
    sample = rows.join(F.broadcast(ids), ["doc_id", "dk", "label"], "left_semi").dropDuplicates(["doc_id", "dk", "label"]).select("doc_id", "text", "label")
    got = sample.mapInArrow(_windows(windows, width, window_bytes), "label string, w binary").collect()
    return learn([(r["label"], bytes(r["w"]).split()) for r in got])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, switches (label changes along the text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed: TABLE rows and a bounded lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        p = Predictor(shared.value) if shared.value else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in byte_groups([t or "" for t in texts], GROUP):
                labels, scores, turns = p.documents(texts[a:b]) if p else (["und"] * (b - a), [0.0] * (b - a), [0] * (b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(labels, pa.string()), pa.array(np.round(scores, 6), pa.float64()), pa.array(turns, pa.int64())], names=["doc_id", "lang_pred", "score", "switches"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(giving_back(run), "doc_id long, lang_pred string, score double, switches long")


def accepted(df: DataFrame, model: Model | None, least_score: float, text_col: str = "text"):
    """Column: whether a text has a language, with at least ``least_score`` of its words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Predictor] = {}

    @F.arrow_udf(T.BooleanType())
    def ok(texts: pa.Array) -> pa.Array:
        keep_only(None)
        if shared.value is None:
            return pa.array([False] * len(texts), pa.bool_())
        p, out, values = state.setdefault("p", Predictor(shared.value)), [], texts.to_pylist()
        for a, b in byte_groups([t or "" for t in values], GROUP):
            labels, scores, _ = p.documents(values[a:b])
            out += [x != "und" and s >= least_score for x, s in zip(labels, scores)]
        give_back()
        return pa.array(out, pa.bool_())

    return ok(F.col(text_col))


def label_spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (words, half-open), lang: the stretches of equal label; words without letters join the stretch before."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in byte_groups([t or "" for t in texts], GROUP):
                post, sizes, sure = p.words(texts[a:b])
                rows, at = [], 0
                for i, size in enumerate(sizes):
                    best, ok = post[at : at + size].argmax(1), sure[at : at + size]
                    at += size
                    places = np.flatnonzero(ok)
                    if len(places):
                        turn = np.concatenate([[0], 1 + np.flatnonzero(np.diff(best[places]))])
                        starts = [0, *places[turn[1:]].tolist()]
                        rows += [{"doc_id": ids[a + i], "start": s, "stop": e, "lang": p.model.labels[best[places[t]]]} for s, e, t in zip(starts, [*starts[1:], int(size)], turn)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, start long, stop long, lang string")


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, switches; learns from documents that aren't held out."""
    out = predict(df, train(df, learnable=remainder() != 2))
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "switches")
