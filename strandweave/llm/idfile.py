"""Token-id files by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK``, each coded by itself with a model that
starts anew and a checksum over its ids.  An id's probability is a mixture

    P(x) = (w0 * C0(x) + w1 * [x = p1] + w2 * [x = p2]) / (w0 + w1 + w2)

of adaptive counts C0 (order 0), of the id p1 that followed the id before last
time (order 1), and of the id p2 that followed the two ids before (order 2).
Weights are counts of how often each was right, kept for each combination of how
sure the predictions are and whether they agree.  Counts of order 0 are summed
anew after growing runs of ids; they are kept for the ids that a block has, whose
list stands before it, and start from the ids' frequencies in the file, which its
head has in steps of about half a bit.  The cumulative sums of a mixture are those of order 0
with a step at each prediction, so the decoder finds an id with one look into a
table of slots.

The range coder has 16-bit words and a state of whole numbers in float64, in
which its quotients are exact.  All blocks of a file advance together, one id at
a time, with numpy across blocks.  The encoder knows all ids and finds their
predictions beforehand, by sorting each block's contexts.

A file holds the documents of a range of ids: magic, counts, the compressed
table of document ids and lengths, and the blocks with counts and checksums.
Files are rows of a table that Spark writes and commits to the shared folder.

Nulls: a null text has the end id alone; a null document id sorts first.
Repeated rows follow one another.  An empty table gives no files.  A text longer
than a file fills a longer file.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, keep_only, scratch

MAGIC, HEAD = b"CMRC3", "<IIQIIII"
BLOCK, LANES = 4096, 2048
#: Ids after which a file ends, at the end of a document.
FILE_IDS = BLOCK * LANES
#: Contexts of order 2 (hashed); slots that ids of order 0 share, as many as a block may have ids at least.
PAIRS, SLOTS = 2048, 4096
#: Blocks whose tables are filled at a time.
SOME = 64
#: Ids that the file's frequencies count as, against those of the block so far.
PRIOR = 1000.0
#: A hit's weight, and weights to begin with: of order 0, and of a prediction by how sure it is (0: there is none).
HIT, FIRST0, FIRST = 4, 6.0, (0.0, 2.0, 10.0, 24.0)
#: White space, a space after it, and what ends in it or is empty.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TIED, LOOSE = f"{WHITE} ", rf"(^|{WHITE})\z"
#: Ranges go from LEAST to FULL, words have 16 bits.
WORD, LEAST, FULL = float(1 << 16), float(1 << 32), float(1 << 48)
#: Chunks of at most so many characters are remembered, and so many before the new ones of a group (about 120 MB); bytes encoded at a time.
CHUNK_CHARS, MAX_CHUNKS, GROUP = 48, 500_000, 1 << 22
#: Bytes of texts whose distinct words are encoded at a time.
TEXTS = 1 << 25


def _pair(prev: np.ndarray, prev2: np.ndarray) -> np.ndarray:
    return ((prev.astype(np.uint32) * np.uint32(0x85EBCA77)) ^ (prev2.astype(np.uint32) * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - PAIRS.bit_length() + 1)


def _classes(sure1: np.ndarray, sure2: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """The place of weights: how sure the predictions are (0 to 3) and whether they agree."""
    return (sure2 << 3) | (sure1 << 1) | agree


def _first_weights(lanes: int) -> np.ndarray:
    """Rows of (order 0, 1, 2) for each lane and class."""
    one = np.zeros((32, 3))
    for k in range(32):
        sure2, sure1, agree = k >> 3, k >> 1 & 3, k & 1
        one[k] = FIRST0, 0.0 if agree and sure2 and sure1 else FIRST[sure1], FIRST[sure2]
    return np.tile(one, (lanes, 1))


def _recounts(length: int) -> list[int]:
    """Places at which order 0 is summed anew: after 32, 48, 72, ... ids."""
    out, at = [], 32
    while at < length:
        out.append(at)
        at += max(16, at // 2)
    return out


class Table:
    """The ids of a file by descending frequency; without one, all ids alike."""

    def __init__(self, ids: np.ndarray, level: np.ndarray):
        self.ids, self.level = ids, level
        self.rank = np.zeros(1 << 16, np.uint16)
        self.rank[ids] = np.arange(len(ids))

    @classmethod
    def of(cls, ids: np.ndarray | None = None) -> Table:
        if ids is None:
            return cls(np.arange(1 << 16, dtype=np.uint16), np.zeros(1 << 16, np.uint8))
        count = np.bincount(ids, minlength=1 << 16)
        order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        top = np.frexp(count[order].astype(np.float64))  # a count is in [half, 1) times 2 ** exponent
        return cls(order.astype(np.uint16), (2 * (top[1] - 1) + (top[0] >= 0.75)).astype(np.uint8))

    def to_bytes(self) -> bytes:
        return zlib.compress(self.ids.astype("<u2").tobytes() + self.level.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        n = len(raw) // 3
        return cls(np.frombuffer(raw, "<u2", n).astype(np.uint16), np.frombuffer(raw, np.uint8, n, 2 * n))

    def prior(self, lists: list[np.ndarray]) -> np.ndarray:
        """Shares of the ids of each list of ranks: 2, 3, 4, 6, 8, 12, ... by level."""
        level = self.level.astype(np.int64)
        weight = np.left_shift(1, level >> 1) * np.where(level & 1, 3.0, 2.0)
        out = np.zeros((len(lists), max(map(len, lists))))
        for line, ranks in zip(out, lists):
            line[: len(ranks)] = weight[ranks] / weight[ranks].sum()
        return out


def _pack(ranks: np.ndarray) -> bytes:
    gaps = np.diff(ranks, prepend=np.uint16(0)).astype("<u2").view(np.uint8)
    return zlib.compress(gaps[::2].tobytes() + gaps[1::2].tobytes(), 9, -15)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data, -15), np.uint8)
    n = len(raw) // 2
    return np.cumsum(raw[:n] + (raw[n:].astype(np.uint16) << 8), dtype=np.uint16)


def _shares(count: np.ndarray, prior: np.ndarray, own: np.ndarray, past: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of every id of each lane (one at least), and where they start."""
    free = SLOTS - own.astype(np.float64)
    seen = np.floor(free * (past / (past + PRIOR)))
    size = np.floor(count * (seen / max(past, 1))[:, None]) + np.floor(prior * (free - seen)[:, None]) + 1
    size[np.arange(count.shape[1]) >= own[:, None]] = 0
    start = np.cumsum(size, axis=1)
    return size.astype(np.uint16), (start - size).astype(np.uint16)


def _number(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ranks of a block in order, and for each place which of them it has."""
    there = np.zeros(1 << 16, bool)
    there[ranks] = True
    own = np.flatnonzero(there).astype(np.uint16)
    place = np.empty(1 << 16, np.uint16)
    place[own] = np.arange(len(own))
    return own, place[ranks]


def _follow(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each row: the id that followed its context last, and how sure that is.

    0: the context is new; 1: it came once, or its last two followers differ; 2, 3: they were
    the same twice, or more often.
    """
    n, length = ids.shape
    order = np.argsort(context, axis=1, kind="stable")
    ctx, nxt = np.take_along_axis(context, order, 1), np.take_along_axis(ids, order, 1)
    known = np.zeros((n, length), bool)
    known[:, 1:] = ctx[:, 1:] == ctx[:, :-1]
    last = np.zeros_like(nxt)
    last[:, 1:] = nxt[:, :-1]
    again = np.zeros((n, length + 1), bool)  # the follower at a place is that of the place before it
    again[:, 1:] = known & (nxt == last)
    sure = known.astype(np.uint8)
    sure[:, 1:] += known[:, 1:] & again[:, 1:-1]
    sure[:, 2:] += known[:, 2:] & again[:, 2:-1] & again[:, 1:-2]
    pred, conf = np.empty_like(nxt), np.empty_like(sure)
    np.put_along_axis(pred, order, last, 1)
    np.put_along_axis(conf, order, sure, 1)
    return pred, conf


def encode_blocks(blocks: list[np.ndarray], table: Table | None = None) -> list[bytes]:
    """Coded bytes of each block of ids, after the list of its ids; longest blocks first.

    Low ends and ranges are whole numbers below 2**49 in float64, so sums,
    products and rounded-down quotients are exact.  Words that are out may still
    get a carry; carries are settled at the end.
    """
    table = table or Table.of()
    lists, blocks = map(list, zip(*[_number(table.rank[b]) for b in blocks]))
    prior = table.prior(lists)
    own = np.array([len(x) for x in lists])
    vocab, n, length = int(own.max()), len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    live = np.searchsorted(-sizes, -np.arange(length), side="left")
    # what happens at each place of each lane: class of weights, what hits (0 order 0, 1, 2), steps below x, slots
    cls, hit, below, start, size = (np.empty((length, n), t) for t in (np.uint8, np.uint8, np.uint8, np.uint16, np.uint16))
    for a in range(0, n, SOME):
        b = min(a + SOME, n)
        ids = np.zeros((b - a, length), np.uint16)
        for i in range(a, b):
            ids[i - a, : sizes[i]] = blocks[i]
        prev, prev2 = np.zeros_like(ids), np.zeros_like(ids)
        prev[:, 1:], prev2[:, 2:] = ids[:, :-1], ids[:, :-2]
        p1, c1 = _follow(prev, ids)
        p2, c2 = _follow(_pair(prev, prev2).astype(np.uint16), ids)
        agree = (p1 == p2) & (c1 > 0) & (c2 > 0)
        cls[:, a:b] = _classes(c1, c2, agree).T
        right2, right1 = (p2 == ids) & (c2 > 0), (p1 == ids) & (c1 > 0) & ~agree
        hit[:, a:b] = (right2 * 2 + right1).T
        below[:, a:b] = ((p2 < ids) * 2 + (p1 < ids)).T
        count, lane, done = np.zeros((b - a, vocab), np.int32), np.arange(b - a)[:, None] * vocab, 0
        for at in [*_recounts(length), length]:
            sz, st = _shares(count, prior[a:b], own[a:b], done)
            x = lane + ids[:, done:at]
            size[done:at, a:b], start[done:at, a:b] = sz.ravel()[x].T, st.ravel()[x].T
            if at < length:
                count += np.bincount(x.ravel(), minlength=count.size).reshape(count.shape)
            done = at
    weight, base = _first_weights(n), np.arange(n) * 32
    flat_weight = weight.reshape(-1)
    out, ends = np.zeros((length + length // 4 + 16, n), np.uint32), np.zeros(n, np.int64)  # words of all lanes side by side
    low, rng = np.zeros(n), np.full(n, FULL)
    for t in range(length):
        m = live[t]
        at, h, u = base[:m] + cls[t, :m], hit[t, :m], below[t, :m]
        w = weight.take(at, axis=0)
        w0, w1, w2 = w[:, 0], w[:, 1], w[:, 2]
        total = (w0 + w1 + w2) * SLOTS
        first = w0 * start[t, :m] + (w1 * (u & 1) + w2 * (u >> 1)) * SLOTS
        share = w0 * size[t, :m] + (w1 * (h & 1) + w2 * (h >> 1)) * SLOTS
        unit = np.floor(rng[:m] / total)
        low[:m] += unit * first
        rng[:m] = unit * share
        while len(few := np.flatnonzero(rng[:m] < LEAST)):
            part, end = low.take(few), ends.take(few)
            if int(end.max()) + 4 >= len(out):
                out = np.concatenate([out, np.zeros_like(out)])
            word = np.floor(part / LEAST)
            out.reshape(-1)[end * n + few] = word
            ends[few] = end + 1
            low[few] = (part - word * LEAST) * WORD
            rng[few] *= WORD
        flat_weight[at * 3 + np.minimum(h, 2)] += HIT
    lanes = np.arange(n)
    for _ in range(3):
        word = np.floor(low / LEAST)
        out[ends, lanes] = word
        ends += 1
        low = (low - word * LEAST) * WORD
    out = out[: int(ends.max())]
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:-1] += carry[1:]
    heads, lines = [_pack(x) for x in lists], np.ascontiguousarray(out.astype("<u2").T)
    return [struct.pack("<H", len(h)) + h + lines[i, : ends[i]].tobytes() for i, h in enumerate(heads)]


class _Slots:
    """Order 0 of all lanes for the decoder: slots of ids, and the id of each slot."""

    def __init__(self, own: np.ndarray, prior: np.ndarray):
        n, self.own, self.prior, self.vocab = len(own), own, prior, int(own.max())
        self.count = np.zeros((n, self.vocab), np.int32)
        #: start and size of each id, one above the other in 32 bits
        self.both = np.zeros((n, self.vocab), np.uint32)
        self.symbol = np.zeros((n, SLOTS), np.uint16)
        self.slot_of = np.append(np.arange(self.vocab, dtype=np.uint16), np.uint16(self.vocab - 1))

    def count_in(self, ids: np.ndarray, m: int, past: int) -> None:
        """Sum anew after the ids (places x lanes) that have come since the last time."""
        for a in range(0, m, SOME):
            b = min(a + SOME, m)
            at = np.arange(b - a) * self.vocab + ids[:, a:b].astype(np.int64)
            self.count[a:b] += np.bincount(at.ravel(), minlength=(b - a) * self.vocab).reshape(b - a, -1)
            size, start = _shares(self.count[a:b], self.prior[a:b], self.own[a:b], past)
            self.both[a:b] = (start.astype(np.uint32) << np.uint32(16)) | size
            rest = SLOTS - size.sum(1, dtype=np.int64)  # slots that only broken files get to
            self.symbol[a:b] = np.repeat(np.tile(self.slot_of, b - a), np.column_stack([size, rest]).ravel()).reshape(b - a, SLOTS)


def decode_blocks(coded: list[bytes], sizes: list[int], table: Table | None = None) -> list[np.ndarray]:
    """Inverse of encode_blocks; ``sizes`` must not increase."""
    table, lists, rest = table or Table.of(), [], []
    for c in coded:
        (h,) = struct.unpack_from("<H", c)
        lists.append(_unpack(c[2 : 2 + h]))
        rest.append(c[2 + h :])
    own = np.array([len(x) for x in lists])
    vocab, n, length = int(own.max()), len(coded), sizes[0]
    data = np.zeros((n, max(map(len, rest)) // 2 + 8), np.uint16)
    for line, c in zip(data, rest):
        line[: len(c) // 2] = np.frombuffer(c, "<u2")
    data = np.ascontiguousarray(data.T)
    live = np.searchsorted(-np.array(sizes), -np.arange(length), side="left")
    slots, weight = _Slots(own, table.prior(lists)), _first_weights(n)
    flat_both, flat_symbol, flat_weight = slots.both.reshape(-1), slots.symbol.reshape(-1), weight.reshape(-1)
    above, mask = np.uint32(16), np.uint32(0xFFFF)
    lane = np.arange(n)
    base1, base2, base_slot, base_class = lane * vocab, lane * PAIRS, lane * SLOTS, lane * 32
    # an entry: the id that followed last, and in its two low bits how sure that is
    table1, table2 = np.zeros(n * vocab, np.uint16), np.zeros(n * PAIRS, np.uint16)
    prev, prev2 = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    ids = np.zeros((length, n), np.uint16)
    code, rng = np.array([LEAST, WORD, 1.0]) @ data[:3].astype(np.float64), np.full(n, FULL)
    flat, at_word = data.ravel(), 3 * n + lane
    turns, done = {0, *_recounts(length)}, 0
    for t in range(length):
        m = live[t]
        if t in turns:
            slots.count_in(ids[done:t], m, t)
            done = t
        at1, at2 = base1[:m] + prev[:m], base2[:m] + _pair(prev[:m], prev2[:m])
        e1, e2 = table1.take(at1), table2.take(at2)
        p1, p2, c1, c2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        s1, s2, same = c1 > 0, c2 > 0, p1 == p2
        at = base_class[:m] + _classes(c1, c2, same & s1 & s2)
        w = weight.take(at, axis=0)
        w0, w1, w2 = w[:, 0], w[:, 1] * SLOTS, w[:, 2] * SLOTS
        total = w0 * SLOTS + w1 + w2
        unit = np.floor(rng[:m] / total)
        v = np.minimum(np.floor(code[:m] / unit), total - 1)
        # where the predictions' intervals start and how wide they are; below them and between, order 0 decides
        both1, both2 = flat_both.take(base1[:m] + p1), flat_both.take(base1[:m] + p2)
        low1, low2 = w0 * (both1 >> above) + w2 * (p2 < p1), w0 * (both2 >> above) + w1 * (p1 < p2)
        wide1, wide2 = w0 * (both1 & mask) + w1 + w2 * same, w0 * (both2 & mask) + w2 + w1 * same
        from1, from2 = v >= low1, v >= low2
        hit1, hit2 = from1 & (v < low1 + wide1), from2 & (v < low2 + wide2)
        past = w1 * from1 + w2 * from2
        slot = np.minimum(np.maximum((v - past) / w0, 0.0), SLOTS - 1.0).astype(np.int64)  # of no use within those intervals
        x = flat_symbol.take(base_slot[:m] + slot)
        both = flat_both.take(base1[:m] + x)
        first, share = w0 * (both >> above) + past, w0 * (both & mask)
        for p, hit, low, wide in ((p1, hit1, low1, wide1), (p2, hit2, low2, wide2)):
            x, first, share = np.where(hit, p, x), np.where(hit, low, first), np.where(hit, wide, share)
        rng[:m] = np.maximum(unit * share, 1.0)
        code[:m] = np.minimum(np.maximum(code[:m] - unit * first, 0.0), rng[:m])  # changes broken files only
        while len(few := np.flatnonzero(rng[:m] < LEAST)):
            word = at_word.take(few)
            code[few] = code.take(few) * WORD + flat.take(word, mode="clip")
            at_word[few] = word + n
            rng[few] *= WORD
        right1, right2 = hit1 & s1, hit2 & s2
        flat_weight[at * 3 + np.where(right2, 2, right1)] += HIT
        fresh = (x << 2) + np.uint16(1)
        table1[at1], table2[at2] = np.where(right1, e1 + (c1 < 3), fresh), np.where(right2, e2 + (c2 < 3), fresh)
        prev2[:m] = prev[:m]
        prev[:m] = x
        ids[t, :m] = x
    return [table.ids[lists[i][np.minimum(ids[: sizes[i], i], len(lists[i]) - 1)]] for i in range(n)]


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocab: int) -> bytes:
    """The file of some documents' ids (uint16, one document after another)."""
    cuts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    table, coded = Table.of(ids), []
    for i in range(0, len(cuts), LANES):  # only the very last block is shorter
        coded += encode_blocks(cuts[i : i + LANES], table)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes())
    words = table.to_bytes()
    head = MAGIC + struct.pack(HEAD, vocab, len(doc_ids), len(ids), len(cuts), len(docs), len(words), zlib.crc32(docs + words))
    index = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(cuts, coded))
    return b"".join([head, docs, words, index, *coded])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids; fails if a block's checksum doesn't hold."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("no token-id file")
    at = len(MAGIC)
    _, n_docs, n_ids, n_blocks, n_table, n_words, crc = struct.unpack_from(HEAD, data, at)
    at += struct.calcsize(HEAD)
    if zlib.crc32(data[at : at + n_table + n_words]) != crc:
        raise ValueError("the head's checksum doesn't hold")
    docs = zlib.decompress(data[at : at + n_table])
    table = Table.from_bytes(data[at + n_table : at + n_table + n_words])
    at += n_table + n_words
    known = np.frombuffer(docs, np.uint8, n_docs)
    doc_ids = np.frombuffer(docs, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    index = [struct.unpack_from("<III", data, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    parts = []
    for i in range(0, n_blocks, LANES):
        some, coded = index[i : i + LANES], []
        for _, size, _ in some:
            coded.append(data[at : at + size])
            at += size
        for ids, (_, _, crc) in zip(decode_blocks(coded, [s for s, _, _ in some], table), some):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum doesn't hold")
            parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    if len(ids) != n_ids:
        raise ValueError("ids are missing")
    return [int(i) if k else None for i, k in zip(doc_ids, known)], lengths, ids


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes of a byte-level model, if each merge makes the token of the next id."""
    # the alphabet of byte-level models: printing characters stand for themselves, all other bytes follow from 256
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [x for x in range(256) if x not in printing]
    byte = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(other)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    ordered = None not in made and made == sorted(set(made))
    if not ordered or model.get("ignore_merges") or set(vocab) != set(byte) | {a + b for a, b in merges} or made[:1] < [256]:
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


def _tied(texts: pa.Array) -> pa.Array:
    """Whether a text can't be cut at its spaces: one of them follows other white space."""
    return pc.match_substring_regex(texts, TIED)


class Chunks:
    """Ids of parts of texts by a table of ranks; short parts are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(1 << 16, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.fast.encode_ordinary(text)).tobytes()

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, of which none but the first piece begins with a single space."""
        if len(self.known) > MAX_CHUNKS:
            self.known.clear()
        known = self.known
        new = list({c for c in chunks if c not in known})
        # those that begin with a space after no white space are pieces of their own side by side, too
        joined = [c for c in new if c[:1] == " " and not c[-1].isspace()]
        got = {c: self.whole(c) for c in set(new).difference(joined)}
        if joined:
            ids = np.array(self.fast.encode_ordinary("".join(joined)), np.uint16)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in joined])) + 1
            raw, ends = ids.astype("<u2").tobytes(), [0, *(2 * ends).tolist()]
            got.update((c, raw[x:y]) for c, x, y in zip(joined, ends, ends[1:]))
        known.update((c, i) for c, i in got.items() if len(c) <= CHUNK_CHARS)
        return [known[c] if c in known else got[c] for c in chunks]

    def after_spaces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each, one after another, and where each one's end; none may be empty or end in white space."""
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(" " + text), np.uint16)
        upto = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), upto) + 1


class LibraryPieces:
    """Ids of a tokenizer of the tokenizers library, one encoding for each distinct chunk.

    A byte-level tokenizer cuts a text by a pattern and merges the bytes of each
    piece.  A piece begins at every space that doesn't follow other white space,
    so Arrow cuts texts there and numbers the distinct chunks, which are encoded
    all in one text.  Where the tokenizer's
    merges are in the order of their ids, as is checked when it is loaded, its
    vocabulary is also a table of ranks, with which tiktoken gives the same ids
    in a fifth of the time; it then encodes the chunks.  Texts with other spaces are
    encoded whole; those with one of the library's special strings, and all texts
    if the tokenizer is of another kind, are left to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.vocab = self.lib.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # repr: a file may switch the pattern off or put a space first
        kind = repr(self.lib.pre_tokenizer)
        plain = isinstance(self.lib.model, models.BPE) and isinstance(self.lib.pre_tokenizer, pre_tokenizers.ByteLevel) and self.lib.normalizer is None and "add_prefix_space=False" in kind and "use_regex=True" in kind
        ranks = _ranks(json.loads(self.lib.to_str())["model"]) if plain else None
        self.chunks = Chunks(ranks) if ranks else None

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        sizes, out, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), [], 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + TEXTS, "right")))
            out += self._some(texts.slice(start, end - start))
            start = end
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        whole = pa.array([self.chunks is None] * len(texts))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        tied = pc.and_(_tied(texts), pc.invert(whole))
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.lib.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2").tobytes()
        for i in np.flatnonzero(tied.to_numpy(zero_copy_only=False)):
            out[i] = self.chunks.whole(texts[i].as_py())
        rest = np.flatnonzero(~pc.or_(whole, tied).to_numpy(zero_copy_only=False))
        if len(rest):
            for i, ids in zip(rest.tolist(), self._by_spaces(texts.take(pa.array(rest)))):
                out[i] = ids
        return out

    def _by_spaces(self, texts: pa.Array) -> list[bytes]:
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy()
        numbered = cut.values.dictionary_encode()
        words, index = numbered.dictionary, numbered.indices.to_numpy()
        first = np.zeros(len(index), bool)
        first[at[:-1]] = True  # has no space before it
        used = np.zeros(len(words), bool)
        used[index[~first]] = True
        loose = used & pc.match_substring_regex(words, LOOSE).to_numpy(zero_copy_only=False)
        plain, alone = np.flatnonzero(used & ~loose), np.flatnonzero(loose)
        ids, ends = self.chunks.after_spaces(words.take(pa.array(plain)))
        starts = words.take(pa.array(index[at[:-1]])).to_pylist()
        own = {c: self.chunks.whole(c) for c in {*starts, *(" " + words[i].as_py() for i in alone)}}
        more = [own[" " + words[i].as_py()] for i in alone] + [own[c] for c in starts]
        place = np.zeros(len(words), np.int32)
        place[plain], place[alone] = np.arange(len(plain)), len(plain) + np.arange(len(alone))
        index = place[index]
        index[at[:-1]] = len(plain) + len(alone) + np.arange(len(starts))
        ends = np.concatenate([[0], ends, len(ids) + np.cumsum([len(x) // 2 for x in more], dtype=np.int64)])
        table = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids, np.frombuffer(b"".join(more), "<u2")])))
        got = table.take(pa.array(index))
        raw, bounds = got.values.to_numpy().tobytes(), (2 * got.offsets.to_numpy()[at]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


@cache
def library(path: str) -> LibraryPieces:
    """One for each worker process."""
    return LibraryPieces(path)


CACHES["idfile"] = library


def write_ids(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode texts in ascending order of id and write their files as rows (part, seq, n_ids, file) below ``path``."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_only("idfile")
        part, seq, lib = TaskContext.get().partitionId(), 0, library(tokenizer)
        if lib.vocab > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        docs, lengths, held, n = [], [], [], 0

        def file() -> pa.RecordBatch:
            image = write_file(docs, lengths, np.frombuffer(b"".join(held), "<u2"), lib.vocab)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": n, "file": image}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), lib.encode(pc.fill_null(batch.column(1), ""))):
                ids += end
                if docs and n + len(ids) // 2 > FILE_IDS:
                    yield file()
                    docs, lengths, held, n, seq = [], [], [], 0, seq + 1
                docs.append(doc_id)
                lengths.append(len(ids) // 2)
                held.append(ids)
                n += len(ids) // 2
        if docs:
            yield file()

    rows = df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "part int, seq int, n_ids long, file binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part int, seq int, n_ids long, file binary").parquet(path)
    # ids before each part, then before each file of a part
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = per_part.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base = files.select("part", "seq", "n_ids").withColumn("inside", F.sum("n_ids").over(inner) - F.col("n_ids")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                docs, lengths, ids = read_file(data)
                ends = np.cumsum(lengths)
                own = [ids[e - k : e] for e, k in zip(ends, lengths)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                for a in range(0, len(docs), 4096):
                    b = min(a + 4096, len(docs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (b - a), pa.int32()), pa.array([seq] * (b - a), pa.int32()), pa.array(docs[a:b], pa.int64()), pa.array(ends[a:b] - lengths[a:b], pa.int64()), pa.array(lengths[a:b], pa.int64()), pa.array(crc[a:b], pa.int64())],
                        names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                    )

    read = files.mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, "token-ids")
    write_ids(df, path)
    return read_ids(spark, path)
