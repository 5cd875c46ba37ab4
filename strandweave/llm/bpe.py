"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if each token encodes
to itself and each neighbouring pair re-encodes to that pair.  So every prefix
of a piece has one last token, found among the tokens that end there by looking
at one predecessor each.  The transducer reads bytes; its state holds the
alternatives still alive: an unfinished token (a prefix of vocabulary entries)
and the token before it.  What all alternatives share is emitted, at the end of
a piece or of a window, after a lookahead of a few tokens.
States and transitions are made when first met and kept; when there are more
than ``MAX_STATES`` they are made anew.

Decoding joins token bytes and runs them through an incremental UTF-8 machine,
so that characters that tokens split come out whole.

Nulls and empty texts have no tokens.  Long texts are matched and emitted in
chunks.  Each row stands alone.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHES, byte_groups, keep_only

MAX_STATES = 150_000
#: Bytes after which settled tokens are emitted.
WINDOW = 1024
#: Pieces of at most so many characters are remembered (and pairs), and so many before a cache starts anew.
PIECE_CHARS, MAX_PIECES = 64, 250_000
#: Characters matched at once, pieces joined and ids decoded at once.
CHUNK = 1 << 20
PIECES = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes pieces of bytes by the merges that ``ranks`` imply.

    A state is a tuple of alternatives (bytes of an unfinished token, the token
    before it); a move gives the next state and the token that ends the prefix
    read so far.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._fresh()

    def _fresh(self) -> None:
        start = ((b"", None),)
        self.states, self.number, self.moves = [start], {start: 0}, {}

    def merge(self, piece: bytes, until: int = 1) -> list[int]:
        """By definition: join the pair of lowest rank, leftmost first, until none (or ``until`` parts) is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > until:
            best, at = min((get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that were joined last to make this one; itself twice for a byte; None if merging doesn't make it."""
        got = self.halves.get(token, 0)
        if got == 0:
            name = self.names[token]
            got = None
            if len(name) == 1:
                got = token, token
            elif self.merge(name) == [token]:
                got = tuple(self.merge(name, 2))
            self.halves[token] = got
        return got

    def follows(self, a: int | None, b: int) -> bool:
        """Whether token ``b`` can stand after ``a`` in an encoding.

        Undoes the merges of both sides, latest first: had the parts at the
        border been joinable by an earlier merge, it would have been taken.
        """
        if self.split(b) is None:
            return False
        if a is None:
            return True
        names, get, limit = self.names, self.ranks.get, 1 << 60
        while True:
            joined = get(names[a] + names[b])
            if joined is not None and joined < limit:
                return False
            left, right = len(names[a]) > 1, len(names[b]) > 1
            if not (left or right):
                return True
            # of equal tokens the left one was made first, so the right one is undone first
            if left and (not right or a > b):
                limit, a = a, self.split(a)[1]
            else:
                limit, b = b + 1, self.split(b)[0]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        step, token, grown = bytes((byte,)), None, []
        for open_, last in self.states[state]:
            longer = open_ + step
            if token is None:
                t = self.ranks.get(longer)
                if t is not None and self.follows(last, t):
                    token = t
            if longer in self.prefixes:
                grown.append((longer, last))
        new = (*grown, (b"", token))
        k = self.number.get(new)
        if k is None:
            k = self.number[new] = len(self.states)
            self.states.append(new)
        self.moves[state << 8 | byte] = k, token
        return k, token

    def _back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the prefix of ``at`` bytes, last first."""
        out, names = [], self.names
        while at > 0:
            t = ends[at - 1]
            out.append(t)
            at -= len(names[t])
        return out

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Token ids of one piece, each emitted once all alternatives share it."""
        if len(self.states) > MAX_STATES:
            self._fresh()
        state, moves, ends, limit = 0, self.moves, [], WINDOW
        for byte in piece:
            got = moves.get(state << 8 | byte)
            if got is None:
                got = self._move(state, byte)
            state, token = got
            ends.append(token)
            if len(ends) >= limit:
                chains = [self._back(ends, len(ends) - len(o))[::-1] for o, _ in self.states[state]]
                shared = []
                for same in zip(*chains):
                    if any(t != same[0] for t in same):
                        break
                    shared.append(same[0])
                if shared:
                    yield shared
                    del ends[: sum(len(self.names[t]) for t in shared)]
                # what can't be told yet is held, and looked at again after as many bytes
                limit = max(WINDOW, len(ends) + WINDOW // 2)
        yield self._back(ends, len(ends))[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else [t for part in self.stream(piece) for t in part]


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the text of all characters that are complete."""

    def __init__(self, errors: str = "strict"):
        self.held, self.errors = b"", errors

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        end = len(data)
        if not last:
            for back in range(1, min(4, end) + 1):
                b = data[end - back]
                if b >= 0xC0:  # a lead byte; complete if as many bytes follow as it asks for
                    if back < (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2):
                        end -= back
                    break
                if b < 0x80:
                    break
        self.held = data[end:]
        return data[:end].decode("utf-8", self.errors)


class Tokenizer:
    """Pieces by pattern, each encoded by the transducer; a bounded cache keeps pieces' ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.names = [self.fst.names.get(i, b"") for i in range(max(self.fst.names, default=-1) + 1)]
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = b"".join(i.to_bytes(4, "little") for i in outer.fst.encode(piece.encode()))
                if len(piece) <= PIECE_CHARS:
                    if len(self) > MAX_PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def encode_bytes(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, chunk by chunk."""
        if len(text) <= CHUNK:
            yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, PIECES)):
            yield b"".join(map(self.pieces.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_bytes(text) for i in memoryview(part).cast("I")]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], errors: str = "strict") -> Iterator[str]:
        """Text as it becomes known, for ids as they come."""
        machine, ids = Utf8Machine(errors), iter(ids)
        while some := list(islice(ids, PIECES)):
            yield machine.feed(self.decode_bytes(some))
        yield machine.feed(b"", last=True)


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(read_ranks(path), pattern)


CACHES["bpe"] = tokenizer


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return counts and digests."""
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe")
        t = tokenizer(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                count, a, b, machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8Machine()
                for part in t.encode_bytes(text or ""):
                    count += len(part) // 4
                    a.update(part)
                    b.update(machine.feed(t.decode_bytes(memoryview(part).cast("I").tolist())).encode())
                b.update(machine.feed(b"", last=True).encode())
                n.append(count)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def encode_rows(df: DataFrame, keep: list[str], path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, token_ids and round_trip (the ids decode to the text); null texts have no ids."""
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    rows = df.select(df[text_col].alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe")
        t = tokenizer(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in byte_groups(texts, CHUNK):
                ids = [b"".join(t.encode_bytes(x)) for x in texts[a:b]]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                same = [t.decode_bytes(memoryview(i).cast("I").tolist()).decode("utf-8", "replace") == x for i, x in zip(ids, texts[a:b])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(n), lists, pa.array(same, pa.bool_())], names=[*keep, "n_tokens", "token_ids", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, token_ids array<int>, round_trip boolean")
