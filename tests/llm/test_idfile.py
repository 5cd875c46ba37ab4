import lzma
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import ODD, documents, table
from tokenizers import Tokenizer

from strandweave.llm import idfile


def blocks(seed=1):
    rng = np.random.default_rng(seed)
    zipf = lambda n: np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint16)
    out = [zipf(3000), np.tile(zipf(40), 60), np.zeros(900, np.uint16), zipf(257), np.arange(256, dtype=np.uint16), zipf(1)]
    return sorted(out, key=len, reverse=True)


def test_blocks_round_trip():
    b = blocks()
    coded = idfile.encode_blocks(b)
    for x, y in zip(b, idfile.decode_blocks(coded, [len(x) for x in b])):
        assert (x == y).all()
    assert len(coded[0]) < 2 * 3000 and min(map(len, coded)) < 40


def test_blocks_are_independent():
    b = blocks()
    alike = [b[2], b[2]]
    assert idfile.encode_blocks(alike)[1] == idfile.encode_blocks([b[2]])[0]
    alone = idfile.decode_blocks([idfile.encode_blocks([b[2]])[0]], [len(b[2])])[0]
    assert (alone == b[2]).all()


def test_files_and_checksums():
    ids = np.concatenate(blocks(3))
    lengths = [5, 0, len(ids) - 5]
    data = idfile.write_file([None, 7, -9], lengths, ids, 50257)
    docs, sizes, back = idfile.read_file(data)
    assert docs == [None, 7, -9] and sizes.tolist() == lengths and (back == ids).all()
    bad = bytearray(data)
    bad[-200] ^= 1
    with pytest.raises(ValueError):
        idfile.read_file(bytes(bad))
    with pytest.raises(ValueError):
        idfile.read_file(b"nothing")


def test_pieces_against_whole_texts():
    rng = random.Random(9)
    lib = idfile.library(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["word", "it's", " ", "  ", "\n", "\t", "\r\n", "é漢", "12", "...", "\u00a0", "\u2003", "\0", "\x1c", "x" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in lib.lib.encode_batch(texts, add_special_tokens=False)]
    assert lib.encode(texts) == want and lib.encode(texts) == want


def test_words_of_many_texts_are_encoded_together():
    rng = random.Random(4)
    lib = idfile.LibraryPieces(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(rng.choice("abcdeäß漢'1.\n") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", "", " ", "\n", "\u2003", " x" * 40]) for _ in range(2000)]
    texts += ["", " ", "one", "one ", "\n", "long" * 500, " " + "long" * 500]
    want = [np.array(e.ids, "<u2").tobytes() for e in lib.lib.encode_batch(texts, add_special_tokens=False)]
    calls, whole = [], lib.chunks.whole
    lib.chunks.whole = lambda text: calls.append(text) or whole(text)
    assert lib.encode(texts) == want
    assert len(calls) <= 1.2 * len(texts) and not lib.chunks.known


def test_numbers_and_slots_of_blocks():
    for b in blocks(5):
        own, at = idfile._number(b)
        want = np.unique(b, return_inverse=True)
        assert (own == want[0]).all() and (at == want[1]).all()
    own, prior = np.array([3, 1]), np.array([[0.5, 0.25, 0.25], [1.0, 0, 0]])
    slots = idfile._Slots(own, prior)
    slots.count_in(np.array([[0, 0], [2, 0], [2, 0]]), 2, 3)
    for i, n in enumerate(own):
        for x in range(n):
            start, size = slots.both[i, x] >> 16, slots.both[i, x] & 0xFFFF
            assert size > 0 and (slots.symbol[i, start : start + size] == x).all()


def test_compresses_better_than_order_0():
    text = "the model predicts the next token of the text and the text is made of tokens " * 300
    ids = np.array(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text).ids, np.uint16)
    assert len(idfile.encode_blocks([ids[: idfile.BLOCK]])[0]) < len(ids[: idfile.BLOCK]) / 2


@pytest.mark.parametrize("odd", [True, False])
def test_documents(spark, odd):
    df = table(spark, [*ODD, (11, "a special <|endoftext|> inside", "en", "x")]) if odd else documents(spark)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    rows = df.select("doc_id", "text").collect()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, idfile.write_and_read(df).collect()), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert idfile.write_and_read(table(spark, [])).collect() == []


def test_spaces_that_are_balanced_by_other_white_space():
    tied = lambda *t: idfile._tied(pa.array(t)).to_pylist()
    assert tied("a   b\tc\td", "a\n \nb\tc\td", "a\u00a0 b", "a\x1c b", "\u2003 ", "a\x85 b") == [True] * 6
    assert tied("a b\tc\nd", " a", "a ", "") == [False] * 4


def test_less_than_order_0_and_lzma():
    """Bits an id over documents, files' heads included: under each block's own entropy with its table of ids and counts, and under lzma."""
    lib = idfile.library(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.frombuffer(b"\0\0".join(lib.encode([t or "" for t in texts])), "<u2")
    some = [ids[i : i + idfile.BLOCK] for i in range(0, len(ids) - idfile.BLOCK, idfile.BLOCK)][:200]
    ids = np.concatenate(some)
    data = idfile.write_file([1], [len(ids)], ids, lib.vocab)
    assert (idfile.read_file(data)[2] == ids).all()
    found = [np.unique(b, return_counts=True) for b in some]
    entropy = sum(float(-(c * np.log2(c / c.sum())).sum()) for _, c in found)
    tables = 8 * sum(len(zlib.compress(np.diff(x, prepend=0).astype("<u2").tobytes() + c.astype("<u2").tobytes(), 9)) for x, c in found)
    packed = 8 * sum(len(lzma.compress(b.tobytes(), format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9}])) for b in some)
    bits, n = 8 * len(data), len(ids)
    print(f"bits an id: {bits / n:.2f}; order 0 {entropy / n:.2f}, tables {tables / n:.2f}; lzma {packed / n:.2f}")
    assert bits < entropy + tables and bits < packed
