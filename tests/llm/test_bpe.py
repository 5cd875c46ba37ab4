import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD, documents, table

from strandweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(PATH, public_tokenizers.PATTERN)


def test_random_texts(library, own):
    rng = random.Random(4)
    kinds = ["abcdefg ", "aaab", " \n\t\r", "äöüß漢字кириллица😀é", "0123456789.,", "the and ing tion "]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 120)))
        assert own.encode(text) == library.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, " " * 5000, "x" + "é" * 3000, "<|endoftext|>", "\0\0\0"])
def test_long_pieces(library, own, text):
    assert own.encode(text) == library.encode_ordinary(text)


def test_streams_are_the_whole(own):
    piece = b"internationalization" * 300
    parts = list(own.fst.stream(piece))
    assert len(parts) > 3 and [t for p in parts for t in p] == own.fst.merge(piece)


def test_states_made_anew(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    fresh = bpe.Tokenizer(own.fst.ranks, public_tokenizers.PATTERN)
    text = "Several different words, and then some others again."
    assert fresh.encode(text) == library.encode_ordinary(text)


def test_utf8_machine():
    rng, text = random.Random(1), "aé漢😀z" * 50
    data, machine, out, at = text.encode(), bpe.Utf8Machine(), "", 0
    while at < len(data):
        step = rng.randint(1, 5)
        out += machine.feed(data[at : at + step])
        at += step
    assert out + machine.feed(b"", last=True) == text
    with pytest.raises(UnicodeDecodeError):
        bpe.Utf8Machine().feed(b"\xe6\xbc", last=True)
    assert bpe.Utf8Machine("replace").feed(b"a\xff\xe6", last=True).startswith("a�")


@pytest.mark.parametrize("odd", [True, False])
def test_digests(spark, library, odd):
    df = table(spark, ODD) if odd else documents(spark)
    want = []
    for r in df.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digests(df).collect()), key=str) == sorted(want, key=str)


def test_rows_with_ids(spark, own):
    got = bpe.encode_rows(table(spark, ODD), ["doc_id", "key"]).collect()
    assert all(r.round_trip and len(r.token_ids) == r.n_tokens for r in got) and len(got) == len(ODD)
    assert bpe.bpe_digests(table(spark, [])).collect() == []
