import base64
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import ODD, SF, documents, table
from tokenizers import Tokenizer

from strandweave.llm import queries, rollup
from strandweave.llm.common import append_once, list_names, scratch

DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def rows_of(r):
    return {tuple(x) for x in r.totals().collect()}


def change(spark, *rows):
    return spark.createDataFrame(rows, DELTA)


def test_signed_batches_and_replays(spark):
    r = rollup.TokenRollup(spark, scratch(spark, "t"))
    assert rows_of(r) == set()
    insert = change(spark, ("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 2), ("b", "de", "v1", None, None))
    assert r.commit("1", insert) and not r.commit("1", insert)
    r.commit("2", change(spark, ("a", "en", "v1", -1, -5), ("a", "en", "v1", -1, -10), ("a", "en", "v2", 1, 12)))
    r.commit("3", spark.createDataFrame([], DELTA))
    assert rows_of(r) == {(None, None, "v1", 1, 2), ("a", "en", "v2", 1, 12)} and r.batches == ["1", "2", "3"]


def test_another_process_sees_the_same(spark):
    """After a restart, after a replay of what was compacted, and with a batch that has a compacted one's name."""
    r = rollup.TokenRollup(spark, scratch(spark, "t"))
    ten, three = change(spark, ("a", "en", "v", 1, 10)), change(spark, ("a", "en", "v", 0, 3))
    r.commit("base", ten)
    r.commit("2", three)
    want = {("a", "en", "v", 1, 13)}
    again = rollup.TokenRollup(spark, r.path)
    assert rows_of(again) == want
    again.compact()
    assert rows_of(r) == rows_of(again) == want
    third = rollup.TokenRollup(spark, r.path)
    assert not third.commit("base", ten) and not third.commit("2", three) and rows_of(third) == want
    third.vacuum()
    assert rows_of(r) == want and len(list_names(spark, f"{r.path}/data")) == 1 and r.batches == ["2", "base"]
    assert r.commit("3", three) and rows_of(third) == {("a", "en", "v", 1, 16)}
    third.compact()
    assert rows_of(r) == {("a", "en", "v", 1, 16)}


def test_what_died_before_it_was_logged_doesnt_count(spark, monkeypatch):
    r = rollup.TokenRollup(spark, scratch(spark, "t"))
    one = change(spark, ("a", "en", "v", 1, 10))
    r.commit("1", one)

    def dies(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(rollup, "append_once", dies)
        for step in (lambda: r.commit("2", one), r.compact):
            with pytest.raises(RuntimeError):
                step()
    assert rows_of(r) == {("a", "en", "v", 1, 10)} and len(list_names(spark, f"{r.path}/data")) == 3
    assert r.commit("2", one) and rows_of(r) == {("a", "en", "v", 2, 20)}


def test_two_writers(spark, monkeypatch):
    """A commit that comes between another's reading and logging."""
    r, s = (rollup.TokenRollup(spark, p) for p in [scratch(spark, "t")] * 2)
    one, write = change(spark, ("a", "en", "v", 1, 10)), r._write

    def late(changes):
        s.commit("other", one)
        return write(changes)

    monkeypatch.setattr(r, "_write", late)
    assert r.commit("mine", one) and rows_of(s) == {("a", "en", "v", 2, 20)}
    r.compact()
    assert rows_of(s) == {("a", "en", "v", 2, 20)}


def test_files_that_are_never_replaced(spark):
    path = scratch(spark, "t") + "/log/1"
    assert append_once(spark, path, "a") and not append_once(spark, path, "b")
    assert list_names(spark, path.rsplit("/", 1)[0]) == ["1"]


def libraries():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: len(one.encode(t, add_special_tokens=False).ids), lambda t: len(multi.encode_ordinary(t))


def plainly(rows):
    one, two = libraries()
    seen, out = set(), Counter()
    for doc_id, text, lang, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3] is not None, r[3] or "", r[2] is not None, r[2] or "")):
        if text is not None and text in seen:
            continue
        seen.add(text)
        a, b = one(text or ""), two(text or "")
        out[source, lang, "byte_bpe_50k" if a == b else "byte_bpe_multi_50k", "n"] += 1
        out[source, lang, "byte_bpe_50k" if a == b else "byte_bpe_multi_50k", "t"] += b
    return {(*k[:3], out[(*k[:3], "n")], out[(*k[:3], "t")]) for k in out}


def test_documents(spark):
    rows = documents(spark).select("doc_id", "text", "lang", "source").collect()
    assert {tuple(x) for x in queries.op2_token_rollup(spark, SF).collect()} == plainly(rows)


def test_odd_documents(spark):
    odd = [*ODD, (12, "a special <|endoftext|> and  two spaces \n x ", "en", "web"), (1, "one", "en", "tiny"), (8, "one", "de", "tiny")]
    assert rows_of(rollup.document_rollup(table(spark, odd))) == plainly([r[:4] for r in odd])
    assert rows_of(rollup.document_rollup(table(spark, []))) == set()


def test_counts_against_the_libraries():
    texts = [" ", "", "a", " a", "a  b", "a \nb", "x" * 5000, "é漢 12 ... it's", "<|endoftext|>", "tab\tand space "]
    paths = [public_tokenizers.path(f) for f in rollup.VERSIONS.values()]
    got = rollup.count_tokens(pa.array(texts), [rollup.counter(p) for p in paths])
    for g, f in zip(got, libraries()):
        assert g.tolist() == [f(t) for t in texts]
