import zlib
from collections import defaultdict

import numpy as np
from helpers import ODD, documents, table

from strandweave.llm import sharding


def check(df, n=40):
    rows = sharding.assign_shards(df, n).collect()
    source = defaultdict(list)
    for r in df.collect():
        b = (r.text or "").encode()
        source[r.doc_id].append((len(b) + 16, zlib.crc32(b)))
    assert sorted(((r.doc_id, (r.size, r.text_crc32)) for r in rows), key=str) == sorted(((i, x) for i, xs in source.items() for x in xs), key=str)
    shards, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, longest = sum(shards.values()), max((r.size for r in rows), default=0)
    assert all(abs(shards[s] - total / n) <= longest for s in range(n) if rows)
    return rows


def test_documents(spark):
    check(documents(spark))


def test_odd_rows(spark):
    check(table(spark, ODD), 4)
    assert sharding.assign_shards(table(spark, [])).collect() == []


def test_a_text_with_very_many_copies_is_subdivided(spark):
    df = table(spark, [(i, "the same text again" if i % 3 else f"another text {i}", None, "s") for i in range(3000)])
    rows = check(df, 10)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the same text again")}) > 4
    assert sorted(map(str, rows)) == sorted(map(str, sharding.assign_shards(df.repartition(7), 10).collect()))


def test_boundaries():
    keys, w = np.arange(1000), np.ones(1000)
    assert len(sharding.boundaries(keys, w, 10)) == 9
    assert len(sharding.boundaries(np.full(50, 7), np.ones(50), 10)) == 1
    assert len(sharding.boundaries(np.zeros(0, np.int64), np.zeros(0), 10)) == 0
