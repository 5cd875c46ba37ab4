import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, WORD, documents, table

from strandweave.llm import neardup
from strandweave.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, width, percent=80):
    """(doc_id, text) to (doc_id, n, component, kept), all pairs compared."""
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(width, len(w))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def found(df, width):
    return sorted(map(tuple, neardup.near_duplicates(df, width=width).collect()), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_documents(spark, width):
    df = documents(spark)
    assert found(df, width) == plainly([(r.doc_id, r.text) for r in df.collect()], width)


def test_chains_of_edits_and_copies(spark):
    rng, rows = random.Random(8), []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(rng.choice([1, 4, 25])):
            if rng.random() < 0.6:
                words = list(words)
                words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
            rows.append((rng.randrange(10**6), " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rows += rows[:5]
    assert found(table(spark, [(i, t, None, None) for i, t in rows]), 4) == plainly(rows, 4)


def near_copies(n, seed, off=0.06, size=120):
    """Copies of one text that resemble it, but each other hardly."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows = [(rng.randrange(10**6), " ".join(base))]
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(size), max(1, int(size * off / 4 * rng.uniform(0.5, 1.6)))):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    return rows


@pytest.mark.parametrize("group, elect, levels", [(1024, 4, 3), (8, 10**6, 3), (8, 10**6, 1)])
def test_groups_around_a_hidden_centre(spark, monkeypatch, group, elect, levels):
    """By elected centres, by buckets that are split, and by blocks of buckets."""
    for k, v in (("GROUP", group), ("ELECT", elect), ("LEVELS", levels)):
        monkeypatch.setattr(neardup, k, v)
    rows = [r for seed in range(3) for r in near_copies(40, seed, 0.03 + 0.03 * seed)]
    got, want = found(table(spark, [(i, t, None, None) for i, t in rows]), 4), plainly(rows, 4)
    assert got == want and len({r[2] for r in want}) < len(want)


def test_the_member_nearest_to_the_majority_is_elected():
    sets = [set(t.split()) for _, t in near_copies(50, 3)]
    odd = np.stack([neardup.odd_sketch(neardup.samples(np.array(sorted(hash(w) % (1 << 63) for w in s), np.uint64))) for s in sets])
    assert int(np.argmin(neardup._off_centre(odd))) == 0


def test_odd_rows(spark):
    assert found(table(spark, ODD), 4) == plainly([(i, t) for i, t, _, _ in ODD], 4)
    assert found(table(spark, []), 4) == []
    with pytest.raises(ValueError):
        neardup.near_duplicates(table(spark, ODD), percent=50)


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.7, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(1000 * share), np.uint64)
            rest = int(1000 * (1 - share) / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rest, np.uint64)])) for _ in range(2))
            odd = np.bitwise_count((neardup.odd_sketch(neardup.samples(a)) ^ neardup.odd_sketch(neardup.samples(b))).view(np.uint64)).sum()
            estimate = 1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * odd / neardup.BITS)
            errors.append(estimate - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_pairs_across_components_in_blocks():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 64, 400, np.uint64))
    sets = []
    for _ in range(30):  # similar to the base, and to each other at about 0.8 to 0.9
        out = base.copy()
        out[rng.choice(len(base), 20, replace=False)] = rng.integers(0, 1 << 64, 20, np.uint64)
        sets.append(np.unique(out))
    sigs = [neardup.samples(s) for s in sets]
    n = len(sets)
    bands = np.stack([neardup.band_keys(s) for s in sigs])
    bands[:, 0] = 7  # they all meet in the first band
    cols = {"k": [7] * n, "i": [0] * n, "j": [0] * n, "own": [0] * n, "doc_id": list(range(n)), "g": list(range(n)), "n": [len(s) for s in sets]}
    lists = {"odd": [neardup.odd_sketch(s).tolist() for s in sigs], "bands": bands.tolist(), "split": [[]] * n}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()} | {k: pa.array(v, pa.list_(pa.int64())) for k, v in lists.items()})
    rows = list(neardup._across(80)(iter([batch.slice(0, 11), batch.slice(11)])))
    links = {(a, b) for b in range(n) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    touched = {x for out in rows for x in out["doc_id"].to_pylist()}
    assert len(links) > 300 and {x for p in links for x in p} <= touched
    with_sets = pa.Table.from_batches(rows)
    with_sets = with_sets.append_column("s", pa.array([sets[x].tobytes() for x in with_sets["doc_id"].to_pylist()]))
    got = {(a, b) for out in neardup._links(80)(iter(with_sets.to_batches())) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    assert got <= links and len(got) == len({x for p in links for x in p}) - 1  # all are reached, by a tree


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, x) for x in range(1001, 1400)] + [(2000 + i, 2001 + i) for i in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_workers_hand_memory_back():
    script = """
import random, pyarrow as pa
from strandweave.llm import neardup
def mb():
    return next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) / 1024
rng, before = random.Random(1), mb()
words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(20000)]
def batches():
    for i in range(2):
        yield pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array([" ".join(rng.choices(words, k=250)) for _ in range(8000)])], names=["doc_id", "text"])
most = max(mb() for _ in neardup._sketch(5)(batches()))
print(mb() - before, most - before)
"""
    left, most = map(float, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=100).stdout.split())
    assert left < 0.5 * most
