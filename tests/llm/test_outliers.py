import math
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, WORD, documents, table

from strandweave.llm import outliers as o
from strandweave.llm import queries


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def vector(n, chars, symbols, dup, repeat):
    n = max(n, 1)
    raw = [math.log(max(chars, 1) / n), math.sqrt(symbols / max(chars, 1)), math.sqrt(repeat / n), math.sqrt(min(dup * 10 / n, 1.0))]
    return [math.floor(x * o.SCALE + 0.5) for x in raw]


def judged(rows):
    """doc places to verdicts, by numpy on whole groups."""
    stats = [base(r.text) for r in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if not failed[i]:
            groups[r.lang, r.source].append(i)
    small = Counter()
    for (lang, _), g in groups.items():
        small[lang] += len(g) if len(g) < o.MIN_GROUP else 0
    pooled = defaultdict(list)
    for (lang, source), g in groups.items():
        pooled[("own", lang, source) if len(g) >= o.MIN_GROUP else ("lang", lang) if small[lang] >= o.MIN_GROUP else ("all",)] += g
    floor = np.diag([(o.SCALE * x) ** 2 for x in o.LEAST])
    kept = [not f for f in failed]
    for g in pooled.values():
        if len(g) < o.MIN_FIT:
            continue
        x = np.array([vector(*stats[i]) for i in g], float)
        half = lambda v: np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]
        d2 = lambda m, c: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
        med = half(x)
        starts = [(med, np.diag((half(np.abs(x - med)) * 1.4826) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)]
        best = None
        for m, c in starts:
            for _ in range(o.STEPS):
                bins = np.minimum(d2(m, c) * 64, o.BINS).astype(int)
                near = x[bins <= half(bins)]
                m, c = near.mean(0), np.cov(near.T, bias=True) * o.HALF_FACTOR + floor
            det = np.linalg.det(c)
            if best is None or det < best[0] * (1 - 1e-9):
                best = det, m, c
        inside = x[d2(*best[1:]) <= o.REWEIGHT]
        m, c = inside.mean(0), np.cov(inside.T, bias=True) + floor
        for i, bad in zip(g, d2(m, c) > o.LIMIT):
            kept[i] = not bad
    return [(r.doc_id, *s, f, k) for r, s, f, k in zip(rows, stats, failed, kept)]


COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_against_numpy(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    got = sorted(tuple(r[c] for c in COLS) for r in o.judge(df).collect())
    want = sorted(judged(df.collect()))
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert [g[0] for g, w in zip(got, want) if g != w] == []
    assert 0 < sum(not r[7] for r in got)


def test_junk_is_rejected_and_prose_stays(spark):
    prose = [(i, " ".join(f"w{(i * 31 + j * 17) % 997}{'abcdefgh'[: (i + j) % 5]}" for j in range(80)), "en", "web") for i in range(80)]
    junk = [(1000, " ".join(["$$##%%&&|<>"] * 20 + [f"x{i}" for i in range(60)]), "en", "web"), (1001, " ".join(f"verylongwordthatgoesonandon{i}" * 9 for i in range(60)), "en", "web")]
    got = {r.doc_id: r.kept for r in o.judge(table(spark, prose + junk)).collect()}
    assert all(got[i] for i in range(80)) and not got[1000] and not got[1001]


def test_each_statistic_rejects_by_itself(spark):
    words = lambda i, n: [f"w{(i * 31 + j * 17) % 997}{'abcdefgh'[: (i + j) % 5]}" for j in range(n)]
    prose = [(i, " ".join(words(i, 80)), "en", "web") for i in range(80)]
    same = " ".join(words(500, 100)[:15])
    repeats = " ".join([same] * 3 + words(501, 55))  # 45 of 100 words
    symbols = " ".join(words(502, 76) + ["%#&|"] * 4)
    longer = " ".join(w + "xx" for w in words(503, 80))
    lines = "\n".join(" ".join(words(504 + i, 20)) for i in range(4)) + "\nab cd\nab cd\nab cd\nab cd"
    one = " ".join(words(505, 77) + words(505, 3))  # a repeated window and a symbol stay
    odd = [(1000, repeats, "en", "web"), (1001, symbols, "en", "web"), (1002, longer, "en", "web"), (1003, lines, "en", "web"), (1004, one + " %", "en", "web")]
    assert base(repeats)[4] == 45 and base(lines)[3] == 3 and base(one)[4] == 6
    got = {r.doc_id: (r.base_failed, r.kept) for r in o.judge(table(spark, prose + odd)).collect()}
    assert all(got[i] == (False, True) for i in [*range(80), 1004])
    assert [got[i] for i in range(1000, 1004)] == [(False, False)] * 4


def test_odd_rows(spark):
    df = table(spark, ODD)
    got = sorted((tuple(r[c] for c in COLS) for r in o.judge(df).collect()), key=str)
    assert got == sorted(judged(df.collect()), key=str)
    assert o.judge(table(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    from helpers import SF

    plan = queries.op4_outliers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
