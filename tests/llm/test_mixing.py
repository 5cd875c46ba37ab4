from collections import Counter, defaultdict

from helpers import ODD, SF, WORD, documents, same, table

from strandweave.llm import mixing, queries


def targets(sizes, most=3, weights=(1, 2, 3)):
    """By repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: rest * weight[s] / w for s in open_}
        full |= {s: most * sizes[s] for s in over}


def test_oracle(spark):
    same(queries.op9_mix_sources(spark, SF), mixing.ORACLE)


def test_odd_rows(spark):
    df = table(spark, ODD)
    rows = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s in ODD:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), Counter()
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(ODD) and all(int(want[s]) == taken[s] for s in sizes)
    assert mixing.mix(table(spark, [])).collect() == []
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_small_sources_are_capped(spark):
    rows = [(i, "a b c d e f g h i j", None, "big") for i in range(300)] + [(1000 + i, "a b", None, "c-small") for i in range(4)] + [(2000, None, None, "d-none")]
    got = mixing.mix(table(spark, rows)).collect()
    want = targets({"big": 3000, "c-small": 8, "d-none": 0})
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
    assert all(r.taken == 3 * r.size for r in got if r.source == "c-small")


def test_mix_is_applied(spark):
    df = documents(spark)
    plan, out = mixing.mix(df).collect(), mixing.apply_mix(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in plan if r.taken}


def test_each_row_of_one_id_has_its_own_decision(spark):
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(i + 1)), None, "a") for i in range(20)] + [(7, " ".join(["b"] * n), None, "a") for n in (3, 3, 3, 40, 40)] + [(i, "c d e f", None, "b") for i in range(100, 160)]
    df = table(spark, rows)
    plan, want, got = mixing.mix(df).collect(), Counter(), Counter()
    for r in plan:
        want[r.doc_id, r.source] += r.taken
    out = mixing.apply_mix(df).collect()
    for r in out:
        got[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert got == +want
    # every word is taken as often as the plan says, row by row
    per_row = Counter()
    for r in out:
        if r.doc_id is None:
            per_row[r.text.split("x")[0]] += len(WORD.findall(r.text))
    taken = {f"w{r.size - 1}": r.taken for r in plan if r.doc_id is None and r.taken}
    assert per_row == taken and len(taken) > 1
