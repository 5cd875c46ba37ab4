import hashlib
import random

from helpers import LONG, ODD, SF, by_id, same, table

from strandweave.llm import common, linededup, queries

STRIP = " \t\r\x0b\x0c"


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def plainly(rows, least=20):
    """(doc_id, text) in order to what is left of each."""
    seen, out = [], []
    for doc_id, text in sorted(rows):
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines, left = text.split("\n"), []
        for line in lines:
            s = line.strip(STRIP)
            if len(s) >= least:
                gone = any(within_one(s, t) for t in seen)
                seen.append(s)
                if gone:
                    continue
            left.append(line)
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def found(df):
    return sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "text").collect())


def edited(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abxyz ") + s[i:], s[:i] + rng.choice("abxyz") + s[i + 1 :]])


def test_random_edits(spark):
    rng = random.Random(6)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([19, 20, 21, 22, 40, 63, 64, 65, 100, 130]))) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(stock)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                s = edited(rng, s)
            lines.append(rng.choice(["", "  ", "\t"]) + s + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    got = found(table(spark, [(i, t, "en", "w") for i, t in rows]))
    assert got == plainly(rows)


def test_repeats_and_single_letters(spark):
    texts = ["a" * 20, "a" * 21, "a" * 22, "a" * 23, "ab" * 12, "ba" * 12, "a" * 19, "a" * 19, "é" * 25 + "x", "é" * 25 + "y", "short", "short"]
    rows = list(enumerate(texts))
    assert found(table(spark, [(i, t, None, None) for i, t in rows])) == plainly(rows)


def test_oracle(spark):
    same(queries.op7_line_dedup(spark, SF), linededup.ORACLE)


def test_odd_rows(spark):
    df = table(spark, ODD)
    out = linededup.dedup_lines(df)
    got = by_id(out)
    assert out.count() == len(ODD) and set(df.columns) < set(out.columns)
    assert got[3].text is None and got[4].text == "" and got[6].text == LONG and got[10].text == ""
    assert got[1].text == ODD[0][1] and got[2].text == "" and got[None].n_removed == 0
    assert linededup.dedup_lines(table(spark, [])).collect() == []
    digests = by_id(linededup.line_digests(df))
    assert digests[3].text_md5 is None and digests[4].text_md5 == hashlib.md5(b"").hexdigest()


def test_no_python_in_the_plan(spark):
    plan = linededup.dedup_lines(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_what_is_written_on_the_way_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = table(spark, ODD)
    want = plainly([(r[0], r[1]) for r in ODD if r[0] not in (None, 2)])
    got = [r for r in found(df.where("doc_id <> 2")) if r[0] is not None]
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert got == want
    assert left == ["lines-gone"]
