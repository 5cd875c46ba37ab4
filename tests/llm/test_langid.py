import itertools

import numpy as np
from helpers import ODD, by_id, documents, table

from strandweave.llm import langid


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    n, sizes = 3, np.array([5, 1, 0, 4])
    em, trans = rng.normal(size=(10, n)).astype(np.float32), rng.normal(size=(n, n)).astype(np.float32)
    got, at = langid.posteriors(em, sizes, trans), 0
    for size in sizes:
        mass, total = np.zeros((size, n)), 0.0
        for path in itertools.product(range(n), repeat=int(size)):
            first = np.exp(trans[:, path[0]]).sum() if size else 1.0  # every label may stand before the first word
            p = first * np.exp(sum(em[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                mass[t, y] += p
        if size:
            assert np.allclose(got[at : at + size], mass / total, atol=1e-4)
        at += size


def test_segments_make_no_difference(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([200, 3, 64, 65, 129])
    em, trans = rng.normal(size=(sizes.sum(), 4)).astype(np.float32), rng.normal(size=(4, 4)).astype(np.float32)
    want = langid.posteriors(em, sizes, trans)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert np.allclose(want, langid.posteriors(em, sizes, trans), atol=1e-3)


def test_held_out_accuracy(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    want = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(df).collect() if r.held_out and want[r.doc_id] and r.lang_pred != "und"]
    right = sum(r.lang_pred == want[r.doc_id] for r in got)
    assert len(got) > 150 and right >= 0.97 * len(got), (right, len(got))
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_text(spark):
    df = documents(spark, "/root/testdata/sf0.01").where("lang is not null")
    model = langid.train(df)
    pick = {r.lang: r.text for r in df.where("n_chars between 300 and 2000").orderBy("doc_id").collect()}
    a, b = sorted(pick)[:2]
    words = [pick[x].split()[:40] for x in (a, b)]
    mixed = table(spark, [(1, " ".join(words[0] + words[1]), None, None)])
    spans = sorted(map(tuple, langid.label_spans(mixed, model).collect()))
    longest = {lang: max(e - s for _, s, e, x in spans if x == lang) for lang in (a, b)}
    assert min(longest.values()) >= 25, spans
    assert langid.predict(mixed, model).first().switches >= 1


def test_odd_rows_and_no_labels(spark):
    df = table(spark, ODD)
    rows = langid.identify(df).collect()
    got = by_id(langid.identify(df))
    assert len(rows) == len(ODD)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 9))
    assert all(r.score == 1 for r in rows if r.lang_pred == "en")  # the only label
    bare = langid.identify(table(spark, [(1, "words here", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in bare] == [("und", 0.0)]
    assert langid.identify(table(spark, [])).collect() == []


def test_more_labels_than_a_few():
    rng = np.random.default_rng(4)
    alphabets = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)) for _ in range(40)]
    text = lambda a, n: [bytes(rng.choice(np.frombuffer(a.encode(), np.uint8), rng.integers(3, 9))) for _ in range(n)]
    model = langid.learn([(f"l{i:02}", text(a, 24)) for i, a in enumerate(alphabets) for _ in range(30)])
    assert model.labels == [f"l{i:02}" for i in range(40)]
    got = langid.Predictor(model).documents([b" ".join(text(a, 60)).decode() for a in alphabets])[0]
    assert sum(x == f"l{i:02}" for i, x in enumerate(got)) >= 36


def test_rows_that_repeat_one_id_are_sampled_as_texts(spark):
    rows = [(1, f"die katze sitzt auf dem dach nummer {i % 7}", "de", "x") for i in range(60)] + [(1, f"the cat sits on the roof number {i % 7}", "en", "x") for i in range(60)]
    sample = langid.train(table(spark, rows), docs_per_label=5)
    assert sample.labels == ["de", "en"]
