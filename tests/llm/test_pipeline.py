"""The pipeline's stages, each against a plain version over the rows that it was given."""

import base64

import public_tokenizers
import tiktoken
from helpers import ODD, SF, WORD, documents, table
from test_linededup import plainly as lines_plainly
from test_neardup import plainly as near_plainly

import corpus_pipeline
from strandweave.llm import common, langid
from strandweave.llm.common import materialise


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stage_by_stage(spark):
    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        if name != "tokens":
            assert out.columns == columns
        before, after = rows(docs), (rows(out) if name != "tokens" else None)
        if name == "language":
            verdict = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, learnable=langid.remainder() != 2)).collect()}
            good = lambda i: verdict[i].lang_pred != "und" and verdict[i].score >= corpus_pipeline.LEAST_SCORE
            assert sorted(after, key=str) == sorted((r for r in before if good(r[0])), key=str)
            assert len(after) > 0.9 * len(before)
        elif name == "lines":
            want = []
            for i, _, removed, text in lines_plainly([(i, t) for i, t, _, _ in before]):
                if not removed or any(len(x.strip(" \t\r\x0b\x0c")) >= 20 for x in text.split("\n")):
                    want.append((i, text))
            assert sorted((i, t) for i, t, _, _ in after) == sorted(want)
        elif name == "near_copies":
            kept = {i for i, _, _, k in near_plainly([(i, t) for i, t, _, _ in before], 5) if k}
            assert sorted(after, key=str) == sorted((r for r in before if r[0] in kept), key=str)
        elif name == "mix":
            whole = {r[0]: len(WORD.findall(r[1])) for r in before}
            taken = {}
            for i, t, _, _ in after:
                taken[i] = taken.get(i, 0) + len(WORD.findall(t))
            assert all(n <= 3 * whole[i] for i, n in taken.items())
            assert abs(sum(taken.values()) - sum(whole.values())) <= len({r[3] for r in before})
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
            lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = sorted((i, lib.encode_ordinary(t)) for i, t, _, _ in before)
            assert sorted((r.doc_id, list(r.token_ids)) for r in out.collect()) == want
            assert all(r.round_trip for r in out.collect())
        docs = out


def test_short_lines_of_their_own_stay(spark):
    licence = "this line is in every document of the collection"
    docs = [
        (1, f"{licence}\nsome prose that is long enough to stay", "en", "web"),
        (2, f"{licence}\nto be\nor not\nto be", "en", "web"),
        (3, f"{licence}\nto be\nor not", "en", "web"),  # all of it is in earlier documents
        (4, f"{licence}\n \n", "en", "web"),
        (5, f"{licence}\nor not\n漢字", "zh", "web"),
        (None, f"{licence}\nfirst of all", "en", "web"),
        (6, f"{licence}\nfirst of all", "en", "web"),
        (7, "or not", "en", "web"),
    ]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table(spark, docs), SF).collect()}
    assert got == {None: f"{licence}\nfirst of all", 1: "some prose that is long enough to stay", 2: "to be\nor not\nto be", 5: "or not\n漢字", 7: "or not"}


def test_rows_of_one_id_with_several_texts_are_several(spark):
    a, b, c = ("\n".join(f"{x} {i} of {x}" for i in range(40)) for x in ("apple", "brick", "cloud"))
    docs = [(1, a, "en", "web"), (1, b, "en", "web"), (1, b, "en", "web"), (1, None, "en", "web"), (2, b + " end", "en", "web"), (2, c, "en", "web"), (None, a, "en", "web"), (None, a, "en", "web")]
    got = corpus_pipeline.near_copies(spark, table(spark, docs), SF)
    want = [(1, a), (1, b), (1, None), (2, c), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    docs = table(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"odd-{name}")
    assert docs.count() > 0 and docs.where("not round_trip").count() == 0
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"none-{name}")
    assert docs.count() == 0


def test_lines_leave_no_texts_behind(spark, tmp_path, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.lines(spark, docs, SF).collect())
    left = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    names = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert names == ["lines-marked"]
    assert left < 0.1 * sum(len(t.encode()) for _, t in got if t)
