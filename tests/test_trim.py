"""Plans as a whole: properties, and single steps on small tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.functions import spec as notation
from strandweave.functions.exprs import InvalidTemplate
from strandweave.operators import sinks
from strandweave.operators.statistics import collect
from strandweave.plans import queries, report
from strandweave.plans.trim import Side, TrimSpec, trim

SF = "/root/testdata/sf0.001"


def adapters(*texts, where="back", **options):
    return notation.adapters([(where, t) for t in texts], **options)


def table(spark, *reads):
    """Reads as (name, sequence, qualities)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(reads)], "rid long, name string, sequence string, qualities string")


def run(spark, spec, *reads):
    return trim(table(spark, *reads), spec).orderBy("rid").collect()


def busy(**more):
    return TrimSpec(Side(adapters("a=AGATCGGAAGAG", "b=ACGTACG", max_errors=0.15), cut=[1], quality=(5, 15), length=60, min_length=20), times=2, poly_a=True, trim_n=True, max_n=2, discard_casava=True, **more)


@pytest.mark.parametrize("spec", [busy(), busy(both_strands=True), busy(action="mask"), busy(action="lowercase")], ids=["trim", "strands", "mask", "lowercase"])
def test_partitions_and_prefilter_dont_matter(spark, spec):
    reads = queries.synthetic(spark, SF)
    cols = ["rid", "name", "sequence", "qualities", "fate", "is_rc", F.col("matches").cast("string").alias("m")]
    one = sorted(map(str, trim(reads.repartition(1), spec).select(*cols).collect()))
    spec.prefilter = False
    assert one == sorted(map(str, trim(reads.repartition(7), spec).select(*cols).collect()))


@pytest.mark.parametrize("spec", [busy(), busy(discard="untrimmed"), TrimSpec()], ids=["some", "untrimmed", "nothing"])
def test_each_read_has_one_fate(spark, spec):
    stats = collect(trim(queries.synthetic(spark, SF), spec), spec)
    assert stats.n == 1500 and stats.written + sum(stats.filtered.values()) == stats.n
    assert sum(stats.bp_out) == sum(x * n for x, n in stats.lengths[0].items())
    report.dumps(report.json_report(stats))
    assert "1,500" in report.full_report(stats)


def test_pieces_make_up_the_read(spark):
    spec = TrimSpec(Side(adapters("AGATCGGAAGAG", max_errors=0.1)))
    out = trim(queries.synthetic(spark, SF), spec).where(F.size("matches") == 1)
    m = F.col("matches")[0]
    whole = F.concat("sequence", F.expr("substring(original.sequence, matches[0].rstart + 1, matches[0].rstop - matches[0].rstart)"), F.expr("substring(original.sequence, matches[0].rstop + 1)"))
    assert out.where((whole != F.col("original.sequence")) | (m["rstart"] != F.length("sequence"))).count() == 0
    assert out.count() > 300


def test_actions_over_rounds(spark):
    reads = [("r", "CCAAACCCGGGTTT", "ABCDEFGHIJKLMN")]
    make = lambda **k: TrimSpec(Side(adapters("GGG", "CCC", max_errors=0, min_overlap=3)), times=2, **k)
    assert run(spark, make(), *reads)[0].sequence == "CCAAA"
    assert run(spark, make(action="mask"), *reads)[0].sequence == "CCAAANNNNNNNNN"
    assert run(spark, make(action="lowercase"), *reads)[0].sequence == "CCAAAcccgggttt"
    got = run(spark, make(action="none"), *reads)[0]
    assert got.sequence == reads[0][1] and len(got.matches) == 2
    with pytest.raises(ValueError):
        TrimSpec(Side(adapters("GGG")), times=2, action="retain").cutter(Side(adapters("GGG")))


def test_linked_actions(spark):
    reads = [("r", "AACCTTTTGGAAxx".replace("x", "C"), "I" * 14)]
    make = lambda action: TrimSpec(Side(adapters("^AACC...GGAA", max_errors=0)), action=action)
    assert [run(spark, make(a), *reads)[0].sequence for a in ("trim", "retain", "mask", "lowercase")] == ["TTTT", "AACCTTTTGGAA", "NNNNTTTTNNNNNN", "aaccTTTTggaacc"]
    with pytest.raises(ValueError):
        run(spark, make("crop"), *reads)


def test_reads_without_qualities_and_empty_reads(spark):
    spec = busy(max_expected_errors=1.0, zero_cap=True)
    rows = run(spark, spec, ("a", "ACGTACGTACGTACGTACGTACGTAA", None), ("b", "", ""), ("c", "NNNN", "IIII"), ("d", "", None))
    assert rows[0].qualities is None and rows[0].fate in (None, "too_short")
    assert [r.sequence for r in rows[1:]] == ["", "", ""]


def test_info_lines(spark):
    spec = TrimSpec(Side(adapters("x=GGG", max_errors=0), cut=[2]))
    rows = trim(table(spark, ("r", "TTAAAGGGCC", "0123456789"), ("s", "TTAAA", "01234")), spec).orderBy("rid").select(F.explode(sinks.info_lines("", ["x"], [False]))).collect()
    # places are those of the search; the texts are taken from the read as it came
    assert [r[0] for r in rows] == ["r\t0\t3\t6\tTTA\tAAG\tGGCC\tx\t012\t345\t6789\t", "s\t-1\tAAA\t234"]


def test_names(spark):
    read = ("id7  some words", "CCAAAGGG", "IIIIIIII")
    spec = TrimSpec(Side(adapters("x=GGG", max_errors=0), cut=[2]), rename=r"{id}|{comment}|{cut_prefix}|{cut_suffix}|{adapter_name}|{match_sequence}|{rc}\t{header}")
    assert run(spark, spec, read)[0].name == "id7|some words|CC||x|GGG|\tid7  some words"
    assert run(spark, TrimSpec(rename="{header}"), read)[0].name == read[0]
    for bad in ("{nothing}", "{id", "id}"):
        with pytest.raises(InvalidTemplate):
            run(spark, TrimSpec(rename=bad), read)
    assert run(spark, TrimSpec(prefix="a{name}", suffix="_{name}"), read)[0].name == "ano_adapterid7  some words_no_adapter"
    assert run(spark, TrimSpec(Side(length=3), length_tag="len="), ("r len=9 xlen=9", "ACGTA", "IIIII"))[0].name == "r len=3 xlen=9"


def test_pairs(spark):
    pairs = spark.createDataFrame(
        [(0, "a/1", "AAAAGGG", "IIIIIII", "a/2", "TTTTCCC", "IIIIIII"), (1, "b/1", "AAAA", "IIII", "b/2", "TTTTCCC", "IIIIIII")],
        "rid long, name1 string, sequence1 string, qualities1 string, name2 string, sequence2 string, qualities2 string",
    )
    side = lambda t, **k: Side(adapters(t, max_errors=0), **k)
    both = TrimSpec(side("GGG"), side("CCC"), pair_adapters=True)
    assert [(r.r1_sequence, r.r2_sequence) for r in trim(pairs, both).orderBy("rid").collect()] == [("AAAA", "TTTT"), ("AAAA", "TTTTCCC")]
    swapped = trim(pairs, TrimSpec(side("CCC"), Side(), both_strands=True)).orderBy("rid").collect()
    assert [(r.r1_name, r.r1_sequence, r.r2_sequence, r.r1_is_rc) for r in swapped] == [("a/2 rc", "TTTT", "AAAAGGG", True), ("b/2 rc", "TTTT", "AAAA", True)]
    for mode, n in (("any", 2), ("both", 1), ("first", 1)):
        spec = TrimSpec(side("GGG"), side("CCC"), discard="trimmed", pair_filter=mode)
        assert trim(pairs, spec).where("fate is not null").count() == n
    named = lambda a, b: pairs.withColumns({"name1": F.lit(a), "name2": F.lit(b)})
    spec = TrimSpec(Side(), Side(cut=[1]), rename="{id}_{r2.cut_prefix} {rn}")
    renamed = trim(named("a x", "a y"), spec).first()
    assert (renamed.r1_name, renamed.r2_name) == ("a_T 1", "a_T 2")
    for df, text in ((named("a", "b"), "{id}"), (named("a", "a"), "{id}{rn}x")):
        with pytest.raises(PySparkException):
            trim(df, TrimSpec(Side(), Side(), rename=text)).select("r1_name").collect()



def test_contradictions():
    for bad in ({"discard": "trimmed", "untrimmed_apart": True}, {"demultiplex": "name", "discard": "trimmed"}, {"demultiplex": "both"}, {"pair_adapters": True}, {"rename": "{id}", "prefix": "x"}, {"action": "cut"}):
        with pytest.raises(ValueError):
            TrimSpec(**bad)
    for cut in ([1, 2], [1, -2, 3], [-1, -1]):
        with pytest.raises(ValueError):
            Side(cut=cut)


def test_nothing_is_shuffled_and_the_search_runs_once(spark):
    plan = trim(queries.synthetic(spark, SF), busy())._jdf.queryExecution().executedPlan().toString()
    # one pass each for qualities, adapters and poly-A, as each needs what the one before leaves
    assert "Exchange" not in plan and plan.count("ArrowEvalPython [search(") == 1 and plan.count("ArrowEvalPython") == 3


def test_steps_and_filters_of_ones_own(spark):
    """A step that turns reads around, and a filter with a fate of its own after those that are built in."""
    turn = lambda df, p: df.withColumns({f"{p}{c}": F.reverse(f"{p}{c}") for c in ("sequence", "qualities")})
    spec = TrimSpec(Side(cut=[1], min_length=3), modifiers=[turn], filters=[("begins_with_t", lambda p: F.startswith(F.col(f"{p}sequence"), F.lit("T")))])
    got = run(spark, spec, ("a", "ACGT", "ABCD"), ("b", "TTCG", "ABCD"), ("c", "AT", "AB"))
    assert [(r.sequence, r.qualities, r.fate) for r in got] == [("TGC", "DCB", "begins_with_t"), ("GCT", "DCB", None), ("T", "B", "too_short")]
    out = trim(table(spark, ("a", "ACGT", "ABCD"), ("b", "TTCG", "ABCD")), spec)
    stats = collect(out, spec)
    assert report.json_report(stats)["read_counts"]["filtered"]["begins_with_t"] == 1 and "begins_with_t" in report.full_report(stats)
    with pytest.raises(ValueError):
        TrimSpec(filters=[("too_short", lambda p: F.lit(True))])


def test_prefilter_of_pairs_changes_nothing(spark):
    pairs = queries.synthetic_pairs(spark, SF)
    for first, second in ((["AGATCGGAAGAG", "ACGTACG"], ["CTTCCG", "CGTACGT"]), (["AGATCG", "ACG...TTA"], ["ACGT", "CGTACGT"]), (["AGATCGGAAGAG", "ANNC"], ["CTTCCG", "CNNT"])):
        spec = [TrimSpec(Side(adapters(*first, max_errors=0.2)), Side(adapters(*second, max_errors=0.2)), pair_adapters=True, prefilter=x) for x in (True, False)]
        got, plain = (trim(pairs, x).select("rid", "r1_matches", "r2_matches", "r1_sequence", "r2_sequence").orderBy("rid").collect() for x in spec)
        assert got == plain and any(r.r1_matches for r in got)


def test_pairs_are_aligned_only_where_both_reads_may_match(monkeypatch):
    from strandweave.functions.adapters import pair_rounds
    from strandweave.functions.align import Aligner

    aligned, locate = [], Aligner.locate_many
    monkeypatch.setattr(Aligner, "locate_many", lambda self, reads: aligned.extend(reads) or locate(self, reads))
    ones, twos = ["CCCAGATCGGAAGAG"] * 100, ["AAAAAAAAAAAA"] * 99 + ["TTTCTTCCGTTT"]
    found = pair_rounds(adapters("AGATCGGAAGAG"), adapters("CTTCCG"), ones, twos)
    assert [[i for i, x in enumerate(f) if x] for f in found] == [[99], [99]]
    assert len(aligned) == 2
