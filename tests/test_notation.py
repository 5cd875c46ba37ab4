import pytest

from strandweave.functions import spec
from strandweave.functions.adapters import InvalidCharacter, Linked


def one(text, where="back", **options):
    return spec.adapters([(where, text)], **options)[0]


@pytest.mark.parametrize(
    "text,where,kind,seq",
    [
        ("ACGT", "back", "back", "ACGT"), ("ACGT$", "back", "suffix", "ACGT"), ("ACGTX", "back", "edge_back", "ACGT"), ("^ACGT", "front", "prefix", "ACGT"),
        ("XACGT", "front", "edge_front", "ACGT"), ("ACGT", "anywhere", "anywhere", "ACGT"), ("A{5}C", "back", "back", "AAAAAC"), ("ACGU", "back", "back", "ACGT"),
        ("ACGT...", "back", "front", "ACGT"), ("...ACGT", "back", "back", "ACGT"), ("ACGT;rightmost", "front", "rightmost_front", "ACGT"), ("XXX", "back", "back", "XXX"),
    ],
)
def test_kinds(text, where, kind, seq):
    a = one(text, where, max_errors=0)
    assert (a.kind, a.sequence) == (kind, seq)


def test_options_and_names():
    a = one("name = ACGTACGT; e=0.25 ; min_overlap=4;noindels", max_errors=0.1)
    assert (a.name, a.rate, a.min_overlap, a.indels) == ("name", 0.25, 4, False)
    assert one("ACGTACGTAC;max_errors=2").rate == 0.2
    assert [x.name for x in spec.adapters([("back", "AC"), ("back", "n=GT"), ("front", "TT")])] == ["1", "n", "2"]


def test_linked_parts_that_are_needed():
    for where, text, needed in (("back", "^AC...GT", (True, False)), ("back", "AC...GT", (False, False)), ("back", "AC...GT$", (False, True)), ("front", "AC...GT", (True, True)), ("front", "AC;optional...GT", (False, True))):
        a = one(text, where)
        assert isinstance(a, Linked) and (a.front_required, a.back_required) == needed


@pytest.mark.parametrize("text,where", [("^ACGT", "back"), ("ACGT$", "front"), ("^ACGT", "anywhere"), ("AC...GT", "anywhere"), ("...ACGT", "front"), ("^ACGT;min_overlap=2", "front"), ("A{20000}", "back"), ("A{2", "back"), ("ACGT;required", "back"), ("ACGT;e=", "back"), ("", "back")])
def test_errors(text, where):
    with pytest.raises(ValueError):
        one(text, where)


def test_unknown_letters_and_options():
    with pytest.raises(InvalidCharacter):
        one("ADAPTER!")
    with pytest.raises(KeyError):
        one("ACGT;bogus=1")
    assert one("ADAPTERQ", adapter_wildcards=False).sequence == "ADAPTERQ"


def test_adapter_files(tmp_path):
    f = tmp_path / "a.fasta"
    f.write_text(">one more\nACGT\nAC\n>two\nTTTT\n")
    a = spec.adapters([("front", f"^file:{f};e=0.5")])
    assert [(x.name, x.kind, x.sequence, x.rate) for x in a] == [("one", "prefix", "ACGTAC", 0.5), ("two", "prefix", "TTTT", 0.5)]
