import unicodedata
from collections import Counter

from claimloom.llm.lookalike import Normaliser, bigrams_of, compat_table, lattice, lookalike_copies, one_form


def norm():
    latin = "the filter of the orchard sorted every batch in the scope of cocoa pages".split()
    cyr = "сорок коров у реки искали корм осенью рано".split()
    return Normaliser(bigrams_of(Counter(latin + cyr)))


def test_members_of_a_lattice_get_one_form():
    n = norm()
    for group in (
        ["filter", "ﬁlter", "ｆｉｌｔｅｒ", "fіlter", "fi​lter", "fil­ter"],
        ["Selon", "Ѕelon", "Sеlοn"],
        ["WG-B3", "WG-В3", "WG‑Β3"],
        ["école", "école", "е́colе"],
        ["коров", "kоров".replace("k", "к"), "кopoв", "корoв"],
        ["a b", "a b", "a  b", " a\tb\n"],
        ["cocoa", "сосоа", "cосоa"],
        ["ガ", "ガ", "ｶﾞ"],
    ):
        assert len({n.text(x) for x in group}) == 1, group


def test_what_looks_different_stays():
    n = norm()
    for a, b in (("10²", "102"), ("ecole", "école"), ("Selon", "selon"), ("½", "1⁄2"), ("x₂", "x2"), ("и", "u")):
        assert n.text(a) != n.text(b)
    assert n.text("filter") == "filter" and n.text("сорок коров") == "сорок коров" and n.text(None) is None and n.text("") == ""
    assert n.text("b" * 300_000) == "b" * 300_000


def test_copies(make_nodes):
    n = make_nodes(
        {"id": "a", "claim": "The filter of the orchard"},
        {"id": "b", "claim": "Thе ﬁlter  of the orchard"},
        {"id": "c", "claim": "The filter\tof the orchard "},
        {"id": "d", "claim": "the filter of the orchard"},
        {"id": "e", "claim": None},
        {"id": "f", "claim": ""},
        {"id": "g", "claim": "​"},
        {"id": "h", "claim": "same text"},
        {"id": "i", "claim": " same  text"},
        {"id": "b", "claim": "Thе ﬁlter  of the orchard"},
    )
    assert {tuple(r) for r in lookalike_copies(n).collect()} == {("a", "b")}
    assert lookalike_copies(n.limit(0)).count() == 0
    forms = {r.id: r.form for r in one_form(n).collect()}
    assert forms["b"] == forms["a"] == forms["c"] == "The filter of the orchard" and forms["e"] is None and forms["g"] == ""


def test_every_letter_of_the_lattice_survives_the_map():
    for letter, options in lattice().items():
        assert unicodedata.normalize("NFC", letter.translate(compat_table())) == letter
        assert norm().text(f"fi{letter}d") == norm().text(f"fi{options['latin']}d")


def test_look_alike_tokens_follow_their_neighbours():
    n = norm()
    assert n.text("СТРОК коров у реки").startswith("СТРОК") and n.text("CTPOK коров у реки") == n.text("СТРОК коров у реки")
    assert n.text("акт HM-5TX и корм") == n.text("акт НМ-5ТХ и корм") and "HM-5TX" in n.text("акт НМ-5ТХ и корм")
    assert n.text("scope of а filter") == "scope of a filter" and n.lines("a:  1 \r\n\n b: ②") == "a: 1\nb: ②"
    long = "корм " + "а о е " * 100_000
    assert n.text(long) == long.strip()
