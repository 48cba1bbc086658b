import random
import re
import unicodedata

import numpy as np

from claimloom.llm.lookalike import one_form
from claimloom.llm.near_dupes import chain, least_meeting, near_duplicate_groups, near_duplicates, plan, trees_needed, verified, word_set
from conftest import DATA


def letters(text):
    """What p1 compares: letters, marks and digits without case, and stops and commas between digits."""
    out = []
    for i, c in enumerate(text):
        between = c in ".," and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()
        if between or unicodedata.category(c)[0] in "LMN":
            out.append(c)
    return "".join(out).casefold()


def fields(text):
    best = []
    for parting in (r"[;|\r\n]+", r"[;|]+", r",(?!\d)|(?<!\d),"):
        parts = [p for p in re.split(parting, text) if re.search(r"[^\W_]", p)]
        found = [re.fullmatch(r"(?s)\W*([^\W\d_][\w .-]*?)\s*(?::|=|->|→)\s*(.*\w.*)", p) for p in parts]
        if len(parts) > max(1, len(best)) and all(found):
            best = [(letters(m[1]), letters(m[2])) for m in found]
    return frozenset(best)


def exact(claims, t=0.6):
    """Cases by their definition, of ``{id: claim in one form}``, all claims against all: nothing of the operator is used."""
    words = {}
    for i, c in claims.items():
        ours = sum("LATIN" in (n := unicodedata.name(x, "")) or "CYRILLIC" in n for x in c if x.isalpha())
        w = frozenset("".join(x) for x in re.findall(r"((?:[^\W_][\u0300-\u036f]*)+)", c.casefold()))
        if len(w) >= 8 and 3 * ours >= 2 * sum(x.isalpha() for x in c):
            words[i] = w
    ids = sorted(words)
    place = {w: k for k, w in enumerate({w for x in words.values() for w in x})}
    m = np.zeros((len(ids), len(place)), np.float32)
    for k, i in enumerate(ids):
        m[k, [place[w] for w in words[i]]] = 1
    n = m.sum(1)
    both = m @ m.T
    a, b = np.nonzero(np.triu(both >= t * (n[:, None] + n[None, :] - both) - 1e-4, 1))
    plain, sets = {i: letters(claims[i]) for i in ids}, {i: fields(claims[i]) for i in ids}
    same = lambda x, y: plain[x] == plain[y] or (sets[x] and sets[x] == sets[y])
    return {(ids[x], ids[y]) for x, y in zip(a, b, strict=True) if not same(ids[x], ids[y])}


def found(nodes):
    return {tuple(r) for r in near_duplicates(nodes).collect()}


def test_recall_on_whole_tables(spark):
    nodes = spark.read.parquet(str(DATA / "sf0.01/nodes.parquet"))
    raw = {r.id: r.text for r in one_form(nodes).collect() if r.text}
    forms = {r.id: r.form for r in one_form(nodes).collect() if r.form}
    # Field lists may be parted by line breaks, which the one form doesn't have.
    claims = {i: raw[i] if "\n" in raw[i] and raw[i].isascii() else f for i, f in forms.items()}
    want, got = exact(claims), found(nodes)
    assert len(want) > 50 and len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.98 * len(got)


def test_claims_that_share_most_words(make_nodes):
    """Every word is held by most claims: prefixes are shortened to one word."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(26)]
    claims = {f"n{i:03}": " ".join(r.sample(words, 20)) for i in range(120)}
    want, got = exact(claims), found(make_nodes(*({"id": i, "claim": c} for i, c in claims.items())))
    assert got <= want and len(want) > 1000 and len(got) >= 0.99 * len(want)


def test_cases(make_nodes):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    n = make_nodes(
        {"id": "a", "claim": base},
        {"id": "b", "claim": base.replace("kappa", "lambda")},
        {"id": "c", "claim": " ".join(reversed(base.split()))},
        {"id": "d", "claim": base.upper() + "!"},
        {"id": "e", "claim": "alpha beta gamma delta epsilon zeta eta"},
        {"id": "f", "claim": None},
        {"id": "g", "claim": ""},
        {"id": "h", "claim": "日本" * 30 + " " + base},
        {"id": "b", "claim": base.replace("kappa", "lambda")},
    )
    got = {tuple(r) for r in near_duplicates(n).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    g = {r.id: (r.group_id, r.n_links) for r in near_duplicate_groups(n).collect()}
    assert g == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "d": ("a", 2)}
    assert near_duplicates(n.limit(0)).count() == near_duplicate_groups(n.limit(0)).count() == 0


def test_words_and_trees():
    assert word_set("a b c d e f g") is None and len(word_set("a b c d e f g h_i é é")) == 10
    sizes = np.array([20, 20, 20, 20])
    p = least_meeting(sizes, np.array([20, 14, 8, 0]), 1)
    assert 0.59 < p[0] <= 0.61 and 0 < p[1] < p[0] and p[2] == p[3] == 0
    need = trees_needed(sizes, np.array([20, 14, 8, 0]), 1)
    assert (1 - (1 - p[:2]) ** need[:2] >= 0.99).all() and need[2] == need[3]
    assert chain(10, 1000) == [10, 40, 160, 640, 1000] and chain(5, 5) == [5]
    # A larger corpus takes longer prefixes where short ones would meet too often.
    found = {(c, h): (1.0, 8.0 * h) for c in (100, 1000) for h in (1, 2)}
    assert plan(1000, 20, found, {100: 0.001, 1000: 0.01})[1] == 1 and plan(10**8, 20, found, {100: 0.001, 1000: 0.01})[1] == 2


def test_hot_template_and_look_alikes(make_nodes):
    """A third of all claims is one text with small edits, in upper case and with letters of another script too."""
    base = [f"base{i}" for i in range(20)]
    rows = [{"id": f"h{i:03}", "claim": " ".join([*base[: i % 20], f"edit{i}", *base[i % 20 + 1 :]])} for i in range(60)]
    rows += [{"id": f"o{i:03}", "claim": " ".join(f"other{i}x{j}" for j in range(20))} for i in range(120)]
    want = exact({r["id"]: r["claim"] for r in rows})
    copies = [{"id": "x1", "claim": rows[0]["claim"].upper()}, {"id": "x2", "claim": rows[1]["claim"].replace("a", "а")}]
    got = found(make_nodes(*rows, *copies))
    assert len(want) == 60 * 59 // 2 and got >= want and ("h000", "x1") not in got and ("h001", "x2") not in got and ("h001", "x1") in got


def test_lists_parted_by_line_breaks(make_nodes):
    parts = [f"label{i}: value{i}" for i in range(6)]
    n = make_nodes({"id": "a", "claim": "\n".join(parts)}, {"id": "b", "claim": "\n".join(reversed(parts))}, {"id": "c", "claim": "; ".join([*parts[:5], "label5: other"])})
    assert found(n) == {("a", "c"), ("b", "c")}


def test_poor_class_meets_a_class_with_more_telling_words(make_nodes):
    """Three and four telling words beside common ones: labels of the two came from different word sets."""
    common = [f"c{i}" for i in range(9)]
    fill = [{"id": f"f{i}", "claim": " ".join(random.Random(i).sample(common, 8) + [f"f{i}x{j}" for j in range(30)])} for i in range(400)]
    pairs = []
    for i in range(40):
        shared = " ".join([*common[:8], *(f"t{i}x{j}" for j in range(3))])
        pairs += [{"id": f"p{i}", "claim": f"{shared} {common[8]}"}, {"id": f"q{i}", "claim": f"{shared} u{i}"}]
    want, got = exact({r["id"]: r["claim"] for r in fill + pairs}), found(make_nodes(*fill, *pairs))
    # The poor ones also pair with each other.
    assert got <= want and {(f"p{i}", f"q{i}") for i in range(40)} <= got and len(want) == 40 + 40 * 39 // 2 and len(got) >= 0.99 * len(want)


def test_template_with_few_shared_telling_words(make_nodes):
    """Twenty words, twelve common and three of eight telling ones shared: 0.6."""
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(150):
        shared = [*common, *(f"t{i}x{j}" for j in range(3))]
        rows += [{"id": f"{k}{i}", "claim": " ".join([*shared, *(f"{k}{i}x{j}" for j in range(5))])} for k in "pq"]
    want, got = exact({r["id"]: r["claim"] for r in rows}), found(make_nodes(*rows))
    assert got <= want and len(want) == 150 and len(got) >= 0.99 * len(want)


def test_no_side_that_grows_goes_to_the_driver(spark):
    classes = spark.createDataFrame([(1, b"a", b"a", [1, 2, 3]), (2, b"b", b"b", [1, 2, 4])], "cid bigint, key binary, plain binary, words array<bigint>")
    found = verified(spark.createDataFrame([(1, 2)], "a bigint, b bigint"), classes, 0.5)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
