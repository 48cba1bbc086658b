import random
import unicodedata

from claimloom.llm.statements import statement_copies, statements


def plain(text):
    s = text.casefold()
    cls = [unicodedata.category(c)[0] for c in s]
    return "".join(c for i, c in enumerate(s) if cls[i] in "LMN" or (c in ".," and 0 < i < len(s) - 1 and cls[i - 1] == cls[i + 1] == "N"))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_cases(make_nodes):
    n = make_nodes(
        {"id": "a1", "claim": "Die Straße  ist 1.5 km lang!"},
        {"id": "A2 ", "claim": "die STRASSE, ist 1.5 KM lang"},
        {"id": "a3", "claim": "die strasse ist 15 km lang"},
        {"id": "b1", "claim": "port: 8080; host: Alpha_1; zone: north"},
        {"id": "b2", "claim": "{Zone = NORTH,  Port = 8080,\nHost = alpha 1}"},
        {"id": "b3", "claim": "zone -> north | host -> alpha_1 | port -> 8080 | port -> 8080"},
        {"id": "b4", "claim": "zone -> north | host -> alpha_2 | port -> 8080"},
        {"id": "b5", "claim": "port 8080 host alpha 1 zone north"},
        {"id": "c1", "claim": "ΟΔΟΣ σοφός"},
        {"id": "c2", "claim": "οδος ΣΟΦΌΣ"},
        {"id": "d1", "claim": None},
        {"id": "d2", "claim": ""},
        {"id": "d3", "claim": " .,!"},
        {"id": "d4", "claim": "…"},
        {"id": "e1", "claim": "café au lait"},
        {"id": "e2", "claim": "café au lait"},
        {"id": "f", "claim": "x" * 200_000},
        {"id": "g", "claim": "X" * 100_000 + " " + "x" * 100_000},
        {"id": "g", "claim": "X" * 100_000 + " " + "x" * 100_000},
        {"id": None, "claim": "die strasse ist 15 km lang"},
    )
    assert pairs(statement_copies(n)) == {("a1", "a2"), ("b1", "b2"), ("b1", "b3"), ("b1", "b5"), ("c1", "c2"), ("f", "g")}
    got = {r.first_id: (r.n_ids, r.n_forms) for r in statements(n).collect()}
    assert got == {"a1": (2, 2), "a3": (1, 1), "b1": (4, 4), "b4": (1, 1), "c1": (2, 2), "e1": (1, 1), "e2": (1, 1), "f": (2, 2)}
    assert statement_copies(n.limit(0)).count() == statements(n.limit(0)).count() == 0


def test_against_brute_force(make_nodes):
    r = random.Random(2)
    words = ["Alpha", "beta", "3.5", "3,5", "35", "ß", "Öl", "х", "日本", "́", "-", "%"]
    rows = [{"id": f"n{i:03}", "claim": r.choice([" ", "", ", "]).join(r.choice(words) for _ in range(r.randrange(1, 4)))} for i in range(400)]
    groups = {}
    for x in rows:
        if k := plain(x["claim"]):
            groups.setdefault(k, []).append(x["id"])
    want = {(min(v), i) for v in groups.values() for i in v if i != min(v)}
    assert pairs(statement_copies(make_nodes(*rows))) == want


def test_one_statement_in_a_third_of_the_rows(spark, make_nodes):
    rows = [{"id": f"h{i:04}", "claim": "Hot  Claim" + "!" * (i % 3)} for i in range(1000)] + [{"id": f"z{i:04}", "claim": f"other {i}"} for i in range(2000)]
    n = make_nodes(*rows)
    assert statement_copies(n).count() == 999
    assert statements(n).where("n_ids = 1000 and n_forms = 3").count() == 1


def test_labels_of_any_length(make_nodes):
    long = "label " * 20
    n = make_nodes({"id": "a", "claim": f"{long}-> 1; port -> 2"}, {"id": "b", "claim": f"port: 2; {long}: 1"}, {"id": "c", "claim": f"{long}1 port 2; host"}, {"id": "d", "claim": "x" + " " * 100_000 + ","})
    assert pairs(statement_copies(n)) == {("a", "b")}
    assert statements(n).count() == 3
