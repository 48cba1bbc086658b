"""Small fixtures with known answers: gates, decay, graph, grounding, sessions, code."""

import collections
import random
from datetime import datetime as dt

import __spark_entry__ as entry
import pytest
from claimloom.functions import scalars as S
from claimloom.operators import code as K
from claimloom.operators import graph as G
from claimloom.operators import grounding as N
from claimloom.operators import quality as Q
from claimloom.operators import search as R
from claimloom.operators import sessions as L
from claimloom.operators import store as O
from claimloom.operators.components import components
from pyspark.sql import functions as F

NOW = 1782864000
C = F.col


def test_iso_forms(spark):
    cases = {"2026-01-01T00:00:00Z": 1767225600, "2026-01-01 03:00:00.5+03:00": 1767225600.5, "2026-01-01": 1767225600, "2026-13-01": None, "soon": None, "": None, None: None, "2026-01-01T00:00:00": 1767225600}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", S.iso_seconds(C("x")).alias("s"))
    assert {r.x: r.s for r in df.collect()} == cases


def test_truth_gate_matrix(make_nodes):
    good = {"claim": "delay 0.75 s", "source": "log", "evidence": ["e"], "context": "c", "ts": "2026-06-01T00:00:00Z"}
    cases = [{}, {"ts": ""}, {"ts": "2020-01-01"}, {"ts": "2026-07-01T01:00:00Z"}, {"source": " "}, {"claim": "no digits"}, {"links": ["bad"]}, {"links": [" "]}, {"evidence": None}, {"evidence": [" "]}, {"context": None}, {"context": None, "evidence": [], "source": None}]
    rows = [{"id": f"n{i}", **good, **c} for i, c in enumerate(cases)] + [{"id": "bad", "kind": "refuted"}]
    got = {r.id: r for r in Q.truth_gate(make_nodes(*rows), NOW).collect()}
    assert [got[f"n{i}"].score for i in range(12)] == [6] + [5] * 10 + [3]
    assert got["n1"].verdict == "pass" and got["n11"].verdict == "fail" and not got["n6"].p4


def test_gates(make_nodes):
    n = make_nodes(
        {"id": "a", "claim": "наверное, порт 80", "confidence": None},
        {"id": "b", "claim": "порт измерено 80", "confidence": None},
        {"id": "c", "claim": "порт 80", "confidence": 0.1},
        {"id": "d", "claim": "порт 80", "confidence": 0.1, "kind": "hypothesis"},
        {"id": "e", "claim": "x", "source": "кто-то сказал", "confidence": None},
        {"id": "f", "claim": "курс 90", "ts": "2026-06-01T00:00:00Z"},
        {"id": "g", "claim": "y", "links": ["e"], "source": "report"},
    )
    g1 = {r.id: r.v for r in n.select("id", Q.confidence_gate().alias("v")).collect()}
    assert (g1["a"], g1["b"], g1["c"], g1["d"], g1["e"]) == ("flag", "pass", "reject", "pass", "pass")
    g2 = {r.id: r.v for r in n.select("id", Q.staleness_gate(NOW).alias("v")).collect()}
    assert (g2["f"], g2["c"]) == ("reject", "pass")
    g3 = {r.id: (r.tier, r.verdict) for r in Q.source_gate(n).collect()}
    assert g3["e"] == ("C", "reject") and g3["g"] == ("A", "reject") and g3["a"] == ("B", "pass")


def test_duplicates_and_contrary_claims(make_nodes):
    n = make_nodes(
        {"id": "a", "claim": "Замер задержки очереди составил 11 мс на стенде"},
        {"id": "b", "claim": "Замер задержки очереди составил 21 мс на стенде"},
        {"id": "c", "claim": "Вердикт модели 2026-09-01 02:05:23: CRV long -> reject по объёму"},
        {"id": "d", "claim": "Вердикт модели 2026-09-02 03:05:23: CRV long -> reject по объёму"},
        {"id": "e", "claim": "Вердикт модели 2026-09-02 03:05:23: CRV long -> approve по объёму"},
        {"id": "f", "claim": "сервер очередей работает стабильно"},
        {"id": "g", "claim": "сервер очередей не работает стабильно"},
    )
    assert {(r.id, r.duplicate_of) for r in Q.gate_duplicates(n).collect()} == {("d", "c")}
    assert {r.id for r in Q.gate_contrary(n).collect()} == {"f", "g"}
    v = {r.id: r.verdict for r in Q.consistency_gate(n).collect()}
    assert v["d"] == "reject" and v["b"] == v["e"] == "pass" and v["g"] == "reject"


def test_salient_parity(spark):
    df = spark.createDataFrame([("10 and 100",)], "x string")
    r = df.select(S.salient(C("x")).alias("a"), S.salient(C("x"), True).alias("b")).first()
    assert r.a == ["10", "100"] and r.b == ["1"]


def test_decay_composes_and_stops_at_the_floor(make_nodes):
    n = make_nodes({"id": "a", "last_used": "2026-06-24T00:00:00Z"}, {"id": "b", "last_used": "2020-01-01"}, {"id": "r", "kind": "rule", "last_used": "2020-01-01"}, {"id": "f", "last_used": "2027-01-01"}, {"id": "j", "last_used": "junk", "weight": 0.7}, {"id": "z", "weight": None})
    got = {r.id: (r.weight, r.moved) for r in O.decay(n, NOW).collect()}
    assert got == {"a": (0.5, True), "b": (0.05, True), "r": (0.5, True), "f": (1.0, False), "j": (0.7, False), "z": (1.0, False)}


def test_insert_and_update_are_all_or_nothing(make_nodes):
    a, b = make_nodes({"id": "a"}, {"id": "b"}), make_nodes({"id": "c"})
    assert O.insert(a, b).count() == 3 and O.update(a, make_nodes({"id": "b", "claim": "new"})).count() == 2
    with pytest.raises(ValueError):
        O.insert(a, make_nodes({"id": "a"}))
    with pytest.raises(KeyError):
        O.update(a, b)


def test_links(spark, make_nodes):
    n = make_nodes({"id": "a", "links": ["b"]}, {"id": "b"}, {"id": "c"})
    req = spark.createDataFrame([(1, "A", "b", None, None), (2, "a", " c", "part_of", "me"), (3, "a", "a", None, None), (4, "a", "zz", None, None), (5, "a", "c", "refers_to", "you")], "edge_id int, src string, dst string, rel string, author string")
    assert {tuple(r) for r in O.link_existing(n, req).collect()} == {("a", "c", "part_of", "me"), ("c", "a", "has_part", "me")}


def test_graph(spark, make_nodes):
    n = make_nodes({"id": "h", "kind": "hub", "tags": ["entity:кризис"]}, {"id": "r0", "tags": ["sys_cmd"], "kind": "rule"}, {"id": "r1", "tags": ["sys_cmd"], "kind": "rule"}, {"id": "p", "tags": ["persona_def"]})
    e = spark.createDataFrame([("h", "r0", "has_part"), ("h", "r1", "has_part"), ("h", "p", "has_part"), ("r1", "r0", "supersedes"), ("p", "lost", "refers_to")], "src string, dst string, rel string").withColumn("edge_id", F.monotonically_increasing_id())
    assert {(r.router, r.n_members) for r in G.hub_members(e, n).collect()} == {("sys_cmd", 2), ("persona_def", 1)}
    assert [(r.src, r.dst) for r in G.conflicts(e, n).collect()] == [("r1", "r0")]
    assert {(r.node, r.hops) for r in G.distances(e, n.where("id = 'r0'"), 3).collect()} == {("r0", 0), ("h", 1), ("r1", 1), ("p", 2), ("lost", 3)}
    assert [r.dst for r in G.broken_edges(e, n).collect()] == ["lost"]
    rules = G.rules_for(e, n, spark.createDataFrame([(1, "что делать: кризис")], "qid int, q string"), NOW).orderBy("rank").collect()
    assert [r.id for r in rules] == ["r1", "r0"]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (7, 7), (101, 100)], "a int, b int")
    got = {r.node: r.component for r in components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(e.limit(0), "a", "b").count() == 0


def test_grounding(spark, make_nodes):
    n = make_nodes(
        {"id": "a", "claim": "Recall gate of the substring search reached 0.9444 on the keyword set"},
        {"id": "b", "claim": "The gateway listens behind the northern firewall"},
        {"id": "old", "claim": "Nightly backup copies the ledger archive", "kind": "refuted"},
    )
    a = spark.createDataFrame([(1, "Recall gate of the substring search reached 0.9444 on the keyword set."), (2, "Recall gate of the substring search reached 0.9871 on the keyword set."), (3, "Nightly backup copies the ledger archive."), (4, "Completely invented zebra quartz. Is it so?"), (5, None)], "answer_id int, text string")
    v = {(r.answer_id, r.pos): r.verdict for r in N.verify_claims(n, N.split_claims(a)).collect()}
    assert v == {(1, 1): "supported", (2, 1): "partial", (3, 1): "refuted", (4, 1): "unsupported"}
    total = {r.answer_id: r.verdict for r in N.answer_verdicts(a, N.verify_claims(n, N.split_claims(a))).collect()}
    assert total == {1: "grounded", 2: "ungrounded", 3: "ungrounded", 4: "ungrounded", 5: "ungrounded"}


def test_rrf_prefers_shared_hits(spark):
    x = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "qid int, id string, rank int")
    y = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, id string, rank int")
    assert R.rrf([x, y]).orderBy("rank").first().id == "c"


def test_positions_with_ties(spark):
    rows = spark.createDataFrame([("s", i, float(i // 3 * 50000)) for i in range(20)], "k string, rec_id int, t double")
    p = L.positions(rows, "k", C("t"), "rec_id").orderBy("rec_id").collect()
    assert [r.pos for r in p] == list(range(1, 21)) and {r.n for r in p} == {20}


def test_prepass_ttl(spark):
    g = [(1, "prepare", "s", ["a"], dt(2026, 1, 1, 0, 0)), (2, "prepare", "s", [], dt(2026, 1, 1, 0, 30)), (3, "ground", "s", None, dt(2026, 1, 1, 0, 59)), (4, "ground", "s", None, dt(2026, 1, 1, 1, 1)), (5, "ground", "t", None, dt(2026, 1, 1, 0, 1))]
    df = spark.createDataFrame(g, "rec_id int, event string, session_id string, node_ids array<string>, ts timestamp_ntz")
    sec = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), C("ts"))
    assert {(r.rec_id, r.prepass_id) for r in N.prepass_asof(df, sec).collect()} == {(3, 1), (4, -1), (5, -1)}


def test_code(spark):
    rec = K.parsed(K.sample_files(spark).union(spark.createDataFrame([("bad.py", "def ("), ("none.py", None)], "path string, content string")))
    s = {r.qname: r.symbol_kind for r in K.symbols(rec).collect()}
    assert s["shop.cart.Cart.total"] == "method" and s["shop.cart.cart_total"] == "route" and s["shop.text.посчитать_итог"] == "function" and s["bad"] == s["none"] == "module"
    e = {(r.source, r.relation, r.target) for r in K.resolved(rec).collect()}
    assert ("shop.cart.Cart.pay", "CALLS", "shop.cart.Cart.total") in e and ("shop.cart.Cart", "INHERITS", "shop.base.Record") in e and ("shop.cart.Cart.total", "USAGE", "sum") in e
    top = K.search(K.symbols(rec), K.sample_queries(spark)).where("rank = 1").collect()
    assert {r.qid: r.qname for r in top}[1] == "shop.cart.Cart.total"
    files = K.file_search(K.symbols(rec), K.sample_files(spark), K.sample_queries(spark)).where("rank = 1").collect()
    assert {r.qid: r.file for r in files}[1] == "shop/cart.py"
    weights = spark.createDataFrame([("tests/a.py", 0.35), ("a/test_b.py", 0.35), ("b_test.py", 0.35), ("x/conftest.py", 0.35), ("docs/a.py", 0.5), ("vendor/b.py", 0.5), ("src/latest/a.py", 1.0), ("test", 1.0), (None, 1.0)], "p string, w double")
    assert all(r.w == r.got for r in weights.select("w", K.class_weight(F.col("p")).alias("got")).collect())
    c = K.counters(rec, K.resolved(rec)).first()
    assert c.files == 6 and c.resolved > 0 and c.usage > 0
    diff = spark.createDataFrame([("shop/text.py", "changed"), ("bad.py", "deleted"), ("new.py", "new")], "path string, change string")
    new = spark.createDataFrame([("shop/text.py", "def other():\n    pass\n"), ("new.py", "x = 1\n")], "path string, content string")
    after = {r.qname for r in K.symbols(K.reindexed(rec, new, diff)).collect()}
    assert {"shop.text.other", "new", "shop.cart.Cart.total"} <= after and not {"bad", "shop.text.посчитать_итог"} & after


def test_paths_are_followed_to_the_end(spark):
    """Farther than any fixed number of hops, and back round a cycle."""
    line = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a9", "a0"), ("a5", "b0"), ("b0", "b1"), ("b1", "b2")]
    got = {r.node: r.hops for r in G.distances(spark.createDataFrame(line, "src string, dst string"), spark.createDataFrame([("a0",)], "id string")).collect()}
    assert got == {**{f"a{i}": min(i, 10 - i) for i in range(10)}, "b0": 6, "b1": 7, "b2": 8}


def test_distances_stage_the_graph_and_not_the_pairs(spark, monkeypatch):
    """What is written on the way doesn't grow with hops or with sources times nodes."""
    n, kept, write = 120, [], G.staged
    monkeypatch.setattr(G, "staged", lambda df, *a: kept.append(write(df, *a)) or kept[-1])
    e = spark.createDataFrame([(f"a{i:03}", f"a{i + 1:03}") for i in range(n - 1)], "src string, dst string")
    got = {(r.source, r.node): r.hops for r in G.distances(e, spark.createDataFrame([(f"a{i:03}",) for i in range(n)], "id string")).collect()}
    assert got == {(f"a{i:03}", f"a{j:03}"): abs(i - j) for i in range(n) for j in range(n)}
    assert len(kept) <= 3 and sum(k.count() for k in kept) <= 4 * n


@pytest.mark.parametrize("hops", [None, 0, 2])
def test_distances_are_the_same_for_a_graph_too_large_to_broadcast(spark, monkeypatch, hops):
    """Several blocks of sources; parts, loops, repeated and null ends, sources without an edge."""
    rng = random.Random(5)
    rows = [(f"{p}{rng.randrange(m)}", f"{p}{rng.randrange(m)}") for p, m, k in (("a", 150, 190), ("b", 20, 25), ("c", 3, 9)) for _ in range(k)] + [("a1", None), (None, "b1")]
    ids = [f"a{i}" for i in range(150)] + ["b1", "b2", "c0", "alone", "alone", None]
    e, s = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(i,) for i in ids], "id string")
    near = {}
    for a, b in rows:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for x in {*ids} - {None}:
        at, front, seen = 0, {x}, {x}
        while front and (hops is None or at <= hops):
            want |= {(x, y, at) for y in front}
            front, at = {z for y in front for z in near.get(y, ())} - seen, at + 1
            seen |= front
    found = lambda: sorted(tuple(r) for r in G.distances(e, s, hops).collect())
    assert found() == sorted(want)
    monkeypatch.setattr(G, "LOCAL_PAIRS", 0)
    assert found() == sorted(want)


def test_distances_without_sources_or_edges(spark):
    e, s = spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("a",)], "id string")
    assert G.distances(e, s.limit(0)).collect() == []
    assert [tuple(r) for r in G.distances(e.limit(0), s).collect()] == [("a", "a", 0)]


def test_path_query_holds_every_source_and_hop(spark):
    import __spark_entry__ as entry
    from conftest import DATA

    d = str(DATA / "sf0.001")
    part, whole = ({(r.source, r.node): r.hops for r in entry.queries()[q](spark, d).collect()} for q in ("graph_path_len", "graph_path_all"))
    assert part.items() < whole.items() and max(whole.values()) > 4


def test_sources_fall_back_to_stale_nodes(spark, make_nodes):
    """A refuted claim and one without live candidates rest on stale nodes; an unsupported one has none."""
    n = make_nodes(
        {"id": "old", "kind": "outdated", "claim": "granite bridges carry forty wagons"},
        {"id": "bad", "kind": "refuted", "claim": "purple turbines whistle nightly"},
        {"id": "dim", "claim": "purple curtains"},
        {"id": "good", "claim": "silver harbours freeze early"},
        {"id": "gone", "kind": "refuted", "claim": "silver harbours"},
    )
    claims = spark.createDataFrame([(1, 1, "granite bridges carry forty wagons"), (2, 1, "purple turbines whistle nightly"), (3, 1, "silver harbours freeze early"), (4, 1, "unheard lanterns wander silver meadows slowly northward")], "answer_id int, pos int, claim string")
    assert {(r.answer_id, r.id) for r in N.source_nodes(n, claims).collect()} == {(1, "old"), (2, "bad"), (3, "good")}


def test_a_claim_of_several_answers_is_looked_up_once(spark, make_nodes, monkeypatch):
    n = make_nodes({"id": "a", "claim": "The gateway listens behind the northern firewall"}, {"id": "b", "claim": "Nightly backup copies the ledger archive"})
    a = spark.createDataFrame([(i, "The gateway listens behind the northern firewall. Velvet zebra quartz.") for i in range(3)], "answer_id int, text string")
    asked, supports = [], N.supports
    monkeypatch.setattr(N, "supports", lambda snap, claims: asked.append(claims.count()) or supports(snap, claims))
    got = {(r.answer_id, r.pos): r.verdict for r in N.verify_claims(n, N.split_claims(a)).collect()}
    assert asked == [2]
    assert got == {(i, p): v for i in range(3) for p, v in ((1, "supported"), (2, "unsupported"))}


def test_every_fact_is_evaluated(spark, make_nodes, tmp_path):
    claims = ("Velvet zebra quartz shone over Kilmarnock.", "Nightly backup copies the ledger archive.", "Nightly backup copies the ledger archive.", "Why?")
    make_nodes(*[{"id": f"n{i}", "seq": 7 + i, "claim": c} for i, c in enumerate(claims)]).write.parquet(str(tmp_path / "nodes.parquet"))
    got = {(r.form, r.verdict): r.n for r in entry.queries()["eval_confusion"](spark, str(tmp_path)).collect()}
    assert got == {("quote", "grounded"): 3, ("quote", "ungrounded"): 1, ("numbers swapped", "grounded"): 3, ("numbers swapped", "ungrounded"): 1, ("quote and invention", "partial"): 3, ("quote and invention", "ungrounded"): 1, ("invention", "ungrounded"): 4}


def test_verdicts_of_quotes_are_those_of_their_claims(spark, make_nodes):
    rng = random.Random(3)
    words = [a + b + "m" for a in ("bal", "kor", "zet", "win") for b in ("tan", "pix", "lod")]
    phrase = lambda k: " ".join(rng.sample([*words[: rng.choice((3, 5, 12))], "17", "248"], k))
    kinds = ("fact", "fact", "fact", "outdated", "rule", "hub")
    n = make_nodes(*[{"id": f"n{i}", "kind": kinds[i % 6], "claim": phrase(rng.randint(1, 5)) + rng.choice((".", "", "?", "; " + phrase(2))), "context": rng.choice(("", "copper", phrase(2))), "source": ""} for i in range(120)])
    quotes = n.where("kind = 'fact'").select("seq", F.substring("claim", 1, 30).alias("text"), R.node_text().alias("whole"))
    answers = [C("text"), F.translate("text", "0123456789", "1234567890"), F.concat("text", F.lit(" Copper umbrellas dance.")), F.lit("Copper umbrellas dance.")]
    got = {(r.form, r.verdict): r.n for r in N.quote_verdicts(n, quotes, [*answers[:3], None], "Copper umbrellas dance.").collect()}
    a = quotes.select("seq", F.posexplode(F.array(*answers)).alias("form", "text")).select((C("seq") * 4 + C("form")).alias("answer_id"), "text")
    want = collections.Counter((r.answer_id % 4, r.verdict) for r in N.answer_verdicts(a, N.verify_claims(n, N.split_claims(a))).collect())
    assert got == want and len({v for _, v in got}) == 3


def test_rows_that_arrived_first(spark, make_nodes):
    n = make_nodes({"id": "a", "seq": 4}, {"id": " A", "seq": 2, "claim": "first"}, {"id": "b", "seq": 3}, {"id": " ", "seq": 1}, {"id": "a", "seq": 9})
    assert sorted((r.seq, r.id, r.claim) for r in N.arrived_first(n).collect()) == sorted((r.seq, r.id, r.claim) for r in O.snapshot(n).collect()) == [(2, "a", "first"), (3, "b", "")]
