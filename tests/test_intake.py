from claimloom.functions import questions as T
from claimloom.functions import scalars as S
from claimloom.operators import grounding as N
from claimloom.operators import intake as I
from pyspark.sql import functions as F

NOW = 1782864000


def test_numbers_need_a_common_neighbour(spark):
    rows = [("rule 2 of the house", "rule 1 of the house, proof 2 fresh", 1), ("reached 0.50 today", "it reached 0.5", 0), ("build 0xE606 runs", "see 0xE606", 0), ("7", "7 days", 0), ("take 9", "nothing", 1), (None, "1", 0), ("x 5", None, 1)]
    d = spark.createDataFrame(rows, "claim string, node string, want int")
    got = d.select("want", N.numbers_missing(N.number_contexts(F.col("claim")), N.number_contexts(F.col("node"))).alias("n")).collect()
    assert [r.n for r in got] == [r.want for r in got]


def test_question_class(spark):
    rows = [("где порт?", "simple", "world_state"), ("почему и как устроен склад, и что делать с ним, или план на весь год вперёд готов сейчас", "complex", "sys_cmd"), ("", "simple", ""), (None, "simple", "")]
    d = spark.createDataFrame(rows, "q string, level string, intent string")
    for r in d.select("level", F.col("intent").alias("want"), T.question_class(F.col("q")).alias("c")).collect():
        assert (r.c.complexity, r.c.intent) == (r.level, r.want)


def test_router_tags_and_sentences(make_nodes):
    n = make_nodes({"id": "a", "claim": "правило: нельзя трогать", "tags": ["x"]}, {"id": "b", "claim": "роли команды", "tags": None}, {"id": "c", "claim": None, "context": None}, {"id": "d", "claim": "роли команды", "tags": ["World_State", "y", "sys_cmd"]}, {"id": "e", "claim": "plain", "kind": "rule"})
    tags = {r.id: r.t for r in n.select("id", T.router_tags(F.col("tags"), F.col("claim"), F.col("context"), F.col("kind")).alias("t")).collect()}
    assert tags == {"a": ["x", "sys_cmd"], "b": ["persona_def"], "c": ["world_state"], "d": ["y", "world_state"], "e": ["sys_cmd"]}
    s = {r.id: r.s for r in make_nodes({"id": "a", "claim": "One  two. Three."}, {"id": "b", "claim": "w " * 200}, {"id": "c", "claim": None}, {"id": "d", "claim": "no end mark 3.5 here"}).select("id", T.first_sentence(F.col("claim"), 20).alias("s")).collect()}
    assert s["a"] == "One two." and s["c"] == "" and s["d"] == "no end mark 3.5 here" and len(s["b"]) <= 20 and s["b"].endswith("…")


def test_depths_and_child_inserts(make_nodes):
    rows = [{"id": f"d{i}", "parent": f"d{i + 1}"} for i in range(9)] + [{"id": "d9"}, {"id": "l1", "parent": "L2"}, {"id": "l2", "parent": "l1"}, {"id": "x", "parent": "l1"}, {"id": "y", "parent": "gone"}, {"id": "s", "parent": "s"}]
    n = make_nodes(*rows)
    d = {r.id: (r.depth, r.top_id) for r in I.depths(n).collect()}
    assert d["d0"] == (9, "d9") and d["d9"] == (0, "d9") and d["l1"] == d["x"] == d["s"] == (-1, "") and d["y"] == (0, "y")
    v = {r.id: r.verdict for r in I.child_inserts(n).collect()}
    assert v["d8"] == "ok" and v["d0"] == "deep" and v["l1"] == v["x"] == v["s"] == "cycle" and v["y"] == "missing" and "d9" not in v
    assert I.depths(n.limit(0)).count() == I.child_inserts(n.limit(0)).count() == 0


def test_intake_rejects_copies_and_reinforces(make_nodes):
    base = {"source": "official report", "evidence": ["log 1"], "context": "seen", "confidence": None, "ts": "2026-06-01T00:00:00Z"}
    n = make_nodes({**base, "id": "a", "claim": "The northern valve sorted 57 records near the harbour"}, {**base, "id": "b", "claim": "The northern valve sorted 57 records near the harbour"}, {**base, "id": "h", "claim": "hub", "kind": "hub"}, {**base, "id": "w", "claim": "maybe 3 words here", "source": "report"})
    got = {r.id: r for r in I.intake(n, NOW).collect()}
    assert got["a"].outcome == "added" and got["a"].confidence == 1.0 and got["b"].outcome == "rejected" and got["b"].reinforces == "a"
    assert got["h"].outcome == "refused" and got["w"].kind == "hypothesis"
    assert {(r.id, r.n, r.weight) for r in I.reinforced(I.intake(n, NOW), n).collect()} == {("a", 1, 1.0)}
    assert {r.id: r.verdict for r in I.verified_weights(n, NOW).collect()}["a"] == "pass"


def test_fallback_hubs_and_conflicts(spark, make_nodes):
    n = make_nodes({"id": "h", "kind": "hub", "tags": ["entity:valve", "entity:"]}, {"id": "k", "kind": "hub", "tags": None}, {"id": "a"}, {"id": "b"})
    q = spark.createDataFrame([(1, "the VALVE stopped"), (2, "one"), (3, None)], "qid int, q string")
    assert [tuple(r) for r in I.query_hubs(q, n).collect()] == [(1, "h", "valve")]
    e = spark.createDataFrame([(1, "a", "b", "conflicts_with", "x"), (2, "b", "a", "conflicts_with", "x"), (3, "a", "gone", "conflicts_with", "x"), (4, "h", "a", "has_part", "x"), (5, "h", "k", "related_to", None)], "edge_id bigint, src string, dst string, rel string, author string")
    res = spark.createDataFrame([(1, "a")], "qid int, id string")
    assert [tuple(r) for r in I.result_conflicts(res, e, n).collect()] == [(1, "a", "b", 2)]
    assert {tuple(r) for r in I.related_hubs(e, n).collect()} == {("h", 1, 1), ("k", 0, 1)}
    first = spark.createDataFrame([(1, "a", 1.0, 1)], "qid int, id string, score double, rank int")
    second = spark.createDataFrame([(1, "b", 1.0, 1), (2, "b", 1.0, 1), (3, "b", 1.0, 1)], "qid int, id string, score double, rank int")
    assert {(r.qid, r.mode) for r in I.with_fallback(first, second, q).collect()} == {(1, "substring")}
    assert I.with_tags(n, F.array(F.lit("entity:valve"))).count() == 1
    assert S.budget_tokens is not None and I.link_passports(e).count() == 3
