import pytest
from claimloom.engine import Engine, as_flag, as_float, as_int, as_list

NOW = 1782864000


@pytest.fixture(scope="module")
def engine(spark, make_nodes):
    n = make_nodes(
        {"id": "A", "claim": "The northern valve sorted 57 records near the harbour", "context": "seen", "evidence": ["log"], "tags": ["x", "y"], "weight": 0.9},
        {"id": "b", "claim": "Nightly backup copies the ledger archive", "kind": "refuted"},
        {"id": "c", "claim": "The southern motor stopped", "kind": "hypothesis", "tags": None},
        {"id": "h", "claim": "hub of valves", "kind": "hub", "tags": ["entity:valve"]},
    )
    e = spark.createDataFrame([(1, "h", "a", "has_part", "t"), (2, " A", "c", None, None), (3, "c", "gone", "supersedes", "t")], "edge_id bigint, src string, dst string, rel string, author string")
    return Engine(n, e, NOW)


def ids(df):
    return [r.id for r in df.collect()]


def test_coercion():
    assert as_int("7", 5, 1, 50) == 7 and as_int(900, 5, 1, 50) == 50 and as_int("x", 5, 1, 50) == as_int(None, 5, 1, 50) == 5 and as_int(-3, 5, 1, 50) == 1
    assert as_float("0.5", 1) == 0.5 and as_float("nan", 1) == 1 and as_flag("да") and not as_flag("no") and as_flag(None, True)
    assert as_list(None) == [] and as_list("a") == ["a"] and as_list((1, 2)) == ["1", "2"]


def test_searches(engine):
    assert ids(engine.call("search", query="valve")) == ["a"]
    assert ids(engine.call("search", query="records valve northern")) == ["a"]  # no such phrase: by words
    assert ids(engine.call("search", query="valve", tags="x", kind="fact", top_k="3")) == ["a"]
    assert ids(engine.call("search", query="valve", tags=["x", "z"])) == ids(engine.call("search", query="valve", kind="rule")) == []
    assert ids(engine.call("search", query="the southern motor stopped", mode="exact")) == ["c"]
    assert ids(engine.call("search", query="northern valve", mode="budget")) == ids(engine.call("search", query="northern valve", mode="rrf")) == ["a"]
    assert ids(engine.call("search", query="valve records", mode="budget", relevance="2")) == ["a"]


def test_errors(engine):
    for tool, args, kind in (("nothing", {}, KeyError), ("search", {"query": " "}, ValueError), ("search", {"query": "x", "mode": "magic"}, ValueError), ("search", {"query": "x", "odd": 1}, ValueError), ("prune", {"rule": "all"}, ValueError), ("graph", {"action": "x"}, ValueError), ("verify", {}, ValueError), ("add", {}, ValueError)):
        with pytest.raises(kind):
            engine.call(tool, **args)
    assert {"search", "ground", "add", "graph"} <= set(Engine.tools())


def test_other_tools(engine, make_nodes):
    assert {r.verdict for r in engine.call("ground", answer="The northern valve sorted 57 records near the harbour.").collect()} == {"ungrounded"}
    assert {r.verdict for r in engine.call("ground", answer="The northern valve sorted 57 records near the harbour.", pre_pass="yes").collect()} == {"grounded"}
    assert [(r.neighbour, r.direction) for r in engine.call("graph", node_id="a").orderBy("neighbour").collect()] == [("c", "out"), ("h", "in")]
    assert engine.call("graph", action="broken").count() == 1 and engine.call("graph", action="hubs").first().n_members == 1
    assert engine.call("verify", node_id=" a ").first().verdict == "pass" and engine.call("reinforce", node_id="a", delta="0.5").first().weight == 1.0
    got = {r.id: r.outcome for r in engine.call("add", rows=make_nodes({"id": "new", "claim": "The northern valve sorted 57 records near the harbour", "source": "report", "seq": 99})).collect()}
    assert got == {"new": "rejected"}
    assert {r.kind: r.n_inactive for r in engine.call("stats").collect()}["refuted"] == 1
    assert engine.call("prune").count() == 0 and engine.call("decay").count() == 4 and engine.call("gates").count() == 4 and engine.call("answer", query="northern valve").count() == 1
