import random

from claimloom.operators.hierarchy import ancestor_pairs, hierarchy, hierarchy_links, peel


def brute(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = set()
    for n in {x for e in links for x in e}:
        seen, front, h = {}, {n}, 0
        while front:
            h += 1
            front = {p for x in front for p in up.get(x, ())} - seen.keys()
            for p in front:
                seen[p] = h
        out |= {(a, n, h) for a, h in seen.items()}
    return out


def test_random_graphs_with_cycles_and_several_parents(spark):
    r = random.Random(4)
    links = {(f"c{i}", f"c{(i + 1) % 13}") for i in range(13)}  # a cycle longer than the levels of a round
    links |= {(f"d{i}", f"d{i + 1}") for i in range(30)} | {("d0", "c4"), ("x", "d3"), ("x", "d20"), ("self", "self"), ("y", "self")}
    links |= {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(38)}
    got = {tuple(x) for x in peel(spark.createDataFrame(sorted(links), "child string, parent string")).collect()}
    assert got == brute(links)


def test_dirty_links_and_empty_table(spark, make_nodes):
    n = make_nodes(
        {"id": "A", "children": [" b ", "b", None, "", "gone"]},
        {"id": "b", "parent": "zzz"},
        {"id": "c", "parent": "B\t"},
        {"id": "c", "parent": "B\t"},
        {"id": "l1", "parent": "l2"},
        {"id": "l2", "children": None, "parent": "l1"},
        {"id": None, "parent": "b"},
        {"id": "alone", "parent": "  "},
    )
    assert {tuple(r) for r in hierarchy_links(n).collect()} == {("b", "a"), ("c", "b"), ("l1", "l2"), ("l2", "l1")}
    assert {tuple(r) for r in ancestor_pairs(n).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("l1", "l1", 2), ("l2", "l2", 2), ("l1", "l2", 1), ("l2", "l1", 1)}
    h = {r.node_id: r for r in hierarchy(n).collect()}
    assert h["c"].path == "a/b/c" and h["c"].depth == 2 and h["c"].root_id == "a" and h["a"].n_descendants == 2
    assert h["alone"].depth == 0 and h["alone"].root_id == "alone" and not h["alone"].in_cycle
    assert h["l1"].in_cycle and h["l1"].depth == -1 and h["l1"].root_id is None
    assert ancestor_pairs(n.limit(0)).count() == 0
    assert hierarchy(n.limit(0)).count() == 0


def test_long_cycle_and_what_hangs_on_it(spark):
    """A cycle of 500 nodes with a tail below and a chain above takes log rounds."""
    links = [(f"c{i:03}", f"c{(i + 1) % 500:03}") for i in range(500)] + [("t1", "c000"), ("t0", "t1"), ("c250", "up1"), ("up1", "up2")]
    got = {tuple(x) for x in peel(spark.createDataFrame(links, "child string, parent string")).collect()}
    assert got == brute(links)


def test_deep_chain(spark):
    links = [(f"d{i:03}", f"d{i + 1:03}") for i in range(60)]
    assert {tuple(x) for x in peel(spark.createDataFrame(links, "child string, parent string")).collect()} == brute(links)
