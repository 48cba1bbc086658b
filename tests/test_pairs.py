"""The similarity join of the gates against all pairs, and its plan."""

import random

from claimloom.operators import quality as Q


def sets(spark, rng, n, sided):
    rows = [(i, bool(i % 3 == 0) if sided else None, rng.sample(range(60), rng.randint(1, 14))) for i in range(n)]
    # a word of nearly all sets, equal sets and a set alone
    rows = [(e, s, sorted({*w, 99})) for e, s, w in rows] + [(n, True if sided else None, [1, 2, 99]), (n + 1, False if sided else None, [1, 2, 99]), (n + 2, None if not sided else True, [500])]
    return rows, spark.createDataFrame(rows, "e bigint, side boolean, w array<bigint>")


def test_pairs_are_those_of_all_pairs(spark):
    for seed, (threshold, sided) in enumerate([(0.55, False), (0.3, True)]):
        rows, df = sets(spark, random.Random(seed), 150, sided)
        want = {(a, b) for a, sa, wa in rows for b, sb, wb in rows if ((sa and not sb) if sided else a < b) and round(len({*wa} & {*wb}) / len({*wa} | {*wb}), 6) >= threshold}
        got = [tuple(r) for r in Q.claim_pairs(df, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (150, 151) in want


def test_no_side_that_grows_goes_to_the_driver(make_nodes):
    n = make_nodes({"id": "a", "claim": "servers stay open at night"}, {"id": "b", "claim": "servers never stay open at night"}, {"id": "c", "claim": "Servers stay open at night."})
    assert [(r.id, r.duplicate_of, r.n_similar) for r in Q.gate_duplicates(n).collect()] == [("c", "a", 0)]
    assert {(r.id, r.against) for r in Q.gate_contrary(n).collect()} == {("a", "b"), ("b", "a"), ("c", "b")}
    for found in (Q.gate_duplicates(n), Q.gate_contrary(n)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
