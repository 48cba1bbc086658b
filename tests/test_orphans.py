from datetime import datetime as dt

from claimloom.operators.orphans import bloom_words, might_contain, orphan_references, orphan_report
from pyspark.sql import functions as F


def test_statuses_and_dirty_references(spark, make_nodes):
    n = make_nodes(
        {"id": "a", "links": ["B ", "gone", None, " ", "late", "gone"], "arrived_at": dt(2026, 1, 5)},
        {"id": "b", "arrived_at": dt(2026, 1, 1)},
        {"id": "late", "arrived_at": dt(2026, 3, 1)},
        {"id": "dead", "arrived_at": dt(2026, 1, 1)},
        {"id": "back", "arrived_at": dt(2026, 1, 1)},
        {"id": "back", "arrived_at": dt(2026, 4, 1)},
        {"id": "nolinks", "links": None},
    )
    e = spark.createDataFrame([(7, "DEAD", "back", dt(2026, 2, 1), 1), (7, "DEAD", "back", dt(2026, 2, 3), 1), (8, None, "b", dt(2026, 2, 1), 1)], "edge_id bigint, src string, dst string, arrived_at timestamp_ntz, target_id int")
    g = spark.createDataFrame([(1, ["tomb", "a"], dt(2026, 5, 1)), (2, None, dt(2026, 5, 1))], "rec_id bigint, node_ids array<string>, arrived_at timestamp_ntz")
    t = spark.createDataFrame([("tomb", dt(2025, 1, 1)), (" Dead", dt(2026, 1, 2)), ("back", dt(2026, 2, 1))], "id string, deleted_at timestamp_ntz")
    found = orphan_references(n, e, g, t)
    rows = {tuple(r) for r in found.collect()}
    assert rows == {
        ("nodes", "a", "gone", "missing", "2026-01"),
        ("nodes", "a", "late", "late", "2026-01"),
        ("edges", "7", "dead", "deleted", "2026-02"),
        ("ground_log", "1", "tomb", "deleted", "2026-05"),
    }
    assert found.count() == 4
    assert orphan_report(found).count() == 4
    # A saturated filter proves nothing, but the exact join still gives the same rows.
    assert {tuple(r) for r in orphan_references(n, e, g, t, max_bits=64).collect()} == rows
    assert orphan_references(n.limit(0), e.limit(0), g.limit(0), t.limit(0)).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    words, bits = bloom_words(keys, "k", 5000)
    w = words.scalar()
    assert keys.where(~might_contain(w, F.col("k"), bits)).count() == 0
    others = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert others.where(might_contain(w, F.col("k"), bits)).count() < 400
