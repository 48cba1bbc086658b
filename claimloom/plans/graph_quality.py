"""Queries p2 (hierarchies) and p6 (orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators.hierarchy import ancestor_pairs, hierarchy
from claimloom.operators.orphans import orphan_references, orphan_report
from claimloom.plans.registry import core
from claimloom.runtime import table

NORM = "nullif(trim(lower({}), chr(32) || chr(9) || chr(10) || chr(13)), '')"

_LINKS = f"""
ids AS (SELECT DISTINCT {NORM.format('id')} AS id FROM nodes WHERE {NORM.format('id')} IS NOT NULL),
stated AS (
  SELECT {NORM.format('id')} AS child, {NORM.format('parent')} AS parent FROM nodes
  UNION SELECT {NORM.format('c')}, {NORM.format('id')} FROM (SELECT id, unnest(children) AS c FROM nodes)),
links AS (SELECT DISTINCT child, parent FROM stated WHERE child IN (SELECT id FROM ids) AND parent IN (SELECT id FROM ids)),
-- UNION stops the recursion once a round finds only known rows; a walk is cut after it closed its cycle
walk(ancestor_id, descendant_id, hops, seen) AS (
  SELECT parent, child, 1, [parent] FROM links
  UNION ALL
  SELECT l.parent, w.descendant_id, w.hops + 1, list_append(w.seen, l.parent) FROM walk w JOIN links l ON l.child = w.ancestor_id
  WHERE w.ancestor_id <> w.descendant_id AND NOT list_contains(w.seen, l.parent)),
pairs AS (SELECT ancestor_id, descendant_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY ALL)
"""


@core.query("p2_found", f"WITH RECURSIVE {_LINKS} SELECT ancestor_id, descendant_id, hops FROM pairs")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestor_pairs(table(spark, sf_dir, "nodes"))


@core.query(
    "p2_hierarchy",
    f"""WITH RECURSIVE {_LINKS},
loops AS (SELECT ancestor_id FROM pairs WHERE ancestor_id = descendant_id),
above AS (SELECT descendant_id AS id, list(ancestor_id ORDER BY hops DESC, ancestor_id) AS up, max(hops) AS hops,
                 bool_or(ancestor_id IN (SELECT ancestor_id FROM loops)) AS cyclic FROM pairs GROUP BY 1),
below AS (SELECT ancestor_id AS id, count(*) AS n FROM pairs GROUP BY 1)
SELECT i.id AS node_id, array_to_string(list_append(coalesce(up, []), i.id), '/') AS path,
       CASE WHEN coalesce(cyclic, false) THEN -1 ELSE coalesce(hops, 0) END AS depth,
       CASE WHEN NOT coalesce(cyclic, false) THEN coalesce(up[1], i.id) END AS root_id,
       coalesce(n, 0) AS n_descendants, coalesce(cyclic, false) AS in_cycle
FROM ids i LEFT JOIN above a ON a.id = i.id LEFT JOIN below b ON b.id = i.id""",
)
def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "nodes"))


_ORPHANS = f"""
refs AS (
  SELECT 'nodes' AS ref_table, {NORM.format('id')} AS ref_key, {NORM.format('t')} AS target_id, arrived_at FROM (SELECT id, unnest(links) AS t, arrived_at FROM nodes)
  UNION ALL SELECT 'edges', CAST(edge_id AS VARCHAR), {NORM.format('t')}, arrived_at FROM (SELECT edge_id, unnest([src, dst]) AS t, arrived_at FROM edges)
  UNION ALL SELECT 'ground_log', CAST(rec_id AS VARCHAR), {NORM.format('t')}, arrived_at FROM (SELECT rec_id, unnest(node_ids) AS t, arrived_at FROM ground_log)),
r AS (SELECT ref_table, ref_key, target_id, min(arrived_at) AS ref_at FROM refs WHERE target_id IS NOT NULL AND ref_key IS NOT NULL GROUP BY ALL),
n AS (SELECT {NORM.format('id')} AS id, min(arrived_at) AS first_at, max(arrived_at) AS last_at FROM nodes GROUP BY 1),
t AS (SELECT {NORM.format('id')} AS id, max(deleted_at) AS deleted_at FROM tombstones GROUP BY 1),
found AS (
  SELECT * FROM (
    SELECT ref_table, ref_key, target_id,
      CASE WHEN n.id IS NULL AND t.id IS NULL THEN 'missing'
           WHEN n.id IS NULL OR t.deleted_at > n.last_at THEN 'deleted'
           WHEN n.first_at > r.ref_at THEN 'late' END AS status,
      strftime(ref_at, '%Y-%m') AS period
    FROM r LEFT JOIN n ON n.id = r.target_id LEFT JOIN t ON t.id = r.target_id) WHERE status IS NOT NULL)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("nodes", "edges", "ground_log", "tombstones")))


@core.query("p6_found", f"WITH {_ORPHANS} SELECT ref_table, ref_key, target_id, status, period FROM found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@core.query("p6_report", f"WITH {_ORPHANS} SELECT ref_table, period, status, count(*) AS n_refs, count(DISTINCT target_id) AS n_targets FROM found GROUP BY ALL")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))
