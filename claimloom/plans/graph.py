"""Graph queries (GR-*, JN-1..3, AG-16, AG-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import graph as G
from claimloom.plans.registry import core
from claimloom.plans.search import _NT, edges
from claimloom.plans.sqlbits import ACTIVE, EDGES, NOW, SNAP, decayed, iso, nid, tokens, weight
from claimloom.plans.store import snap

C = F.col
_RES = "r AS (SELECT DISTINCT src, dst, rel FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"
_OF = "o AS (SELECT id FROM n WHERE seq % 50 = 0)"


@core.query("graph_neighbors", f"WITH {SNAP}, {EDGES}, {_RES}, {_OF} SELECT src AS id, dst AS neighbour, rel, 'out' AS direction FROM r WHERE src IN (SELECT id FROM o) UNION ALL SELECT dst, src, rel, 'in' FROM r WHERE dst IN (SELECT id FROM o)")
def graph_neighbors(s: SparkSession, d: str) -> DataFrame:
    n = snap(s, d)
    return G.neighbours(edges(s, d), n, n.where("seq % 50 = 0"))


@core.query(
    "graph_path_len",
    f"""WITH RECURSIVE {SNAP}, {EDGES}, a AS (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e), p(source, node, hops) AS (SELECT id, id, 0 FROM n WHERE seq % 250 = 0 UNION SELECT source, dst, hops + 1 FROM p JOIN a ON a.src = p.node WHERE hops < 3)
SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM p GROUP BY ALL""",
)
def graph_path_len(s: SparkSession, d: str) -> DataFrame:
    """The part of graph_path_all that its SQL states: a fifth of the sources, three hops."""
    return G.distances(edges(s, d), snap(s, d).where("seq % 250 = 0"), 3)


@core.query("graph_path_all")
def graph_path_all(s: SparkSession, d: str) -> DataFrame:
    """GR-2 whole: all sources of the stated query set, until no node is left to reach."""
    return G.distances(edges(s, d), snap(s, d).where("seq % 50 = 0"))


@core.query("graph_conflicts", f"WITH {SNAP}, {EDGES}, {_RES} SELECT src, dst, rel FROM r WHERE rel IN ('conflicts_with', 'supersedes', 'duplicate_of')")
def graph_conflicts(s: SparkSession, d: str) -> DataFrame:
    return G.conflicts(edges(s, d), snap(s, d))


_ROUTER = "coalesce(list_filter(coalesce(tags, []), lambda t: t IN ('sys_cmd', 'persona_def', 'world_state'))[1], '?')"


@core.query("graph_hubs", f"WITH {SNAP}, {EDGES}, {_RES}, m AS (SELECT DISTINCT r.src, r.dst FROM r JOIN n h ON h.id = r.src AND h.kind = 'hub' WHERE rel = 'has_part') SELECT src AS hub_id, {_ROUTER} AS router, count(*) AS n_members FROM m JOIN n ON n.id = dst GROUP BY ALL")
def graph_hubs(s: SparkSession, d: str) -> DataFrame:
    return G.hub_members(edges(s, d), snap(s, d))


@core.query("graph_superseded", f"WITH {SNAP}, {EDGES}, {_RES} SELECT dst AS id, min(src) AS by, count(*) AS n FROM r WHERE rel = 'supersedes' AND src IN (SELECT id FROM n WHERE {ACTIVE}) GROUP BY 1")
def graph_superseded(s: SparkSession, d: str) -> DataFrame:
    return G.superseded(edges(s, d), snap(s, d), NOW)


@core.query("broken_edges", f"WITH {SNAP}, {EDGES} SELECT edge_id, src, dst FROM e WHERE dst NOT IN (SELECT id FROM n)")
def broken_edges(s: SparkSession, d: str) -> DataFrame:
    return G.broken_edges(edges(s, d), snap(s, d))


SITUATIONS = [(1, "vornal valve scheduler stopped"), (2, "tarev archive night index"), (3, "memory search report")]
_SQ = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SITUATIONS) + ") t(qid, q))"


@core.query(
    "graph_rules_for",
    f"""WITH {SNAP}, {EDGES}, {_RES}, {_SQ}, hb AS (SELECT id, t[8:] AS entity FROM (SELECT id, unnest(tags) AS t FROM n WHERE kind = 'hub') WHERE starts_with(t, 'entity:')),
p0 AS (SELECT qid, r.dst AS id, 1.0 AS s FROM hb, q, r WHERE contains(q.q, entity) AND r.src = hb.id AND r.rel = 'has_part'
 UNION ALL SELECT qid, id, 0.5 FROM (SELECT DISTINCT id, unnest({tokens(_NT)}) AS token FROM n WHERE kind <> 'hub') JOIN (SELECT DISTINCT qid, unnest({tokens('q')}) AS token FROM q) USING (token)),
p1 AS (SELECT qid, id, sum(s) AS s FROM p0 GROUP BY ALL), hop AS (SELECT src AS id, dst AS nb FROM r WHERE rel IN ('supersedes', 'conflicts_with') UNION SELECT dst, src FROM r WHERE rel IN ('supersedes', 'conflicts_with')),
p2 AS (SELECT * FROM p1 UNION ALL SELECT qid, nb, 0.8 FROM (SELECT DISTINCT qid, nb FROM p1 JOIN hop USING (id)) x WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.qid = x.qid AND p1.id = x.nb)),
sc AS (SELECT qid, n.id, round(s + {decayed(weight(0.05), iso('last_used'))} + greatest(0, 1 - floor(({NOW} - coalesce({iso('ts')}, {NOW})) / 86400) / 60.0) + CASE WHEN kind = 'rule' THEN 0.5 ELSE 0 END
 + CASE WHEN n.id IN (SELECT dst FROM r WHERE rel = 'supersedes') THEN -1.5 ELSE 0 END + CASE WHEN n.id IN (SELECT src FROM r WHERE rel = 'supersedes') THEN 0.5 ELSE 0 END, 3)::DOUBLE AS score
 FROM p2 JOIN n ON n.id = p2.id WHERE kind NOT IN ('refuted', 'outdated', 'hub') AND list_contains(tags, 'sys_cmd'))
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM sc QUALIFY rank <= 10""",
)
def graph_rules_for(s: SparkSession, d: str) -> DataFrame:
    return G.rules_for(edges(s, d), snap(s, d), s.createDataFrame(SITUATIONS, "qid int, q string"), NOW)
