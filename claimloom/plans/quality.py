"""Queries of the quality checks and gates (TG, GT, JN-5, 6, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import quality as Q
from claimloom.plans.registry import core
from claimloom.plans.sqlbits import LINKS, NOW, SNAP, any_of, content_tokens, gate_tokens, iso, nid, tier, weight
from claimloom.plans.store import snap

C = F.col
QUERIES = [(1, "valve scheduler readings"), (2, "журнал проверил канал"), (3, "report committee panel archive"), (4, "operator holder status")]
QSQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ") t(qid, q))"


def queries_df(s: SparkSession) -> DataFrame:
    return s.createDataFrame(QUERIES, "qid int, q string")


@core.query(
    "truth_gate",
    f"""WITH {SNAP}, k AS (SELECT id, {nid('x')} AS dst FROM (SELECT id, unnest(links) AS x FROM n)), br AS (SELECT k.id, bool_or(dst IS NULL OR coalesce(m.kind = 'refuted', false)) AS broken FROM k LEFT JOIN n m ON m.id = k.dst GROUP BY 1),
p AS (SELECT n.id, coalesce({iso('ts')} <= {NOW} + 300 AND {iso('ts')} >= {NOW} - 365 * 86400, false) AS p1, trim(coalesce(source, '')) <> '' AS p2, regexp_matches(coalesce(claim, ''), '\\p{{Nd}}') AS p3,
 NOT coalesce(broken, false) AS p4, len(list_filter(coalesce(evidence, []), lambda x: trim(coalesce(x, '')) <> '')) > 0 AS p5, trim(coalesce(context, '')) <> '' AS p6 FROM n LEFT JOIN br USING (id)),
s AS (SELECT *, CAST(p1 AS INTEGER) + CAST(p2 AS INTEGER) + CAST(p3 AS INTEGER) + CAST(p4 AS INTEGER) + CAST(p5 AS INTEGER) + CAST(p6 AS INTEGER) AS score FROM p)
SELECT *, CASE WHEN score >= 4 THEN 'pass' ELSE 'fail' END AS verdict FROM s""",
)
def truth_gate(s: SparkSession, d: str) -> DataFrame:
    return Q.truth_gate(snap(s, d), NOW)


_LOW = "lower(coalesce(claim, ''))"
_H = f"CASE WHEN {any_of(_LOW, S.HEDGES)} THEN 0.35 ELSE 0.75 END"
_G1C = f"coalesce(confidence, CASE WHEN trim(coalesce(source, '')) = '' THEN least(0.25, (CASE WHEN {any_of(_LOW, S.CERTAIN)} THEN greatest(0.85, {_H}) ELSE {_H} END)) WHEN {any_of(_LOW, S.CERTAIN)} THEN greatest(0.85, {_H}) ELSE {_H} END)"
_G1 = f"CASE WHEN kind = 'hypothesis' THEN 'pass' WHEN {_G1C} < 0.30 THEN 'reject' WHEN {_G1C} < 0.50 THEN 'flag' ELSE 'pass' END"
_G2 = f"CASE WHEN {iso('ts')} IS NULL OR {NOW} - {iso('ts')} > (CASE WHEN {any_of(_LOW, S.VOLATILE)} THEN 7 ELSE 365 END) * 86400 THEN 'reject' ELSE 'pass' END"


@core.query("gate_confidence", f"WITH {SNAP} SELECT id, {_G1} AS verdict FROM n")
def gate_confidence(s: SparkSession, d: str) -> DataFrame:
    return snap(s, d).select("id", Q.confidence_gate().alias("verdict"))


@core.query("gate_staleness", f"WITH {SNAP} SELECT id, {_G2} AS verdict FROM n")
def gate_staleness(s: SparkSession, d: str) -> DataFrame:
    return snap(s, d).select("id", Q.staleness_gate(NOW).alias("verdict"))


_G3 = f"t3 AS (SELECT *, {tier('source')} AS tier FROM n), b3 AS (SELECT src AS id, arg_min(dst, pos) AS dst FROM l JOIN t3 ON t3.id = l.dst WHERE tier = 'C' AND kind = 'fact' GROUP BY 1), g3 AS (SELECT t3.id, tier, coalesce(b3.dst, '') AS bad_link, CASE WHEN b3.dst IS NOT NULL THEN 'reject' WHEN tier = 'C' AND kind = 'fact' THEN 'reject' WHEN tier = 'C' THEN 'flag' ELSE 'pass' END AS verdict FROM t3 LEFT JOIN b3 USING (id))"


@core.query("gate_source", f"WITH {SNAP}, {LINKS}, {_G3} SELECT * FROM g3")
def gate_source(s: SparkSession, d: str) -> DataFrame:
    return Q.source_gate(snap(s, d))


@core.query(
    "gate_relevance",
    f"""WITH {SNAP}, {QSQL}, t AS (SELECT qid, {gate_tokens('q')} AS qt FROM q), x AS (SELECT qid, id, len(list_filter(qt, lambda w: contains(lower(coalesce(claim, '')), w))) AS a, len(list_filter(qt, lambda w: contains(lower(coalesce(context, '')), w))) AS b, len(list_filter(qt, lambda w: contains(lower(coalesce(source, '')), w))) AS c FROM n, t)
SELECT qid, id, round(3.0 * a + 1.5 * b + 1.0 * c, 6)::DOUBLE AS score, CASE WHEN 3.0 * a + 1.5 * b + 1.0 * c < 2.0 THEN 'reject' ELSE 'pass' END AS verdict FROM x WHERE a + b + c > 0""",
)
def gate_relevance(s: SparkSession, d: str) -> DataFrame:
    return Q.relevance_gate(snap(s, d), queries_df(s))


@core.query(
    "recency_conflict",
    f"""WITH {SNAP}, r AS (SELECT id, seq, claim, {iso('ts')} AS t, array_to_string(({gate_tokens('claim')})[1:2], ' ') AS subject FROM n), k AS (SELECT * FROM r WHERE t IS NOT NULL AND subject <> ''),
top AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY subject ORDER BY t DESC, seq DESC) = 1) SELECT k.id, k.subject, top.id AS newer_id FROM k JOIN top USING (subject) WHERE top.t > k.t AND top.claim <> k.claim""",
)
def recency_conflict(s: SparkSession, d: str) -> DataFrame:
    return Q.recency_conflicts(snap(s, d))


# salient: tickers need word boundaries without look-around, so the text is cut into words first
_TEXT = "regexp_replace(coalesce(claim, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?', ' ', 'g')"
_NUMS = f"list_transform(regexp_extract_all({_TEXT}, '[0-9]+(?:[.,][0-9]+)?'), lambda x: CASE WHEN contains(replace(x, ',', '.'), '.') THEN regexp_replace(replace(x, ',', '.'), '\\.?0+$', '') ELSE x END)"
_TICK = f"list_filter(regexp_extract_all({_TEXT}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-ZА-Я][A-ZА-Я0-9]{{1,11}}'))"
_DEC = "list_filter([" + ", ".join(f"'{m}'" for m in S.DECISIONS) + f"], lambda m: contains(lower({_TEXT}), m))"
_SAL = f"list_sort(list_distinct(list_concat(list_concat({_NUMS}, {_TICK}), {_DEC})))"
_NEG = any_of("(' ' || lower(coalesce(claim, '')) || ' ')", S.NEGATIONS)
_FACETS = f"f AS (SELECT id, seq, kind, {weight(1.0)} AS weight, len(coalesce(evidence, [])) AS n_ev, list_sort(list_distinct({content_tokens('claim')})) AS tk, {_NEG} AS neg, {_SAL} AS sal FROM n), u AS (SELECT * FROM f WHERE len(tk) > 0)"
_PAIRS = """w AS (SELECT id, unnest(tk) AS t FROM u), m AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.t = b.t AND a.id <> b.id GROUP BY ALL),
j AS (SELECT a, b, round(c / (len(x.tk) + len(y.tk) - c), 6) AS s FROM m JOIN u x ON x.id = a JOIN u y ON y.id = b)"""
_DUP = "dup AS (SELECT a AS id, min(struct_pack(seq := y.seq, id := y.id)) AS d, FROM j JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE s >= 0.55 AND x.neg = y.neg AND x.sal = y.sal AND y.seq < x.seq GROUP BY 1)"
_CON = "con AS (SELECT a AS id, min(struct_pack(seq := y.seq, id := y.id, kind := y.kind, weight := y.weight)) AS f FROM j JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE s >= 0.30 AND x.neg <> y.neg GROUP BY 1)"


@core.query("near_dupes", f"WITH {SNAP}, {_FACETS}, {_PAIRS}, {_DUP} SELECT id, d.id AS duplicate_of FROM dup")
def near_dupes(s: SparkSession, d: str) -> DataFrame:
    return Q.gate_duplicates(snap(s, d)).select("id", "duplicate_of")


@core.query("contradictions", f"WITH {SNAP}, {_FACETS}, {_PAIRS}, {_CON} SELECT id, f.id AS against, CASE WHEN f.kind = 'fact' AND f.weight >= 0.5 THEN 'strong' ELSE 'weak' END AS standing FROM con")
def contradictions(s: SparkSession, d: str) -> DataFrame:
    return Q.gate_contrary(snap(s, d))


_G4 = "g4 AS (SELECT n.id, CASE WHEN dup.id IS NOT NULL THEN 'reject' WHEN con.f.kind = 'fact' AND con.f.weight >= 0.5 THEN (CASE WHEN n.kind = 'refuted' AND len(coalesce(n.evidence, [])) > 0 THEN 'pass' ELSE 'reject' END) WHEN con.id IS NOT NULL THEN 'flag' ELSE 'pass' END AS verdict, coalesce(dup.d.id, con.f.id, '') AS other_id FROM n LEFT JOIN dup USING (id) LEFT JOIN con USING (id))"


@core.query("gate_consistency", f"WITH {SNAP}, {_FACETS}, {_PAIRS}, {_DUP}, {_CON}, {_G4} SELECT * FROM g4")
def gate_consistency(s: SparkSession, d: str) -> DataFrame:
    return Q.consistency_gate(snap(s, d))


@core.query(
    "write_gates",
    f"""WITH {SNAP}, {LINKS}, {_G3}, {_FACETS}, {_PAIRS}, {_DUP}, {_CON}, {_G4}, v AS (SELECT n.id, {_G1} AS a1, g3.verdict AS a3, g4.verdict AS a4, {_G2} AS a2 FROM n JOIN g3 USING (id) JOIN g4 USING (id))
SELECT id, CASE WHEN a1 <> 'pass' THEN 'g1' WHEN a3 <> 'pass' THEN 'g3' WHEN a4 <> 'pass' THEN 'g4' WHEN a2 <> 'pass' THEN 'g2' ELSE '' END AS gate, CASE WHEN a1 <> 'pass' THEN a1 WHEN a3 <> 'pass' THEN a3 WHEN a4 <> 'pass' THEN a4 ELSE a2 END AS verdict FROM v""",
)
def write_gates(s: SparkSession, d: str) -> DataFrame:
    return Q.write_gates(snap(s, d), NOW)
