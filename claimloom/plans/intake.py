"""Queries of the write path, of question and claim classes, and of what goes with search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import questions as T
from claimloom.operators import intake as I
from claimloom.operators import search as R
from claimloom.operators import sessions as L
from claimloom.operators import store as O
from claimloom.plans.logs import _MSG, messages
from claimloom.plans.quality import _G2, QSQL, queries_df
from claimloom.plans.registry import core
from claimloom.plans.search import _WSQL, ASKED, asked, edges
from claimloom.plans.sqlbits import EDGES, HITS, LOG, NOW, SNAP, any_of, first_sentence, nid, weight
from claimloom.plans.store import hits, log, snap

C = F.col
_NORM = "replace(lower(coalesce({0}, '')), 'ё', 'е')"


def _spaced(c: str, gap: str = " ") -> str:
    return f"('{gap}' || array_to_string(regexp_extract_all({_NORM.format(c)}, '{T.PIECES}'), '{gap}') || '{gap}')"


def _has(c: str, words: tuple[str, ...], end: str = "") -> str:
    return any_of(c, tuple(f" {w}{end}" for w in words))


def _cases(pairs: list[tuple[str, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {last} END"


_JOINS = " + ".join(f"(length(two) - length(replace(two, ' {w} ', ''))) / {len(w) + 2}" for w in (*T.AND, ",", ";"))


@core.query(
    "question_class",
    f"""WITH {LOG}, q AS (SELECT rec_id, query, {_spaced('query')} AS one, {_spaced('query', '  ')} AS two, len(regexp_extract_all({_NORM.format('query')}, '[\\p{{L}}\\p{{N}}_$%.-]+')) AS n_words FROM g WHERE trim(query) <> ''),
s AS (SELECT *, CAST({_has('one', T.COMPLEX, ' ')} AS INTEGER) + CAST({_JOINS} >= 2 AS INTEGER) + CASE WHEN n_words >= 14 THEN 2 WHEN n_words >= 8 THEN 1 ELSE 0 END - CAST({_has('one', T.SIMPLE, ' ')} AND n_words <= 8 AS INTEGER) - CAST(ends_with(trim(query), '?') AND n_words <= 3 AS INTEGER) AS score FROM q)
SELECT rec_id, CASE WHEN score <= 0 THEN 'simple' WHEN score <= 2 THEN 'medium' ELSE 'complex' END AS complexity, score, n_words, {_cases([(_has('one', w), f"'{r}'") for r, w in T.INTENTS], "''")} AS intent,
CASE WHEN score <= 0 THEN 5 WHEN score <= 2 THEN 10 ELSE 20 END AS top_k, CASE WHEN score <= 0 THEN 1200 WHEN score <= 2 THEN 2500 ELSE 5000 END AS tokens FROM s""",
)
def question_class(s: SparkSession, d: str) -> DataFrame:
    return log(s, d).where("trim(query) <> ''").select("rec_id", T.question_class(C("query")).alias("c")).select("rec_id", "c.*")


ONTOLOGY = [("storage", "archiv"), ("storage", "архив"), ("storage", "журнал"), ("storage", "index"), ("machine", "valve"), ("machine", "motor"), ("machine", "котёл"), ("place", "garden"), ("place", "маяк")]


@core.query("entity_marks", f"WITH {SNAP}, o AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{m.replace('ё', 'е')}')" for e, m in ONTOLOGY)}) t(entity, marker)) SELECT DISTINCT id, entity FROM n JOIN o ON contains({_NORM.format('claim')}, marker)")
def entity_marks(s: SparkSession, d: str) -> DataFrame:
    o = s.createDataFrame([(e, m.replace("ё", "е")) for e, m in ONTOLOGY], "entity string, marker string")
    return T.entities_of(snap(s, d), o, "id", "claim")


_RTEXT = "(coalesce(claim, '') || ' ' || coalesce(context, '')[1:300])"


def _router_score(router: str) -> str:
    return " + ".join(["0.0", *(f"CASE WHEN {_has('one', words)} THEN {w} ELSE 0 END" for r, w, words in T.ROUTER_SIGNS if r == router)])


_ROUTED = f"""rt AS (SELECT id, kind, tags, {_spaced(_RTEXT)} AS one, {_NORM.format(_RTEXT)} AS low FROM n),
r0 AS (SELECT *, {_router_score('sys_cmd')} + CASE WHEN starts_with(one, ' правило ') OR starts_with(one, ' приказ ') THEN 3 ELSE 0 END + CASE WHEN contains(one, ' приказ памяти') OR contains(one, ' правило памяти') OR regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(приказ|правило) +[0-9]') THEN 2 ELSE 0 END + CASE WHEN kind = 'rule' THEN 1.5 ELSE 0 END AS s,
 {_router_score('persona_def')} AS p, {_router_score('world_state')} + CASE WHEN regexp_matches(low, '{T.MEASURE}') THEN 1.5 ELSE 0 END AS w0 FROM rt),
r1 AS (SELECT *, CASE WHEN kind <> 'rule' AND w0 = 0 THEN 0.5 ELSE w0 END AS w FROM r0),
routed AS (SELECT id, coalesce(lower(list_filter(tags, lambda t: lower(t) IN ('sys_cmd', 'persona_def', 'world_state'))[1]), CASE WHEN greatest(s, p, w) <= 0 THEN 'world_state' WHEN s = greatest(s, p, w) THEN 'sys_cmd' WHEN p = greatest(s, p, w) THEN 'persona_def' ELSE 'world_state' END) AS router,
 CASE WHEN greatest(s, p, w) <= 0 THEN 0 ELSE round(greatest(s, p, w) - (s + p + w - greatest(s, p, w) - least(s, p, w)), 2) END::DOUBLE AS margin, len(list_filter(coalesce(tags, []), lambda t: coalesce(lower(t) NOT IN ('sys_cmd', 'persona_def', 'world_state'), true))) + 1 AS n_tags FROM r1)"""


@core.query("router_tags", f"WITH {SNAP}, {_ROUTED} SELECT id, router, margin, n_tags FROM routed")
def router_tags(s: SparkSession, d: str) -> DataFrame:
    tags = T.router_tags(C("tags"), C("claim"), C("context"), C("kind"))
    return snap(s, d).select("id", F.element_at(tags, -1).alias("router"), T.router_class(C("claim"), C("context"), C("kind"))["margin"].alias("margin"), F.size(tags).alias("n_tags"))


@core.query(
    "source_hashes",
    f"WITH {SNAP} SELECT id, sha1(array_to_string(list_concat([coalesce(claim, ''), coalesce(context, ''), coalesce(source, '')], list_transform(coalesce(evidence, []), lambda e: coalesce(e, ''))), chr(31)))[1:12] AS src, sha256(coalesce(claim, '')) AS claim_sha256 FROM n",
)
def source_hashes(s: SparkSession, d: str) -> DataFrame:
    """TX-19, TX-28."""
    return snap(s, d).select("id", T.source_hash(C("claim"), C("context"), C("source"), C("evidence")).alias("src"), F.sha2(F.coalesce("claim", F.lit("")), 256).alias("claim_sha256"))


@core.query("first_sentences", f"WITH {SNAP} SELECT id, {first_sentence('claim', 160)} AS sentence FROM n")
def first_sentences(s: SparkSession, d: str) -> DataFrame:
    return snap(s, d).select("id", T.first_sentence(C("claim")).alias("sentence"))


_INTAKE = f"""{_ROUTED}, wg AS (SELECT * FROM ({core.sql['write_gates']})), gc AS (SELECT id, other_id FROM ({core.sql['gate_consistency']})), tg AS (SELECT id, score FROM ({core.sql['truth_gate']})),
dec AS (SELECT n.id, CASE WHEN n.kind = 'hub' THEN 'refused' WHEN verdict = 'reject' THEN 'rejected' ELSE 'added' END AS outcome, gate, CASE WHEN verdict = 'flag' AND n.kind = 'fact' THEN 'hypothesis' ELSE n.kind END AS kind,
 round(coalesce(confidence, greatest(0.05, least(1.0, score / 6.0))), 6)::DOUBLE AS confidence, router, CASE WHEN n.kind <> 'hub' AND verdict = 'reject' AND gate = 'g4' THEN other_id ELSE '' END AS reinforces
 FROM n JOIN wg USING (id) JOIN gc USING (id) JOIN tg USING (id) JOIN routed USING (id))"""


@core.query("intake", f"WITH {SNAP}, {_INTAKE} SELECT * FROM dec")
def intake(s: SparkSession, d: str) -> DataFrame:
    return I.intake(snap(s, d), NOW)


@core.query("reinforced", f"WITH {SNAP}, {_INTAKE} SELECT n.id, x.c AS n, round(least(1.0, {weight(1.0)} + 0.05 * x.c), 6)::DOUBLE AS weight FROM n JOIN (SELECT reinforces AS id, count(*) AS c FROM dec WHERE reinforces <> '' GROUP BY 1) x USING (id)")
def reinforced(s: SparkSession, d: str) -> DataFrame:
    return I.reinforced(I.intake(snap(s, d), NOW), snap(s, d))


@core.query("verified_weights", f"WITH {SNAP}, tg AS (SELECT id, score, verdict FROM ({core.sql['truth_gate']})) SELECT id, score, verdict, round(least(1.0, {weight(1.0)} + CASE WHEN verdict = 'pass' THEN greatest(0.0, 0.02 * (score - 4)) ELSE 0 END), 6)::DOUBLE AS weight FROM n JOIN tg USING (id)")
def verified_weights(s: SparkSession, d: str) -> DataFrame:
    return I.verified_weights(snap(s, d), NOW)


_DEPTHS = f"""u AS (SELECT id, {nid('parent')} AS p FROM n WHERE {nid('parent')} IN (SELECT id FROM n)),
a(id, node, depth, seen) AS (SELECT id, id, 0, [id] FROM n UNION ALL SELECT a.id, u.p, depth + 1, list_append(seen, u.p) FROM a JOIN u ON u.id = a.node WHERE NOT list_contains(seen, u.p)),
dep AS (SELECT n.id, coalesce(x.depth, -1) AS depth, coalesce(x.node, '') AS top_id FROM n LEFT JOIN (SELECT id, depth, node FROM a WHERE node NOT IN (SELECT id FROM u)) x USING (id))"""


@core.query("ancestors", f"WITH RECURSIVE {SNAP}, {_DEPTHS} SELECT * FROM dep")
def ancestors(s: SparkSession, d: str) -> DataFrame:
    return I.depths(snap(s, d))


@core.query(
    "child_inserts",
    f"WITH RECURSIVE {SNAP}, {_DEPTHS} SELECT n.id, CASE WHEN dep.depth IS NULL THEN 'missing' WHEN {nid('n.parent')} = n.id OR dep.depth < 0 THEN 'cycle' WHEN dep.depth + 1 > 5 THEN 'deep' ELSE 'ok' END AS verdict FROM n LEFT JOIN dep ON dep.id = {nid('n.parent')} WHERE {nid('n.parent')} IS NOT NULL",
)
def child_inserts(s: SparkSession, d: str) -> DataFrame:
    return I.child_inserts(snap(s, d))


@core.query("tags_contained", f"WITH {SNAP} SELECT id FROM n WHERE list_has_all(coalesce(tags, []), ['sys_cmd'])")
def tags_contained(s: SparkSession, d: str) -> DataFrame:
    return I.with_tags(snap(s, d), F.array(F.lit("sys_cmd"))).select("id")


@core.query("read_gates", f"WITH {SNAP}, rg AS (SELECT * FROM ({core.sql['gate_relevance']})), fr AS (SELECT id, {_G2} AS v FROM n) SELECT qid, id, score FROM rg JOIN fr USING (id) WHERE v <> 'reject' AND verdict <> 'reject'")
def read_gates(s: SparkSession, d: str) -> DataFrame:
    return I.read_gates(snap(s, d), queries_df(s), NOW)


@core.query(
    "result_conflicts",
    f"""WITH {SNAP}, {EDGES}, res AS (SELECT qid, id FROM ({core.sql['budget_score']})), b AS (SELECT src AS id, dst AS other FROM e WHERE rel = 'conflicts_with' UNION ALL SELECT dst, src FROM e WHERE rel = 'conflicts_with')
SELECT qid, id, other, count(*) AS n_edges FROM res JOIN b USING (id) WHERE other IN (SELECT id FROM n) GROUP BY ALL""",
)
def result_conflicts(s: SparkSession, d: str) -> DataFrame:
    return I.result_conflicts(R.ranked(R.budget_score(snap(s, d), asked(s, d), NOW), 10), edges(s, d), snap(s, d))


@core.query(
    "query_hubs",
    f"WITH {SNAP}, {ASKED}, hb AS (SELECT id AS hub_id, t[8:] AS entity FROM (SELECT id, unnest(tags) AS t FROM n WHERE kind = 'hub') WHERE starts_with(t, 'entity:') AND length(t) > 7) SELECT DISTINCT qid, hub_id, entity FROM q, hb WHERE contains({_NORM.format('q')}, entity)",
)
def query_hubs(s: SparkSession, d: str) -> DataFrame:
    return I.query_hubs(asked(s, d), snap(s, d))


SEARCHES = [(1, "valve"), (2, "журнал склад"), (3, "scheduler valve audited batch"), (4, "zzzz"), (5, "kept open"), (6, "night index report")]
_SSQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SEARCHES) + ") t(qid, q))"


@core.query(
    "memory_search",
    f"""WITH {_SSQL}, a AS (SELECT qid, id, score, rank FROM ({core.sql['search_substring'].replace(_WSQL, _SSQL)})), b AS (SELECT qid, id, score, rank FROM ({core.sql['budget_score'].replace(ASKED, _SSQL)}) WHERE rank <= 5)
SELECT *, 'substring' AS mode FROM a UNION ALL SELECT *, 'token_fallback' FROM b WHERE qid IN (SELECT qid FROM q WHERE len(regexp_extract_all(q, '\\S+')) >= 2) AND qid NOT IN (SELECT qid FROM a)""",
)
def memory_search(s: SparkSession, d: str) -> DataFrame:
    """SR-13 for a small stated set of searches."""
    q, n = s.createDataFrame(SEARCHES, "qid int, q string"), snap(s, d)
    return I.with_fallback(R.search_substring(n, q, NOW), R.ranked(R.budget_score(n, q, NOW), 5), q)


@core.query(
    "related_hubs",
    f"""WITH {SNAP}, {EDGES}, hb AS (SELECT id FROM n WHERE kind = 'hub'), x AS (SELECT DISTINCT src, dst, rel FROM e WHERE src IN (SELECT id FROM hb) AND dst IN (SELECT id FROM n)),
p AS (SELECT src AS a, dst AS b FROM x WHERE dst IN (SELECT id FROM hb) AND src <> dst UNION SELECT dst, src FROM x WHERE dst IN (SELECT id FROM hb) AND src <> dst)
SELECT id AS hub_id, (SELECT count(DISTINCT dst) FROM x WHERE x.src = hb.id AND rel = 'has_part') AS n_members, (SELECT count(*) FROM p WHERE p.a = hb.id) AS n_related FROM hb""",
)
def related_hubs(s: SparkSession, d: str) -> DataFrame:
    return I.related_hubs(edges(s, d), snap(s, d))


@core.query("last_hits", f"WITH {LOG}, {HITS} SELECT id, round(tm, 3)::DOUBLE AS at, row_number() OVER (PARTITION BY id ORDER BY tm DESC) AS rank FROM (SELECT DISTINCT id, tm FROM h) QUALIFY rank <= 20")
def last_hits(s: SparkSession, d: str) -> DataFrame:
    return O.last_hits(hits(s, d).select("id", "at").distinct()).select("id", F.round("at", 3).alias("at"), "rank")


@core.query(
    "compact_savings",
    f"""WITH {_MSG}, t AS (SELECT m.session_id, pos, n, CAST(ceil(length(g.query) / 4.0) AS BIGINT) AS t FROM m JOIN g USING (rec_id)), x AS (SELECT session_id, sum(t) AS before, coalesce(sum(t) FILTER (pos > n - 8), 0) AS recent, count(*) FILTER (pos <= n - 8) AS gone FROM t GROUP BY 1),
y AS (SELECT session_id, CAST(before AS BIGINT) AS before, CAST(recent + 40 * ceil(gone / 3) AS BIGINT) AS after FROM x) SELECT session_id, before, after, round(1 - after / before, 4)::DOUBLE AS saved_ratio FROM y""",
)
def compact_savings(s: SparkSession, d: str) -> DataFrame:
    m = messages(s, d)
    placed = L.positions(m, "session_id", C("t"), "rec_id")
    return I.savings(m, placed.where("pos > n - 8").select("session_id", "rec_id"), "session_id", "query")


@core.query(
    "link_passports",
    f"""WITH {EDGES}, f AS (SELECT src, dst, arg_min(struct_pack(a := author, r := rel), edge_id) AS x FROM e GROUP BY ALL)
SELECT src, len(list(dst)) AS n_links, string_agg(dst || '=' || '{{"author":' || to_json(x.a) || ',"rel":' || to_json(x.r) || '}}', ' ' ORDER BY dst) AS meta FROM f GROUP BY 1""",
)
def link_passports(s: SparkSession, d: str) -> DataFrame:
    m = I.link_passports(edges(s, d))
    lines = F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("src", F.size("meta").alias("n_links"), F.array_join(F.array_sort(lines), " ").alias("meta"))


_CARD = "trim(regexp_replace(coalesce(claim, ''), '\\s+', ' ', 'g'))"


@core.query("result_cards", f"WITH {SNAP}, res AS (SELECT qid, id, rank FROM ({core.sql['budget_score']})) SELECT qid, rank, id || ' | ' || CASE WHEN length({_CARD}) > 80 THEN ({_CARD})[1:80] || '…' ELSE {_CARD} END || ' [' || rank || ']' AS card FROM res JOIN n USING (id)")
def result_cards(s: SparkSession, d: str) -> DataFrame:
    top = R.ranked(R.budget_score(snap(s, d), asked(s, d), NOW), 10).select("qid", "id", "rank")
    return top.join(snap(s, d).select("id", "claim"), "id").select("qid", "rank", T.card(C("id"), C("claim"), C("rank")).alias("card"))
