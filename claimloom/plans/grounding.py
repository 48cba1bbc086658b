"""Grounding queries (GN-*, AG-12..14, 20, 21, EV-*, JN-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import questions as T
from claimloom.operators import grounding as G
from claimloom.operators.search import node_text
from claimloom.plans.registry import core
from claimloom.plans.search import _IDF, _NT, _POST, _SCORE, ASKED, _scored, asked
from claimloom.plans.sqlbits import ACTIVE, LOG, NOW, SNAP, decayed, first_sentence, iso, tokens, weight
from claimloom.plans.store import log, seconds, snap
from claimloom.runtime import table

C = F.col


def answers(s: SparkSession, d: str) -> DataFrame:
    """The held-out items are the answers to verify."""
    return table(s, d, "benchmark").select(C("item_id").alias("answer_id"), "text")


def _split(src: str) -> str:
    trim = "[ \\t\\r\\n\\-—:;.!…]+"
    return f"""pc AS (SELECT answer_id, i, trim(regexp_replace(regexp_replace(raw, '[*`~]+', ' ', 'g'), '^\\s*(?:[-•—]|[0-9]+[.)])\\s+', '')) AS c FROM (SELECT answer_id, ps[i] AS raw, i FROM (SELECT answer_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT answer_id, string_split(regexp_replace(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\s*;\\s+|[\\r\\n]+', chr(10), 'g'), chr(10)) AS ps FROM {src})))),
cl AS (SELECT answer_id, i, regexp_replace(c, '^{trim}|{trim}$', '', 'g') AS claim FROM pc WHERE NOT suffix(c, '?')),
cu AS (SELECT * FROM cl WHERE len({tokens('claim')}) >= 2 QUALIFY row_number() OVER (PARTITION BY answer_id, replace(lower(claim), 'ё', 'е') ORDER BY i) = 1),
claims AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i) AS pos, claim FROM cu QUALIFY pos <= 24)"""


_ANS = "a AS (SELECT item_id AS answer_id, text FROM benchmark)"
_CLAIMS = f"{_ANS}, {_split('a')}"


@core.query("split_claims", f"WITH {_CLAIMS} SELECT answer_id, pos, claim FROM claims")
def split_claims(s: SparkSession, d: str) -> DataFrame:
    return G.split_claims(answers(s, d))


def _num(x: str) -> str:
    n = "list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:[.,:][0-9]+)*'), lambda v: CASE WHEN contains(replace(v, ',', '.'), '.') AND NOT contains(v, ':') THEN coalesce(nullif(regexp_replace(regexp_replace(replace(v, ',', '.'), '0+$', ''), '\\.+$', ''), ''), '0') ELSE replace(v, ',', '.') END)"
    return n.format(x)


def _near(words: str, key: str) -> str:
    """Rows of number and neighbour; a row without neighbour ('') keeps the number."""
    stem = lambda w: f"coalesce(({tokens(w, 2)})[1], '')"
    at = f"SELECT {key}, w[i] AS me, coalesce(w[i - 1], '') AS le, coalesce(w[i + 1], '') AS ri FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM {words}) WHERE regexp_matches(w[i], '[0-9]')"
    st = f"SELECT {key}, me, {stem('me')} AS sm, {stem('le')} AS sl, {stem('ri')} AS sr FROM ({at})"
    ctx = "['', CASE WHEN sm <> '' THEN '=' || sm ELSE '' END, CASE WHEN sl <> '' THEN '<' || sl ELSE '' END, CASE WHEN sr <> '' THEN '>' || sr ELSE '' END]"
    return f"SELECT {key}, num, unnest(cs) AS ctx FROM (SELECT {key}, unnest({_num('me')}) AS num, {ctx} AS cs FROM ({st}))"


_SUP = f"""{_POST}, {_IDF}, ct AS (SELECT answer_id, pos, token, idf FROM (SELECT DISTINCT answer_id, pos, unnest({tokens('claim')}) AS token FROM claims) LEFT JOIN idf USING (token)),
ms AS (SELECT answer_id, pos, sum(coalesce(idf, (SELECT max(idf) FROM idf))) AS mass FROM ct GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY answer_id, pos ORDER BY idf DESC, token) <= 8 AS seeks FROM ct WHERE idf IS NOT NULL),
ht AS (SELECT answer_id, pos, id, sum(idf) AS got, bool_or(seeks) AS seeks FROM rr JOIN post USING (token) GROUP BY ALL),
sp AS (SELECT answer_id, pos, id, seq, round(got / mass, 6) AS coverage, kind NOT IN ('refuted', 'outdated') AS live FROM ht JOIN ms USING (answer_id, pos) JOIN n USING (id) WHERE seeks),
b0 AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY answer_id, pos, live ORDER BY coverage DESC, seq) = 1),
cw AS (SELECT answer_id, pos, regexp_extract_all(claim, '\\S+') AS w FROM claims), cn AS (SELECT DISTINCT answer_id, pos, num, ctx FROM ({_near('cw', 'answer_id, pos')})),
nw AS (SELECT id, regexp_extract_all({_NT}, '\\S+') AS w FROM n WHERE id IN (SELECT id FROM b0)), nn AS (SELECT DISTINCT id, num, ctx FROM ({_near('nw', 'id')})),
lk AS (SELECT b0.answer_id, b0.pos, b0.id, c.num FROM b0 JOIN (SELECT DISTINCT answer_id, pos, num FROM cn) c USING (answer_id, pos) WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.id = b0.id AND nn.num = c.num)
 OR (EXISTS (SELECT 1 FROM cn x WHERE x.answer_id = b0.answer_id AND x.pos = b0.pos AND x.num = c.num AND x.ctx <> '') AND EXISTS (SELECT 1 FROM nn WHERE nn.id = b0.id AND nn.num = c.num AND nn.ctx <> '')
  AND NOT EXISTS (SELECT 1 FROM cn x JOIN nn y ON x.num = y.num AND x.ctx = y.ctx WHERE x.answer_id = b0.answer_id AND x.pos = b0.pos AND x.num = c.num AND y.id = b0.id AND x.ctx <> ''))),
best AS (SELECT b0.*, (SELECT count(*) FROM lk WHERE lk.answer_id = b0.answer_id AND lk.pos = b0.pos AND lk.id = b0.id) AS missing FROM b0),
vj AS (SELECT c.answer_id, c.pos, l.coverage AS lc, l.id AS li, l.missing AS lm, s.coverage AS sc, s.id AS si, s.missing AS sm FROM claims c LEFT JOIN best l ON l.answer_id = c.answer_id AND l.pos = c.pos AND l.live LEFT JOIN best s ON s.answer_id = c.answer_id AND s.pos = c.pos AND NOT s.live),
vd AS (SELECT answer_id, pos, CASE WHEN sc >= 0.6 AND sc >= coalesce(lc, 0) THEN 'refuted' WHEN coalesce(lc, sc) >= 0.6 AND coalesce(lm, sm) = 0 THEN 'supported' WHEN coalesce(lc, sc) >= 0.3 THEN 'partial' ELSE 'unsupported' END AS verdict,
 coalesce(CASE WHEN sc >= 0.6 AND sc >= coalesce(lc, 0) THEN sc ELSE coalesce(lc, sc) END, 0)::DOUBLE AS coverage, coalesce(CASE WHEN sc >= 0.6 AND sc >= coalesce(lc, 0) THEN si ELSE coalesce(li, si) END, '') AS support_id FROM vj)"""


@core.query("verify_claim", f"WITH {SNAP}, {_CLAIMS}, {_SUP} SELECT * FROM vd")
def verify_claim(s: SparkSession, d: str) -> DataFrame:
    return G.verify_claims(snap(s, d), G.split_claims(answers(s, d)))


_AGG = """ag AS (SELECT a.answer_id, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'refuted') AS refuted, count(verdict) AS total FROM (SELECT DISTINCT answer_id FROM a) a LEFT JOIN vd USING (answer_id) GROUP BY 1),
ar AS (SELECT *, coalesce((supported + 0.5 * partial) / nullif(total, 0), 0)::DOUBLE AS r FROM ag),
av AS (SELECT answer_id, supported, partial, unsupported, refuted, total, round(r, 6) AS ratio, CASE WHEN total = 0 OR supported = 0 THEN 'ungrounded' WHEN refuted > 0 THEN (CASE WHEN r < 0.8 THEN 'ungrounded' ELSE 'partial' END) WHEN r >= 0.8 AND unsupported = 0 THEN 'grounded' WHEN r >= 0.4 THEN 'partial' ELSE 'ungrounded' END AS verdict FROM ar)"""


@core.query("ground_verdict", f"WITH {SNAP}, {_CLAIMS}, {_SUP}, {_AGG} SELECT * FROM av")
def ground_verdict(s: SparkSession, d: str) -> DataFrame:
    a = answers(s, d)
    return G.answer_verdicts(a, G.verify_claims(snap(s, d), G.split_claims(a)))


@core.query("source_nodes", f"WITH {SNAP}, {_CLAIMS}, {_SUP}, k AS (SELECT * FROM sp WHERE live QUALIFY row_number() OVER (PARTITION BY answer_id, pos ORDER BY coverage DESC, seq) <= 3) SELECT answer_id, id, max(coverage) AS coverage FROM k WHERE coverage >= 0.3 GROUP BY ALL")
def source_nodes(s: SparkSession, d: str) -> DataFrame:
    """The part of source_nodes_all that its SQL states: live nodes only."""
    return G.live_source_nodes(snap(s, d), G.split_claims(answers(s, d)))


@core.query("source_nodes_all")
def source_nodes_all(s: SparkSession, d: str) -> DataFrame:
    """AG-13 whole: also stale nodes, where a claim rests on them."""
    return G.source_nodes(snap(s, d), G.split_claims(answers(s, d)))


@core.query("eval_sweep", f"WITH {SNAP}, {_CLAIMS}, {_SUP}, t AS (SELECT unnest([50, 55, 60, 65, 70, 75, 80]) AS th) SELECT CAST(th AS INTEGER) AS threshold_pct, count(*) FILTER (coverage >= th / 100.0) AS fired, count(*) FILTER (coverage >= th / 100.0 AND verdict = 'supported') AS correct FROM vd, t GROUP BY 1")
def eval_sweep(s: SparkSession, d: str) -> DataFrame:
    """AG-20: claims that fire at each coverage threshold, and those that are supported."""
    v = G.verify_claims(snap(s, d), G.split_claims(answers(s, d)))
    th = F.explode(F.array(*[F.lit(x) for x in (50, 55, 60, 65, 70, 75, 80)]))
    fired = C("coverage") >= C("threshold_pct") / 100.0
    return v.withColumn("threshold_pct", th).groupBy("threshold_pct").agg(F.count_if(fired).alias("fired"), F.count_if(fired & (C("verdict") == "supported")).alias("correct"))


INVENTION = "The copper lighthouse dances with nineteen velvet umbrellas."
FORMS = ("quote", "numbers swapped", "quote and invention", "invention")
_FORMS = f"""o AS (SELECT seq, {first_sentence('claim', 220)} AS text FROM n WHERE kind = 'fact'),
a AS (SELECT seq * 4 AS answer_id, text FROM o UNION ALL SELECT seq * 4 + 1, translate(text, '0123456789', '1234567890') FROM o UNION ALL SELECT seq * 4 + 2, text || ' {INVENTION}' FROM o UNION ALL SELECT seq * 4 + 3, '{INVENTION}' FROM o), {_split('a')}"""
# Every node that shares a known token with a claim is a candidate, not only those of its eight rarest.
_SUP_ALL = _SUP.replace("row_number() OVER (PARTITION BY answer_id, pos ORDER BY idf DESC, token) <= 8 AS seeks", "true AS seeks")


@core.query("eval_confusion", f"WITH {SNAP}, {_FORMS}, {_SUP_ALL}, {_AGG} SELECT {list(FORMS)}[answer_id % 4 + 1] AS form, verdict, count(*) AS n FROM av GROUP BY ALL")
def eval_confusion(s: SparkSession, d: str) -> DataFrame:
    """AG-21, EV-1, EV-3, EV-4: verdicts of quoted first sentences, of the same with every digit raised by one, with an invention behind, and of the invention alone."""
    n = G.arrived_first(table(s, d, "nodes"))
    quotes = n.where("kind = 'fact'").select("seq", T.first_sentence(C("claim"), 220).alias("text"), node_text().alias("whole"))
    answers = [C("text"), F.translate("text", "0123456789", "1234567890"), F.concat("text", F.lit(f" {INVENTION}")), None]
    v = G.quote_verdicts(n, quotes, answers, INVENTION)
    return v.select(F.element_at(F.array(*map(F.lit, FORMS)), C("form") + 1).alias("form"), "verdict", "n")


_LOGGED = f"{LOG}, a AS (SELECT rec_id AS answer_id, query AS text FROM g WHERE event = 'ground' AND rec_id % 50 = 0), {_split('a')}"
_PRE = """px AS (SELECT rec_id, event, session_id, epoch(ts) AS t, coalesce(len(node_ids), 0) AS c FROM g WHERE session_id IS NOT NULL),
pp AS (SELECT DISTINCT x.rec_id FROM px x JOIN px y ON x.session_id = y.session_id AND y.event = 'prepare' AND y.c > 0 AND y.t < x.t AND x.t - y.t <= 3600 WHERE x.event = 'ground')"""


@core.query("ground_with_prepass", f"WITH {SNAP}, {_LOGGED}, {_SUP}, {_AGG}, {_PRE} SELECT answer_id, supported, partial, unsupported, refuted, total, ratio, verdict AS claims_verdict, answer_id IN (SELECT rec_id FROM pp) AS pre_pass, CASE WHEN answer_id IN (SELECT rec_id FROM pp) THEN verdict ELSE 'ungrounded' END AS verdict FROM av")
def ground_with_prepass(s: SparkSession, d: str) -> DataFrame:
    """GN-2: logged texts whose record id is divisible by 50, and the pre-pass of their sessions."""
    g = log(s, d)
    a = g.where("event = 'ground' and rec_id % 50 = 0").select(C("rec_id").alias("answer_id"), C("query").alias("text"))
    pre = G.prepass_asof(g, seconds("ts")).withColumnRenamed("rec_id", "answer_id")
    return G.with_prepass(G.answer_verdicts(a, G.verify_claims(snap(s, d), G.split_claims(a))), pre)


@core.query(
    "graph_first",
    f"""WITH {SNAP}, {ASKED}, {_SCORE}, t AS (SELECT qid, token, idf.idf FROM (SELECT DISTINCT qid, unnest({tokens('q')}) AS token FROM q) LEFT JOIN idf USING (token)), m2 AS (SELECT qid, sum(coalesce(idf, (SELECT max(idf) FROM idf))) AS mass FROM t GROUP BY 1),
g2 AS (SELECT qid, id, sum(t.idf) AS got FROM t JOIN post USING (token) WHERE t.idf IS NOT NULL GROUP BY ALL), cv AS (SELECT qid, id, rank, round(g2.got / m2.mass, 6) AS cov FROM top JOIN g2 USING (qid, id) JOIN m2 USING (qid) WHERE rank <= 10),
ld AS (SELECT *, row_number() OVER w AS r, coalesce(lead(cov) OVER w, 0) AS second FROM cv WINDOW w AS (PARTITION BY qid ORDER BY cov DESC, rank))
SELECT qid, id AS node_id, cov AS coverage, cov >= 0.65 AND round({decayed(weight(0.05), iso('last_used'))}, 6) >= 0.5 AND CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END >= 0.5 AND kind IN ('fact', 'rule') AND {ACTIVE} AND (second <= 0 OR cov >= round(second * 1.15, 6)) AS hit FROM ld JOIN n USING (id) WHERE r = 1""",
)
def graph_first(s: SparkSession, d: str) -> DataFrame:
    return G.graph_first(snap(s, d), _scored(s, d), asked(s, d), NOW)


@core.query(
    "prepass_asof",
    f"""WITH {LOG}, x AS (SELECT rec_id, event, session_id, epoch(ts) AS t, coalesce(len(node_ids), 0) AS c FROM g WHERE session_id IS NOT NULL), j AS (SELECT a.rec_id, arg_max(b.rec_id, struct_pack(t := b.t, r := b.rec_id)) AS p FROM x a JOIN x b ON a.session_id = b.session_id AND b.event = 'prepare' AND b.c > 0 AND b.t < a.t AND a.t - b.t <= 3600 WHERE a.event = 'ground' GROUP BY 1)
SELECT rec_id, coalesce(p, -1) AS prepass_id FROM x LEFT JOIN j USING (rec_id) WHERE event = 'ground'""",
)
def prepass_asof(s: SparkSession, d: str) -> DataFrame:
    return G.prepass_asof(log(s, d), seconds("ts"))


@core.query("ground_log_stats", f"WITH {LOG}, k AS (SELECT * FROM g ORDER BY rec_id DESC LIMIT 1000) SELECT event, coalesce(verdict, '') AS verdict, count(*) AS n, count(*) FILTER (len(node_ids) > 0) AS with_nodes, coalesce(sum(counts.supported), 0)::BIGINT AS supported FROM k GROUP BY ALL")
def ground_log_stats(s: SparkSession, d: str) -> DataFrame:
    """AG-14: statistics of the last thousand records, the limit being part of the report."""
    k = log(s, d).orderBy(C("rec_id").desc()).limit(1000)
    return k.groupBy("event", F.coalesce("verdict", F.lit("")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("node_ids") > 0).alias("with_nodes"), F.coalesce(F.sum("counts.supported"), F.lit(0)).alias("supported"))
