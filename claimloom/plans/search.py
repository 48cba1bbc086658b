"""Search queries (SR-*, AG-8..10, WN-4, WN-5, TX-2, TX-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import search as R
from claimloom.plans.quality import QSQL, queries_df
from claimloom.plans.registry import core
from claimloom.plans.sqlbits import ACTIVE, EDGES, LOG, NOW, SNAP, decayed, iso, tokens, weight
from claimloom.plans.store import log, snap
from claimloom.runtime import norm_id, table

C = F.col
REF = iso("last_used")
_CONF = "greatest(0.0, least(1.0, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END))"
_BOOST = f"({_CONF} * ({decayed(weight(0.05), REF)}))"
WORDS = [(1, "valve"), (2, "scheduler"), (3, "журнал"), (4, "report"), (5, "kept"), (6, "open at the")]
_WSQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in WORDS) + ") t(qid, q))"
ASKED = f"{LOG}, q AS (SELECT rec_id AS qid, query AS q FROM g WHERE rec_id % 50 = 0 AND trim(query) <> '')"


def words_df(s: SparkSession) -> DataFrame:
    return s.createDataFrame(WORDS, "qid int, q string")


def asked(s: SparkSession, d: str) -> DataFrame:
    """Queries of the ground log whose record id is divisible by 50."""
    return log(s, d).where("rec_id % 50 = 0 and trim(query) <> ''").select(C("rec_id").alias("qid"), C("query").alias("q"))


def edges(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "edges").select("edge_id", norm_id(C("src")).alias("src"), norm_id(C("dst")).alias("dst"), F.coalesce("rel", F.lit("related_to")).alias("rel"), F.coalesce("author", F.lit("unknown")).alias("author"))
    return e.where("src is not null and dst is not null").distinct()


@core.query(
    "search_substring",
    f"""WITH {SNAP}, {_WSQL}, r AS (SELECT id, seq, coalesce(ts, '') AS ts, {_BOOST} AS boost, lower(coalesce(claim, '')) AS lc, lower(coalesce(source, '')) AS ls, lower(coalesce(context, '')) AS lx, list_transform(coalesce(evidence, []), lambda e: lower(e)) AS ev FROM n WHERE {ACTIVE} AND kind <> 'hub'),
x AS (SELECT qid, id, seq, ts, boost, trim(lc) = q AS exact, 3 * CAST(contains(lc, q) AS INTEGER) + 2 * CAST(contains(ls, q) AS INTEGER) + CAST(contains(lx, q) AS INTEGER) + len(list_filter(ev, lambda e: contains(e, q))) AS f, (length(lc) - length(replace(lc, q, ''))) / length(q) AS tf FROM r, q),
s AS (SELECT *, max(exact) OVER (PARTITION BY qid) AS any_exact, round(f + CASE WHEN tf > 1 THEN least(1.0, 0.5 * ln(tf)) ELSE 0 END + 2 * boost + 1.0, 6)::DOUBLE AS s0 FROM x WHERE f > 0),
k AS (SELECT qid, id, CASE WHEN any_exact THEN 0.0 ELSE s0 END AS score, seq, ts FROM s WHERE exact = any_exact)
SELECT qid, id, score::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ts DESC, seq) AS rank FROM k QUALIFY rank <= 5""",
)
def search_substring(s: SparkSession, d: str) -> DataFrame:
    return R.search_substring(snap(s, d), words_df(s), NOW)


@core.query(
    "search_exact",
    f"WITH {SNAP}, r AS (SELECT id, seq, coalesce(ts, '') AS ts, lower(trim(claim)) AS key FROM n WHERE {ACTIVE}), q AS (SELECT seq AS qid, lower(trim(claim)) AS key FROM n WHERE seq % 50 = 0 AND trim(claim) <> '') SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, seq) AS rank FROM q JOIN r USING (key) QUALIFY rank <= 5",
)
def search_exact(s: SparkSession, d: str) -> DataFrame:
    n = snap(s, d)
    return R.search_exact(n, n.where("seq % 50 = 0").select(C("seq").alias("qid"), C("claim").alias("q")), NOW)


_NT = "coalesce(claim, '') || chr(10) || coalesce(context, '') || chr(10) || coalesce(source, '') || chr(10) || coalesce(array_to_string(evidence, chr(10)), '')"
_POST = f"post AS (SELECT DISTINCT id, unnest({tokens(_NT)}) AS token FROM n WHERE kind <> 'hub')"
_IDF = "idf AS (SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM n WHERE kind <> 'hub') / count(*)), 6) AS idf FROM post GROUP BY 1)"


@core.query("idf_budget", f"WITH {SNAP}, {_POST}, {_IDF} SELECT * FROM idf")
def idf_budget(s: SparkSession, d: str) -> DataFrame:
    return R.budget_idf(snap(s, d))


@core.query("tokens_budget", f"WITH {SNAP}, t AS (SELECT id, unnest({tokens('claim')}) AS token FROM n) SELECT id, token, count(*) AS tf FROM t GROUP BY ALL")
def tokens_budget(s: SparkSession, d: str) -> DataFrame:
    return snap(s, d).select("id", F.explode(S.budget_tokens(C("claim"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


_SCORE = f"""{_POST}, {_IDF}, qt AS (SELECT qid, token, coalesce(idf, 1.0) AS idf FROM (SELECT DISTINCT qid, unnest({tokens('q')}) AS token FROM q) LEFT JOIN idf USING (token)),
mass AS (SELECT qid, sum(idf) AS mass FROM qt GROUP BY 1), got AS (SELECT qid, id, sum(idf) AS got FROM qt JOIN post USING (token) GROUP BY ALL),
sc AS (SELECT qid, id, seq, coalesce(ts, '') AS ts, {_BOOST} AS boost, round(got / mass, 6) AS share, 3 * CAST(contains(lower(coalesce(claim, '')), lower(trim(q))) AS INTEGER) + 2 * CAST(contains(lower(coalesce(source, '')), lower(trim(q))) AS INTEGER) + CAST(contains(lower(coalesce(context, '')), lower(trim(q))) AS INTEGER) + len(list_filter(coalesce(evidence, []), lambda e: contains(lower(e), lower(trim(q))))) AS phrase
 FROM got JOIN mass USING (qid) JOIN q USING (qid) JOIN n USING (id) WHERE {ACTIVE} AND kind <> 'hub'),
scored AS (SELECT qid, id, seq, ts, round(phrase + 2 * share + 2 * boost, 6)::DOUBLE AS score FROM sc WHERE phrase > 0 OR share >= 0.25),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ts DESC, seq) AS rank FROM scored)"""


def _scored(s: SparkSession, d: str) -> DataFrame:
    return R.budget_score(snap(s, d), asked(s, d), NOW)


@core.query("budget_score", f"WITH {SNAP}, {ASKED}, {_SCORE} SELECT qid, id, score, rank FROM top WHERE rank <= 10")
def budget_score(s: SparkSession, d: str) -> DataFrame:
    return R.ranked(_scored(s, d), 10).select("qid", "id", "score", "rank")


_FACTOR = "CASE rel " + " ".join(f"WHEN '{r}' THEN {f}" for r, f in R.EXPAND.items()) + " END"


@core.query(
    "budget_expand",
    f"""WITH {SNAP}, {ASKED}, {_SCORE}, {EDGES}, seeds AS (SELECT qid, id AS seed, rank, round(score, 3) AS ps FROM top WHERE rank <= 3), d AS (SELECT DISTINCT src, dst, rel FROM e), adj AS (SELECT src AS seed, dst AS nb, rel FROM d UNION ALL SELECT dst, src, rel FROM d),
x AS (SELECT qid, nb, round(ps * {_FACTOR}, 6)::DOUBLE AS s, seed, rel, rank FROM seeds JOIN adj USING (seed) WHERE {_FACTOR} IS NOT NULL AND nb IN (SELECT id FROM n WHERE {ACTIVE} AND kind <> 'hub')),
y AS (SELECT x.* FROM x ANTI JOIN scored ON scored.qid = x.qid AND scored.id = x.nb)
SELECT qid, nb AS id, s AS score, seed AS via, rel FROM y QUALIFY row_number() OVER (PARTITION BY qid, nb ORDER BY s DESC, rank, seed DESC, rel DESC) = 1""",
)
def budget_expand(s: SparkSession, d: str) -> DataFrame:
    return R.budget_expand(snap(s, d), edges(s, d), _scored(s, d), NOW)


def _est(c: str) -> str:
    return f"CASE WHEN trim({c}) = '' THEN 0 ELSE greatest(1, CAST(ceil(round(length(regexp_replace({c}, '[^а-яёА-ЯЁ]', '', 'g')) / 2.6 + (length({c}) - length(regexp_replace({c}, '[^а-яёА-ЯЁ]', '', 'g'))) / 4.0, 9)) AS INTEGER)) END"


@core.query(
    "budget_pack",
    f"""WITH RECURSIVE {SNAP}, {ASKED}, {_SCORE}, it AS (SELECT qid, rank, {_est("coalesce(claim, '') || ' ' || coalesce(context, '')[1:240]")} AS f, {_est("coalesce(claim, '')")} AS s FROM top JOIN n USING (id) WHERE rank <= 10),
fold(qid, i, used, k, trimmed, stop) AS (SELECT DISTINCT qid, 0, 0, 0, 0, false FROM it UNION ALL
 SELECT fold.qid, i + 1, CASE WHEN used + f <= 150 THEN used + f WHEN used + s > 195.0 THEN used ELSE used + s END, CASE WHEN used + f > 150 AND used + s > 195.0 THEN k ELSE k + 1 END,
 CASE WHEN used + f > 150 AND used + s <= 195.0 THEN trimmed + 1 ELSE trimmed END, used + f > 150 AND used + s > 195.0 FROM fold JOIN it ON it.qid = fold.qid AND it.rank = i + 1 WHERE NOT stop)
SELECT qid, used AS tokens_used, k AS n_results, trimmed AS n_trimmed FROM fold QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i DESC) = 1""",
)
def budget_pack(s: SparkSession, d: str) -> DataFrame:
    return R.budget_pack(snap(s, d), _scored(s, d), 150)


def _tok2(c: str) -> str:
    return tokens(c).replace("length(w) >= 3", "length(w) >= 2")


_BM = f"""bt AS (SELECT id, token, sum(w) AS tf FROM (SELECT id, unnest({_tok2('claim')}) AS token, 3 AS w FROM n UNION ALL SELECT id, unnest({_tok2('source')}), 2 FROM n UNION ALL SELECT id, unnest({_tok2('context')}), 1 FROM n UNION ALL SELECT id, unnest({_tok2("array_to_string(evidence, ' ')")}), 1 FROM n) GROUP BY ALL),
bi AS (SELECT token, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM bt GROUP BY 1), dl AS (SELECT id, sum(tf) AS dl FROM bt GROUP BY 1),
bq AS (SELECT DISTINCT qid, unnest({_tok2('q')}) AS token FROM q),
bs AS (SELECT qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ((SELECT sum(dl) FROM dl) / (SELECT count(*) FROM n))))), 6)::DOUBLE AS score FROM bq JOIN bi USING (token) JOIN bt USING (token) JOIN dl USING (id) GROUP BY ALL),
bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM bs JOIN n USING (id) QUALIFY rank <= 20)"""


@core.query("idf_bm25", f"WITH {SNAP}, {ASKED}, {_BM} SELECT * FROM bi")
def idf_bm25(s: SparkSession, d: str) -> DataFrame:
    n = snap(s, d)
    return R.bm25_idf(R.bm25_terms(n), n.agg(F.count(F.lit(1)).alias("n")).scalar())


@core.query("bm25", f"WITH {SNAP}, {ASKED}, {_BM} SELECT * FROM bm")
def bm25(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(snap(s, d), asked(s, d))


@core.query(
    "rrf",
    f"""WITH {SNAP}, {ASKED}, {_SCORE}, {_BM}, u AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS s FROM top WHERE rank <= 20 UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank) FROM bm), f AS (SELECT qid, id, round(sum(s), 9) AS score FROM u GROUP BY ALL)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5""",
)
def rrf(s: SparkSession, d: str) -> DataFrame:
    return R.rrf([R.ranked(_scored(s, d), 20), R.bm25(snap(s, d), asked(s, d))])


_COS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS qid, v.vec_id, q.label AS ql, v.label, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 5)"""


def _vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return R.vector_search(v, v.where("vec_id % 50 = 0"))


@core.query("search_semantic", f"WITH {_COS} SELECT qid, vec_id, score, rank FROM top")
def search_semantic(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d)


@core.query(
    "eval_recall",
    f"""WITH {_COS}, g AS (SELECT label, count(*) - 1 AS gt FROM v GROUP BY 1), m AS (SELECT qid, any_value(gt) AS gt, count(*) FILTER (top.label = ql) AS hits, min(CASE WHEN top.label = ql THEN rank END) AS first FROM top JOIN g ON g.label = ql GROUP BY 1)
SELECT round(avg(CASE WHEN gt > 0 THEN hits / gt ELSE 0 END), 4) AS recall5, round(avg(hits / 5.0), 4)::DOUBLE AS p5, round(avg(coalesce(1.0 / first, 0)), 4)::DOUBLE AS mrr, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 4)::DOUBLE AS hit1 FROM m""",
)
def eval_recall(s: SparkSession, d: str) -> DataFrame:
    """AG-19: recall, precision, MRR and hit at 1 of the vector search, relevance being an equal label."""
    v = table(s, d, "embeddings").select("vec_id", "label")
    sizes = v.groupBy(C("label").alias("ql")).agg((F.count(F.lit(1)) - 1).alias("gt"))
    j = _vectors(s, d).join(v, "vec_id").join(v.select(C("vec_id").alias("qid"), C("label").alias("ql")), "qid").join(sizes, "ql")
    same = C("label") == C("ql")
    m = j.groupBy("qid").agg(F.first("gt").alias("gt"), F.count_if(same).alias("hits"), F.min(F.when(same, C("rank"))).alias("first"))
    return m.agg(F.round(F.avg(F.when(C("gt") > 0, C("hits") / F.nullif(C("gt"), F.lit(0))).otherwise(0.0)), 4).alias("recall5"), F.round(F.avg(C("hits") / 5.0), 4).alias("p5"), F.round(F.avg(F.coalesce(1.0 / C("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.when(C("first") == 1, 1.0).otherwise(0.0)), 4).alias("hit1"))


_ST = "CASE WHEN w SIMILAR TO '.*ies' AND length(w) >= 6 THEN w[1:length(w)-3] || 'y' WHEN suffix(w, 'ing') AND length(w) >= 6 THEN w[1:length(w)-3] WHEN suffix(w, 'ed') AND length(w) >= 5 THEN w[1:length(w)-2] WHEN regexp_matches(w, '(?:s|x|z|ch|sh)es$') AND length(w) >= 5 THEN w[1:length(w)-2] WHEN regexp_matches(w, '[^s]s$') AND length(w) >= 4 THEN w[1:length(w)-1] ELSE w END"


@core.query("stems_en", f"WITH {SNAP}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(claim), '[a-z]{{2,}}')) AS w FROM n) SELECT {_ST} AS stem, count(*) AS n_words FROM w GROUP BY 1")
def stems_en(s: SparkSession, d: str) -> DataFrame:
    w = snap(s, d).select(F.explode(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).distinct()
    return w.groupBy(S.stem_en(C("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n_words"))


@core.query(
    "relevance_after_topk",
    f"""WITH {SNAP}, {QSQL}, {_SCORE}, k AS (SELECT qid, id, rank FROM top WHERE rank <= 10) SELECT k.qid, k.id, k.rank FROM k JOIN n USING (id) WHERE kind = 'fact' AND len(list_filter(coalesce(tags, []), lambda t: t = 'rule')) = 0""",
)
def relevance_after_topk(s: SparkSession, d: str) -> DataFrame:
    """FL-6: filters on kind and tags apply to the limited result, not before the limit."""
    n = snap(s, d)
    top = R.ranked(R.budget_score(n, queries_df(s), NOW), 10)
    kept = n.where((C("kind") == "fact") & ~F.coalesce(F.array_contains("tags", "rule"), F.lit(False))).select("id")
    return top.join(kept, "id", "left_semi").select("qid", "id", "rank")
