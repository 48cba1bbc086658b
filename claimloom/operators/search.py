"""Lexical, idf, BM25F, vector search and rank fusion; queries are a DataFrame ``(qid, q)`` (SR-*, WN-1, 4, 5).

Postings are joined on tokens with the tokens of the queries, so the work follows the
postings of the query words.  Scores are rounded before they order anything, ties go to
the newer ts, then to the smaller seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.runtime import map_batches

C = F.col
# Fixed values (§7.8).
FIELD_WEIGHTS = (("claim", 3), ("source", 2), ("context", 1))
EXPAND = {"supersedes": 0.6, "conflicts_with": 0.6, "refers_to": 0.5, "duplicate_of": 0.3, "related_to": 0.45}
K1, B, RRF_K = 1.2, 0.75, 60


def boost(now: float) -> Column:
    """clamp(confidence, 0, 1) x decayed weight; missing or zero confidence is .5, weight .05 (§1.4)."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.falsy(C("confidence"), 0.5)))
    return conf * S.decayed(S.falsy(C("weight"), 0.05), C("kind"), S.iso_seconds(C("last_used")), now)


def node_text() -> Column:
    return F.concat_ws("\n", F.coalesce("claim", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("source", F.lit("")), F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), "\n"))


def ranked(scored: DataFrame, k: int, per: str = "qid") -> DataFrame:
    w = Window.partitionBy(per).orderBy(C("score").desc(), C("ts").desc(), C("seq"))
    return scored.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


def live(snap: DataFrame, now: float) -> DataFrame:
    return snap.where(S.is_active(C("kind"), C("valid_until"), now) & (C("kind") != "hub"))


def search_exact(snap: DataFrame, queries: DataFrame, now: float, k: int = 5) -> DataFrame:
    """SR-2: rows whose canonical claim equals the query, newest first."""
    rows = snap.where(S.is_active(C("kind"), C("valid_until"), now)).select("id", "seq", F.coalesce("ts", F.lit("")).alias("ts"), S.canonical_key(C("claim")).alias("key"))
    q = queries.select("qid", S.canonical_key(C("q")).alias("key")).where("key <> ''")
    return ranked(q.join(rows, "key").withColumn("score", F.lit(0)), k).select("qid", "id", "rank")


def search_substring(snap: DataFrame, queries: DataFrame, now: float, k: int = 5) -> DataFrame:
    """SR-1, SR-3: field hits + evidence hits + tf bonus + 2 boost + level boost; an exact claim shuts the rest out.

    ``queries`` is a stated set that is broadcast.
    """
    q = F.broadcast(queries.select("qid", F.lower(F.btrim("q")).alias("ql")))
    low = [F.lower(F.coalesce(c, F.lit(""))).alias(f"l_{c}") for c in ("claim", "source", "context")]
    rows = live(snap, now).select("id", "seq", F.coalesce("ts", F.lit("")).alias("ts"), "level", boost(now).alias("boost"), *low, F.transform(F.coalesce("evidence", F.array().cast("array<string>")), F.lower).alias("ev"))
    hit = F.contains("l_claim", C("ql")) | F.contains("l_source", C("ql")) | F.contains("l_context", C("ql")) | F.exists("ev", lambda e: F.contains(e, C("ql")))
    j = rows.join(q, hit)
    tf = (F.length("l_claim") - F.length(F.replace("l_claim", C("ql"), F.lit("")))) / F.length("ql")
    field = sum((F.contains(f"l_{c}", C("ql")).cast("int") * w for c, w in FIELD_WEIGHTS), F.lit(0))
    s = field + F.size(F.filter("ev", lambda e: F.contains(e, C("ql")))) + F.when(tf > 1, F.least(F.lit(1.0), 0.5 * F.ln(tf))).otherwise(0.0)
    exact = (F.btrim("l_claim") == C("ql")).cast("int")
    scored = j.select("qid", "id", "seq", "ts", exact.alias("exact"), F.round(s + 2 * C("boost") + 1.0, 6).alias("score"))
    only = scored.groupBy("qid").agg(F.max("exact").alias("any_exact"))
    kept = scored.join(only, "qid").where("exact = any_exact")
    return ranked(kept.withColumn("score", F.when(C("any_exact") == 1, 0.0).otherwise(C("score"))), k).select("qid", "id", "score", "rank")


def budget_postings(snap: DataFrame) -> DataFrame:
    """``(id, token)`` of rows that are no hubs."""
    return snap.where("kind <> 'hub'").select("id", F.explode(F.array_distinct(S.budget_tokens(node_text()))).alias("token"))


def budget_idf(snap: DataFrame) -> DataFrame:
    """AG-8: ln(1 + n / df)."""
    n = snap.where("kind <> 'hub'").agg(F.count(F.lit(1)).alias("n"))
    df = budget_postings(snap).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("n", n.scalar()).select("token", "df", F.round(F.ln(1 + C("n") / C("df")), 6).alias("idf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(S.budget_tokens(C("q")))).alias("token"))


def budget_score(snap: DataFrame, queries: DataFrame, now: float, min_token: float = 0.25) -> DataFrame:
    """SR-5: phrase hits + 2 x share of idf mass + 2 x boost for every live row with a quarter of the mass or a phrase hit."""
    idf = budget_idf(snap)
    qt = query_tokens(queries).join(idf.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    mass = qt.groupBy("qid").agg(F.sum("idf").alias("mass"))
    got = qt.join(budget_postings(snap), "token").groupBy("qid", "id").agg(F.sum("idf").alias("got"))
    rows = live(snap, now).select("id", "seq", F.coalesce("ts", F.lit("")).alias("ts"), boost(now).alias("boost"), "claim", "source", "context", "evidence")
    j = got.join(mass, "qid").join(queries.select("qid", F.lower(F.btrim("q")).alias("ql")), "qid").join(rows, "id")
    phrase = sum((F.contains(F.lower(F.coalesce(c, F.lit(""))), C("ql")).cast("int") * w for c, w in FIELD_WEIGHTS), F.lit(0)) + F.size(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.contains(F.lower(e), C("ql"))))
    share = F.round(C("got") / C("mass"), 6)
    return j.withColumn("phrase", phrase).withColumn("share", share).where((C("phrase") > 0) | (C("share") >= min_token)).select("qid", "id", "seq", "ts", F.round(C("phrase") + 2 * C("share") + 2 * C("boost"), 6).alias("score"))


def budget_expand(snap: DataFrame, edges: DataFrame, scored: DataFrame, now: float, seeds: int = 3) -> DataFrame:
    """SR-7: neighbours of the first seeds, with the seed's score (3 places) times the factor of the relation; the best seed wins."""
    first = ranked(scored, seeds).select("qid", C("id").alias("seed"), "rank", F.round("score", 3).alias("ps"))
    e = edges.select("src", "dst", "rel").distinct()
    adj = e.select(C("src").alias("seed"), C("dst").alias("nb"), "rel").union(e.select("dst", "src", "rel"))
    factor = F.coalesce(*[F.when(C("rel") == r, F.lit(f)) for r, f in EXPAND.items()])
    near = first.join(adj, "seed").withColumn("f", factor).where("f is not null")
    rows = live(snap, now).select(C("id").alias("nb"))
    new = near.join(rows, "nb", "left_semi").join(scored.select("qid", C("id").alias("nb")), ["qid", "nb"], "left_anti")
    best = new.select("qid", "nb", F.struct(F.round(C("ps") * C("f"), 6).alias("s"), (-C("rank")).alias("r"), "seed", "rel").alias("x")).groupBy("qid", "nb").agg(F.max("x").alias("x"))
    return best.select("qid", C("nb").alias("id"), C("x.s").alias("score"), C("x.seed").alias("via"), C("x.rel").alias("rel"))


def budget_pack(snap: DataFrame, scored: DataFrame, budget: int, k: int = 10) -> DataFrame:
    """WN-5: fold of the first k rows: a row that does not fit is trimmed to its claim, and the list ends where even that passes 1.3 x budget."""
    cost = snap.select("id", S.estimate_tokens(F.concat(F.coalesce("claim", F.lit("")), F.lit(" "), F.left(F.coalesce("context", F.lit("")), F.lit(240)))).alias("full"), S.estimate_tokens(F.coalesce("claim", F.lit(""))).alias("short"))
    items = ranked(scored, k).join(cost, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "full", "short"))).alias("xs"))
    step = f"""aggregate(xs, struct(0 as used, 0 as n, 0 as trimmed, false as stop), (a, x) -> case when a.stop then a
      when a.used + x.full <= {budget} then struct(a.used + x.full as used, a.n + 1 as n, a.trimmed as trimmed, false as stop)
      when a.used + x.short > {budget} * 1.3D then struct(a.used as used, a.n as n, a.trimmed as trimmed, true as stop)
      else struct(a.used + x.short as used, a.n + 1 as n, a.trimmed + 1 as trimmed, false as stop) end)"""
    return items.select("qid", F.expr(step).alias("r")).select("qid", C("r.used").alias("tokens_used"), C("r.n").alias("n_results"), C("r.trimmed").alias("n_trimmed"))


def bm25_terms(snap: DataFrame) -> DataFrame:
    """AG-9: ``(id, token, tf)``; a token counts as often as its field weighs."""
    part = lambda c, w: F.transform(S.budget_tokens(c, 2), lambda t: F.struct(t.alias("t"), F.lit(w).alias("w")))
    evidence = F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), " ")
    every = F.concat(part(C("claim"), 3), part(C("source"), 2), part(C("context"), 1), part(evidence, 1))
    return snap.select("id", F.explode(every).alias("x")).groupBy("id", C("x.t").alias("token")).agg(F.sum("x.w").alias("tf"))


def bm25_idf(terms: DataFrame, n: Column) -> DataFrame:
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    return df.select("token", "df", F.round(F.ln(1 + (C("n") - C("df") + 0.5) / (C("df") + 0.5)), 6).alias("idf"))


def bm25(snap: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """SR-10 on the simple tokens: sum of idf x tf x 2.2 / (tf + 1.2 (.25 + .75 dl / avgdl))."""
    terms = bm25_terms(snap)
    n = snap.agg(F.count(F.lit(1)).alias("n")).scalar()
    dl = terms.groupBy("id").agg(F.sum("tf").alias("dl"))
    avgdl = dl.agg(F.sum("dl").alias("s")).scalar() / n
    qt = queries.select("qid", F.explode(F.array_distinct(S.budget_tokens(C("q"), 2))).alias("token")).join(bm25_idf(terms, n).select("token", "idf"), "token")
    hit = qt.join(terms, "token").join(dl, "id")
    gain = C("idf") * C("tf") * (K1 + 1) / (C("tf") + K1 * (1 - B + B * C("dl") / avgdl))
    scored = hit.groupBy("qid", "id").agg(F.round(F.sum(gain), 6).alias("score"))
    rows = snap.select("id", "seq", F.coalesce("ts", F.lit("")).alias("ts"))
    w = Window.partitionBy("qid").orderBy(C("score").desc(), "seq")
    return scored.join(rows, "id").withColumn("rank", F.row_number().over(w)).where(C("rank") <= k).select("qid", "id", "score", "rank")


def rrf(lists: list[DataFrame], k: int = 5, weights: list[float] | None = None) -> DataFrame:
    """SR-11: sum of w / (60 + rank) over ranked lists ``(qid, id, rank)``."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("qid", "id", (F.lit(w) / (RRF_K + C("rank"))).alias("s")) for x, w in zip(lists, weights, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(C("score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """SR-4: exact cosine top k of every query vector against all others, ``(qid, vec_id, score, rank)``.

    Queries go out in blocks of bounded size; every batch of rows keeps its own top k of a block (a matrix
    product), so what is shuffled is k rows a query and batch.  Zero vectors score 0.
    """
    spark = vectors.sparkSession
    out = None
    rows, count = [], 0
    blocks = []
    for r in queries.select(C("vec_id").alias("qid"), "embedding").orderBy("qid").toLocalIterator():
        rows.append(r)
        count += 1
        if len(rows) == block:
            blocks.append(rows)
            rows = []
    if rows:
        blocks.append(rows)
    for b in blocks:
        ids, m = np.array([r.qid for r in b]), np.array([r.embedding for r in b], np.float64)
        shared = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column("embedding").to_pylist(), np.float64)
                vid = batch.column("vec_id").to_numpy()
                sim = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6)
                sim[qids[:, None] == vid[None, :]] = -9
                top = np.argsort(-sim, axis=1, kind="stable")[:, : k + 1]
                # Ties at the edge are kept for the final order.
                edge = np.take_along_axis(sim, top[:, min(k, top.shape[1]) - 1][:, None], 1)
                a, c = np.nonzero((sim >= edge) & (sim > -9))
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(vid[c]), pa.array(sim[a, c])], names=["qid", "vec_id", "score"])

        part = map_batches(vectors.select("vec_id", "embedding"), scan, "qid bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid bigint, vec_id bigint, score double, rank int")
    w = Window.partitionBy("qid").orderBy(C("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


