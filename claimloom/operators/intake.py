"""The write path and the reading of its results (DM-12..14, GT-7, FL-3, FL-5, SR-8, SR-9, SR-13, AG-16, AG-23, TX-33, TX-34).

A batch of rows is judged against all rows of the snapshot, as in the other gates.
Null columns count as blank; repeated rows have gone with the snapshot; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import questions as T
from claimloom.functions import scalars as S
from claimloom.operators import quality as Q
from claimloom.runtime import norm_id, stage_path, staged

C = F.col
REINFORCE, MAX_DEPTH = 0.05, 5


def intake(snap: DataFrame, now: float) -> DataFrame:
    """DM-13, GT-7: what a gated insert makes of each row.

    ``(id, outcome, gate, kind, confidence, router, reinforces)``: hubs are refused, rejected duplicates reinforce the
    row they repeat, flagged facts become hypotheses; without a confidence the share of passed checks is taken.
    """
    gates = Q.gated(snap, now)
    checks = Q.truth_gate(snap, now).select("id", "score")
    j = snap.select("id", "claim", "context", "kind", "confidence", "tags").join(gates, "id").join(checks, "id")
    outcome = F.when(C("kind") == "hub", "refused").when(C("verdict") == "reject", "rejected").otherwise("added")
    kind = F.when((C("verdict") == "flag") & (C("kind") == "fact"), "hypothesis").otherwise(C("kind"))
    confidence = F.coalesce("confidence", F.greatest(F.lit(0.05), F.least(F.lit(1.0), C("score") / 6.0)))
    router = F.element_at(T.router_tags(C("tags"), C("claim"), C("context"), C("kind")), -1)
    again = F.when((outcome == "rejected") & (C("gate") == "g4"), C("other_id")).otherwise("")
    return j.select("id", outcome.alias("outcome"), "gate", kind.alias("kind"), F.round(confidence, 6).alias("confidence"), router.alias("router"), again.alias("reinforces"))


def reinforced(decided: DataFrame, snap: DataFrame) -> DataFrame:
    """GT-7: rows that rejected inserts reinforce, with the number of these and the new weight."""
    hits = decided.where("reinforces <> ''").groupBy(C("reinforces").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return snap.select("id", S.falsy(C("weight"), 1.0).alias("weight")).join(hits, "id").select("id", "n", F.round(F.least(F.lit(1.0), C("weight") + REINFORCE * C("n")), 6).alias("weight"))


def verified_weights(snap: DataFrame, now: float) -> DataFrame:
    """DM-14, TG-7: verdict of the row checks, and the weight after it: two hundredths for each check beyond four."""
    checks = Q.truth_gate(snap, now).select("id", "score", "verdict")
    more = F.when(C("verdict") == "pass", F.greatest(F.lit(0.0), 0.02 * (C("score") - 4))).otherwise(0.0)
    return snap.select("id", S.falsy(C("weight"), 1.0).alias("w")).join(checks, "id").select("id", "score", "verdict", F.round(F.least(F.lit(1.0), C("w") + more), 6).alias("weight"))


def depths(snap: DataFrame) -> DataFrame:
    """GR-6: number of parents above each node and the topmost of them, by pointer doubling over the stated parents.

    However deep the trees are, log rounds are enough.  A node in or below a cycle has depth -1 and no top ("").
    """
    root = stage_path(snap.sparkSession, "depths")
    ids = snap.select(C("id").alias("p"))
    up = snap.select("id", norm_id(C("parent")).alias("p")).join(ids, "p", "left_semi").select("id", C("p").alias("up"), F.lit(1).cast("bigint").alias("d"))
    rows = staged(snap.select("id").join(up, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.coalesce("d", F.lit(0)).alias("d")), "depths", f"{root}/0")
    n, before, r = rows.count(), None, 0
    while True:
        above = rows.select(C("id").alias("up"), C("up").alias("up2"), C("d").alias("d2"))
        r += 1
        nxt = staged(rows.join(above, "up").select("id", C("up2").alias("up"), (C("d") + C("d2")).alias("d")), "depths", f"{root}/{r}")
        # Roots point at themselves with distance 0; only walks on cycles still grow when 2^r exceeds the rows.
        rows, total = nxt, nxt.agg(F.sum("d")).first()[0]
        if total == before or 2**r > n:
            break
        before = total
    ended = rows.join(rows.where("d = 0").select(C("id").alias("up")), "up", "left_semi").select("id", "d", "up")
    return snap.select("id").join(ended, "id", "left").select("id", F.coalesce("d", F.lit(-1)).cast("int").alias("depth"), F.coalesce("up", F.lit("")).alias("top_id"))


def child_inserts(snap: DataFrame, limit: int = MAX_DEPTH) -> DataFrame:
    """DM-12: for each row that names a parent, whether it may be added below it: missing parent, cycle, too deep, or ok."""
    d = depths(snap).select(C("id").alias("p"), "depth")
    rows = snap.select("id", norm_id(C("parent")).alias("p")).where("p is not null")
    verdict = F.when(C("depth").isNull(), "missing").when((C("p") == C("id")) | (C("depth") < 0), "cycle").when(C("depth") + 1 > limit, "deep").otherwise("ok")
    return rows.join(d, "p", "left").select("id", verdict.alias("verdict"))


def with_tags(snap: DataFrame, wanted: Column) -> DataFrame:
    """FL-3: rows that hold all wanted tags."""
    return snap.where(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def read_gates(snap: DataFrame, queries: DataFrame, now: float, threshold: float = 2.0) -> DataFrame:
    """FL-5: rows that G2, then G5 let through for each stated query; only rejections drop a row."""
    fresh = snap.where(Q.staleness_gate(now) != "reject")
    return Q.relevance_gate(fresh, queries, threshold).where("verdict <> 'reject'").select("qid", "id", "score")


def result_conflicts(results: DataFrame, edges: DataFrame, snap: DataFrame) -> DataFrame:
    """SR-8: conflicts_with edges of either direction at the results ``(qid, id)``, to nodes that exist; repeated edges count."""
    e = edges.where("rel = 'conflicts_with'")
    both = e.select(C("src").alias("id"), C("dst").alias("other")).union(e.select(C("dst").alias("id"), C("src").alias("other")))
    return results.select("qid", "id").join(both, "id").join(snap.select(C("id").alias("other")), "other", "left_semi").groupBy("qid", "id", "other").agg(F.count(F.lit(1)).alias("n_edges"))


def query_hubs(queries: DataFrame, snap: DataFrame) -> DataFrame:
    """SR-9: hubs whose entity (tag ``entity:...``) stands in a stated query ``(qid, q)``."""
    hubs = snap.where("kind = 'hub'").select(C("id").alias("hub_id"), F.explode("tags").alias("t")).where(C("t").startswith("entity:")).select("hub_id", F.expr("substring(t, 8)").alias("entity"))
    return hubs.join(queries.select("qid", S.norm_text(C("q")).alias("qn")), (F.length("entity") > 0) & F.contains(C("qn"), C("entity"))).select("qid", "hub_id", "entity").distinct()


def with_fallback(first: DataFrame, second: DataFrame, queries: DataFrame) -> DataFrame:
    """SR-13: results of the first search; a query of two words or more that has none there takes those of the second."""
    none = queries.where(F.size(F.regexp_extract_all(F.coalesce("q", F.lit("")), F.lit(r"\S+"), F.lit(0))) >= 2).select("qid").join(first.select("qid").distinct(), "qid", "left_anti")
    cols = ["qid", "id", "score", "rank"]
    return first.select(*cols, F.lit("substring").alias("mode")).unionByName(second.join(none, "qid", "left_semi").select(*cols, F.lit("token_fallback").alias("mode")))


def related_hubs(edges: DataFrame, snap: DataFrame) -> DataFrame:
    """AG-16: for each hub the number of members and of the hubs it shares an edge with."""
    hubs = snap.where("kind = 'hub'").select("id")
    ids = snap.select("id")
    e = edges.select("src", "dst", "rel").distinct().join(hubs.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    members = e.where("rel = 'has_part'").groupBy(C("src").alias("hub_id")).agg(F.count_distinct("dst").alias("n_members"))
    among = e.join(hubs.withColumnRenamed("id", "dst"), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
    both = among.union(among.select("dst", "src")).distinct().groupBy(C("src").alias("hub_id")).agg(F.count(F.lit(1)).alias("n_related"))
    zero = F.lit(0).cast("bigint")
    return hubs.select(C("id").alias("hub_id")).join(members, "hub_id", "left").join(both, "hub_id", "left").select("hub_id", F.coalesce("n_members", zero).alias("n_members"), F.coalesce("n_related", zero).alias("n_related"))


def savings(messages: DataFrame, kept: DataFrame, key: str, text: str, summary: int = 40) -> DataFrame:
    """AG-23: tokens of a session before and after compaction; messages outside ``kept(key, rec_id)`` leave a summary of ``summary`` tokens a chunk of three."""
    m = messages.join(kept.select(key, "rec_id", F.lit(True).alias("stays")), [key, "rec_id"], "left")
    t = T.context_tokens(C(text))
    gone = F.coalesce(~C("stays"), C("stays").isNull())
    per = m.groupBy(key).agg(F.sum(t).alias("before"), F.sum(F.when(~gone, t).otherwise(0)).alias("recent"), F.count_if(gone).alias("n_gone"))
    after = (C("recent") + summary * F.ceil(C("n_gone") / 3)).cast("bigint")
    return per.select(key, "before", after.alias("after"), F.round(1 - after / F.nullif(C("before"), F.lit(0)), 4).alias("saved_ratio"))


def link_passports(edges: DataFrame) -> DataFrame:
    """TX-33, TX-34: each source's links as a map from target to the JSON passport of its first edge (author, rel)."""
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("edge_id", "author", "rel")).alias("e"))
    entry = F.struct("dst", F.to_json(F.struct(C("e.author").alias("author"), C("e.rel").alias("rel"))).alias("j"))
    return first.groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("meta"))
