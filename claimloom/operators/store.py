"""Keyed table operators on snapshots: one row for each id, changes as new snapshots (DM-*, AG-*).

All take an explicit clock ``now`` (seconds since 1970).  Nothing is changed in place:
an update is an anti join and a union, so a job that fails leaves the old snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.runtime import norm_id

C = F.col


def snapshot(nodes: DataFrame) -> DataFrame:
    """The row of each id that arrived first; ids in normal form.  Redelivered rows hold the same content."""
    keyed = nodes.withColumn("id", norm_id(C("id"))).where("id is not null")
    return keyed.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")


def long_links(snap: DataFrame, column: str = "links") -> DataFrame:
    """``(src, dst, pos, src_seq)``: distinct targets in normal form, with their first place; blank ones left out (§1.1 Edge)."""
    rows = snap.select(C("id").alias("src"), C("seq").alias("src_seq"), F.posexplode(column).alias("pos", "raw"))
    return rows.withColumn("dst", norm_id(C("raw"))).where("dst is not null").groupBy("src", "dst", "src_seq").agg(F.min("pos").alias("pos"))


def decay(snap: DataFrame, now: float, half_life: float = S.HALF_LIFE_H) -> DataFrame:
    """DM-10: weights after exponential decay; ``moved`` marks rows whose reference time lies before now."""
    ref = S.iso_seconds(C("last_used"))
    w = S.falsy(C("weight"), 1.0)
    return snap.select("id", F.round(S.decayed(w, C("kind"), ref, now, half_life), 6).alias("weight"), F.coalesce(F.lit(now) > ref, F.lit(False)).alias("moved"))


def decay_summary(snap: DataFrame, now: float) -> DataFrame:
    """AG-15."""
    d = decay(snap, now)
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("weight"), 4).alias("w_min"), F.round(F.max("weight"), 4).alias("w_max"), F.round(F.avg("weight"), 4).alias("w_mean"), F.count_if(C("weight") < 0.5).alias("below_half"))


def reinforce(snap: DataFrame, hits: DataFrame, delta: float = 0.05) -> DataFrame:
    """DM-9: weight + delta for each hit ``(id)``, at most 1.  Hits are counted before the join."""
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n_hits"))
    return snap.join(n, "id").select("id", "n_hits", F.round(F.least(F.lit(1.0), S.falsy(C("weight"), 1.0) + F.greatest(F.lit(0.0), F.lit(delta)) * C("n_hits")), 6).alias("weight"))


def rewrite(snap: DataFrame, new_claim: Column) -> DataFrame:
    """DM-8: rows whose claim changes, with the revision that keeps the old text."""
    return snap.withColumn("new", new_claim).where("new <> claim").select("id", C("new").alias("claim"), F.array(F.struct(C("claim").alias("claim_before"), C("new").alias("claim_after"))).alias("revisions"))


def batch_conflicts(store: DataFrame, batch: DataFrame) -> DataFrame:
    """DM-3/4: ids of a batch that occur twice in it or are in the store already; an insert is refused if there are any."""
    b = batch.groupBy("id").agg(F.count(F.lit(1)).alias("n_in_batch"))
    s = store.select("id").distinct().withColumn("in_store", F.lit(True))
    return b.join(s, "id", "left").select("id", "n_in_batch", F.coalesce("in_store", F.lit(False)).alias("in_store")).where("n_in_batch > 1 or in_store")


def insert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """DM-3/4: the batch as a whole or an error."""
    if not batch_conflicts(store, batch).isEmpty():
        raise ValueError("ids are in the store already or twice in the batch")
    return store.unionByName(batch, allowMissingColumns=True)


def update(store: DataFrame, batch: DataFrame) -> DataFrame:
    """DM-5: rows replaced by id; an id that the store does not have is an error."""
    if not batch.join(store, "id", "left_anti").isEmpty():
        raise KeyError("update of ids that are not in the store")
    return store.join(batch, "id", "left_anti").unionByName(batch, allowMissingColumns=True)


def delete(snap: DataFrame, gone: DataFrame) -> DataFrame:
    """DM-6: rows without the ids of ``gone(id)``; children and parent of others are repaired, links stay.

    Gives ``(id, n_children, n_children_left, parent_cleared)`` for the rows that stay.
    """
    gone = gone.select("id").distinct()
    left = snap.join(gone, "id", "left_anti")
    kids = left.select("id", F.explode("children").alias("raw")).select("id", norm_id(C("raw")).alias("kid"), F.lit(1).alias("one"))
    marked = kids.join(gone.select(C("id").alias("kid"), F.lit(1).alias("lost")), "kid", "left")
    per = marked.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("lost").alias("lost"))
    lost_parent = gone.select(C("id").alias("p"), F.lit(True).alias("cleared"))
    rows = left.select("id", norm_id(C("parent")).alias("p")).join(lost_parent, "p", "left").join(per, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("id", n.alias("n_children"), (n - F.coalesce("lost", F.lit(0))).alias("n_children_left"), F.coalesce("cleared", F.lit(False)).alias("parent_cleared"))


def link_existing(snap: DataFrame, requests: DataFrame) -> DataFrame:
    """DM-11: accepted new links ``(src, dst, rel, author)`` of ``requests(edge_id, src, dst, rel, author)``.

    Both ends must exist, loops and links that are there are refused, the first request for a pair wins;
    part_of and has_part bring their inverse.
    """
    ids = snap.select("id")
    r = requests.select("edge_id", norm_id(C("src")).alias("src"), norm_id(C("dst")).alias("dst"), F.coalesce("rel", F.lit("related_to")).alias("rel"), F.coalesce("author", F.lit("unknown")).alias("author")).where("src is not null and dst is not null and src <> dst")
    r = r.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    inverse = F.when(C("rel") == "part_of", "has_part").when(C("rel") == "has_part", "part_of")
    both = r.unionByName(r.where("rel in ('part_of', 'has_part')").select("edge_id", C("dst").alias("src"), C("src").alias("dst"), inverse.alias("rel"), "author"))
    first = both.groupBy("src", "dst").agg(F.min(F.struct("edge_id", "rel", "author")).alias("r"))
    return first.join(long_links(snap), ["src", "dst"], "left_anti").select("src", "dst", C("r.rel").alias("rel"), C("r.author").alias("author"))


def referenced(snap: DataFrame) -> DataFrame:
    """DM-22: ids that any links, children or parent name."""
    named = snap.select(F.explode("links").alias("x")).union(snap.select(F.explode("children"))).union(snap.select("parent"))
    return named.select(norm_id(C("x")).alias("id")).where("id is not null").distinct()


def usage(hits: DataFrame, keep: int = 20) -> DataFrame:
    """DM-16: ``(id, n, last_hit, n_kept)`` from hits ``(id, at)``; only the last ``keep`` hits stay in the list."""
    per = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_hit"))
    return per.withColumn("n_kept", F.least(C("n"), F.lit(keep)).cast("int"))


def last_hits(hits: DataFrame, keep: int = 20) -> DataFrame:
    """WN-10: the last ``keep`` hits of each id as rows ranked by time; a hot id is cut in every task before the shuffle."""
    w = Window.partitionBy("id").orderBy(C("at").desc())
    return hits.withColumn("rank", F.row_number().over(w)).where(C("rank") <= keep)


def prune_ttl(snap: DataFrame, now: float) -> DataFrame:
    """DM-17: rows whose time is over and which become outdated."""
    until = S.iso_seconds(C("valid_until"))
    return snap.where(~C("kind").isin("rule", "outdated", "refuted") & (F.lit(now) >= until)).select("id", "kind")


def prune_dupes(snap: DataFrame) -> DataFrame:
    """DM-18: ``(id, role, weight)`` of groups with the same canonical claim: the newest keeps the greatest weight, unreferenced others go."""
    rows = snap.where("kind <> 'rule'").select("id", "seq", F.coalesce("ts", F.lit("")).alias("ts"), S.canonical_key(C("claim")).alias("key"), S.falsy(C("weight"), 1.0).alias("w")).where("key <> ''")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("top"), F.max(F.struct("ts", (-C("seq")).alias("s"), "id")).alias("best")).where("n > 1")
    both = rows.join(groups, "key").withColumn("keeper", C("id") == C("best.id"))
    used = referenced(snap).withColumn("used", F.lit(True))
    role = F.when(C("keeper"), "keep").when(C("used"), "referenced").otherwise("delete")
    return both.join(used, "id", "left").select("id", role.alias("role"), F.round(F.when(C("keeper"), C("top")).otherwise(C("w")), 6).alias("weight"))


def prune_prefix(snap: DataFrame, prefix: str) -> DataFrame:
    """DM-19."""
    return snap.where((C("kind") != "rule") & C("source").startswith(prefix)).select("id", "kind")


def prune_weak(snap: DataFrame, now: float, weight: float = 0.1, days: float = 30.0) -> DataFrame:
    """DM-20: weak, unreferenced rows that were not used for ``days``."""
    idle = S.iso_seconds(C("last_used")) < now - days * 86400
    return snap.where((C("kind") != "rule") & (S.falsy(C("weight"), 1.0) <= weight) & idle).join(referenced(snap), "id", "left_anti").select("id", "kind")


def prune_capped(candidates: DataFrame, snap: DataFrame, max_delete: int) -> DataFrame:
    """DM-21: the first ``max_delete`` candidates in order of arrival."""
    return candidates.join(snap.select("id", "seq"), "id").orderBy("seq").limit(max_delete).select("id", "seq")


def summarize_preview(snap: DataFrame, prefix: str, cap: int = 500) -> DataFrame:
    """DM-15, AG-18: size and time span of a cluster by prefix of its source, oldest first, at most ``cap`` members."""
    members = snap.where(~C("kind").isin("rule", "outdated", "refuted") & C("source").startswith(prefix)).select("id", "seq", S.iso_seconds(C("ts")).alias("at"))
    kept = members.orderBy(C("at").asc_nulls_first(), "seq").limit(cap)
    return kept.agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def decide_level(snap: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """TX-20: detail level by age, idle time, weight and hits of the last week."""
    recent = hits.where(C("at") > now - 7 * 86400).groupBy("id").agg(F.count(F.lit(1)).alias("h7"))
    last = hits.groupBy("id").agg(F.max("at").alias("hit"))
    j = snap.join(last, "id", "left").join(recent, "id", "left")
    used = S.iso_seconds(C("last_used"))
    ts = F.coalesce(S.iso_seconds(C("ts")), F.lit(now))
    age = (F.lit(now) - ts) / 86400
    idle = (F.lit(now) - F.coalesce(F.greatest(used, C("hit")), ts)) / 86400
    w = S.decayed(S.falsy(C("weight"), 0.05), C("kind"), used, now)
    until = S.iso_seconds(C("valid_until"))
    level = (
        F.when(C("kind").isin("rule", "hub"), 0)
        .when(C("kind").isin("refuted", "outdated") | (F.lit(now) >= until), 2)
        .when((age <= 30) | (idle <= 14) | (w >= 0.85) | (F.coalesce("h7", F.lit(0)) >= 3), 0)
        .when((age <= 90) | (idle <= 45) | (w >= 0.5), 1)
        .otherwise(2)
    )
    return j.select("id", level.alias("level"))


KINDS = ("fact", "hypothesis", "refuted", "outdated", "context_summary", "rule", "hub")


def violations(snap: DataFrame) -> DataFrame:
    """DM-2: ``(id, n_bad, bad)`` for rows that break a constraint."""
    checks = {
        "claim": F.length(F.btrim(F.coalesce("claim", F.lit("")))) == 0,
        "kind": ~F.coalesce(C("kind").isin(*KINDS), F.lit(False)),
        "weight": ~F.coalesce(C("weight").between(0.05, 1.0), F.lit(False)),
        "confidence": F.coalesce(~C("confidence").between(0.0, 1.0), F.lit(False)),
        "level": F.coalesce(~C("level").between(0, 2), F.lit(False)),
        "ts": S.iso_seconds(C("ts")).isNull(),
        "valid_until": C("valid_until").isNotNull() & S.iso_seconds(C("valid_until")).isNull(),
        "parent": norm_id(C("parent")) == C("id"),
    }
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return snap.select("id", F.array_join(bad, ",").alias("bad"), F.size(bad).alias("n_bad")).where("n_bad > 0")


def with_ttl(snap: DataFrame, hours: float) -> DataFrame:
    """DM-1: valid_until, or ts + ``hours`` where it is not given, in seconds."""
    return snap.select("id", F.coalesce(S.iso_seconds(C("valid_until")), S.iso_seconds(C("ts")) + hours * 3600).alias("until")).where("until is not null")
