"""Queries over the node table: mutations, pruning, profile (DM-*, AG-1..7, TX-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import store as O
from claimloom.plans.registry import core
from claimloom.plans.sqlbits import HITS, LINKS, LOG, NOW, SNAP, decayed, iso, nid, weight
from claimloom.runtime import norm_id, table

C = F.col


def snap(spark: SparkSession, d: str) -> DataFrame:
    return O.snapshot(table(spark, d, "nodes"))


def log(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ground_log")
    return g.groupBy("rec_id").agg(F.min_by(F.struct(*[c for c in g.columns if c != "rec_id"]), "arrived_at").alias("r")).select("rec_id", "r.*")


def seconds(c: str):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), C(c).cast("timestamp_ntz")) / 1e6


def hits(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select(F.explode("node_ids").alias("t"), seconds("ts").alias("at")).select(norm_id(C("t")).alias("id"), "at").where("id is not null")


REF = iso("last_used")


@core.query("decay", f"WITH {SNAP} SELECT id, round({decayed(weight(1.0), REF)}, 6) AS weight, coalesce({NOW} > {REF}, false) AS moved FROM n")
def decay(s: SparkSession, d: str) -> DataFrame:
    return O.decay(snap(s, d), NOW)


@core.query("decay_summary", f"WITH {SNAP}, w AS (SELECT round({decayed(weight(1.0), REF)}, 6) AS weight FROM n) SELECT count(*) AS n, round(min(weight), 4) AS w_min, round(max(weight), 4) AS w_max, round(avg(weight), 4) AS w_mean, count(*) FILTER (weight < 0.5) AS below_half FROM w")
def decay_summary(s: SparkSession, d: str) -> DataFrame:
    return O.decay_summary(snap(s, d), NOW)


@core.query("reinforce", f"WITH {SNAP}, {LOG}, {HITS}, c AS (SELECT id, count(*) AS n_hits FROM h GROUP BY 1) SELECT id, n_hits, round(least(1.0, {weight(1.0)} + 0.05 * n_hits), 6) AS weight FROM n JOIN c USING (id)")
def reinforce(s: SparkSession, d: str) -> DataFrame:
    return O.reinforce(snap(s, d), hits(s, d).select("id"))


@core.query("rewrite", f"WITH {SNAP}, r AS (SELECT id, claim AS before, trim(regexp_replace(claim, '[ \\t\\r\\n]+', ' ', 'g')) AS claim FROM n) SELECT id, claim, 1 AS n_revisions, before AS claim_before FROM r WHERE claim <> before")
def rewrite(s: SparkSession, d: str) -> DataFrame:
    r = O.rewrite(snap(s, d), F.btrim(F.regexp_replace("claim", r"[ \t\r\n]+", " ")))
    return r.select("id", "claim", F.size("revisions").alias("n_revisions"), C("revisions")[0]["claim_before"].alias("claim_before"))


_BATCH = "TIMESTAMP '2026-03-01 00:00:00'"


@core.query("insert_batch_conflicts", f"WITH b AS (SELECT {nid('id')} AS id, count(*) AS n_in_batch FROM nodes WHERE arrived_at >= {_BATCH} GROUP BY 1), s AS (SELECT DISTINCT {nid('id')} AS id FROM nodes WHERE arrived_at < {_BATCH}) SELECT id, n_in_batch, id IN (SELECT id FROM s) AS in_store FROM b WHERE n_in_batch > 1 OR id IN (SELECT id FROM s)")
def insert_batch_conflicts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nodes").select(norm_id(C("id")).alias("id"), "arrived_at")
    return O.batch_conflicts(rows.where(f"arrived_at < {_BATCH}"), rows.where(f"arrived_at >= {_BATCH}"))


@core.query("update_latest", f"SELECT {nid('id')} AS id, max(seq) AS seq FROM nodes GROUP BY 1")
def update_latest(s: SparkSession, d: str) -> DataFrame:
    """DM-5: the last delivery replaces the row."""
    rows = table(s, d, "nodes").select(norm_id(C("id")).alias("id"), "seq")
    last = rows.groupBy("id").agg(F.max("seq").alias("seq"))
    return O.update(snap(s, d).select("id", "seq"), last)


@core.query(
    "delete_cascade",
    f"""WITH {SNAP}, gone AS (SELECT DISTINCT {nid('id')} AS id FROM tombstones), rest AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM gone)),
k AS (SELECT id, {nid('c')} AS kid FROM (SELECT id, unnest(children) AS c FROM rest)),
p AS (SELECT id, count(*) AS n, count(*) FILTER (kid IN (SELECT id FROM gone)) AS lost FROM k GROUP BY 1)
SELECT id, coalesce(p.n, 0) AS n_children, coalesce(p.n, 0) - coalesce(lost, 0) AS n_children_left, coalesce({nid('parent')} IN (SELECT id FROM gone), false) AS parent_cleared FROM rest LEFT JOIN p USING (id)""",
)
def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    return O.delete(snap(s, d), table(s, d, "tombstones").select(norm_id(C("id")).alias("id")))


@core.query(
    "link_existing",
    f"""WITH {SNAP}, {LINKS}, r AS (SELECT edge_id, {nid('src')} AS src, {nid('dst')} AS dst, coalesce(rel, 'related_to') AS rel, coalesce(author, 'unknown') AS author FROM edges),
ok AS (SELECT * FROM r WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
b AS (SELECT * FROM ok UNION ALL SELECT edge_id, dst, src, CASE rel WHEN 'part_of' THEN 'has_part' ELSE 'part_of' END, author FROM ok WHERE rel IN ('part_of', 'has_part')),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY edge_id, rel, author) = 1)
SELECT src, dst, rel, author FROM f ANTI JOIN l USING (src, dst)""",
)
def link_existing(s: SparkSession, d: str) -> DataFrame:
    return O.link_existing(snap(s, d), table(s, d, "edges"))


@core.query(
    "levels",
    f"""WITH {SNAP}, {LOG}, {HITS}, x AS (SELECT id, max(tm) AS hit, count(*) FILTER (tm > {NOW} - 604800) AS h7 FROM h GROUP BY 1),
v AS (SELECT n.id, kind, {iso('valid_until')} AS vu, coalesce({iso('ts')}, {NOW}) AS ts, {REF} AS used, hit, coalesce(h7, 0) AS h7, {decayed(weight(0.05), REF)} AS w FROM n LEFT JOIN x USING (id)),
y AS (SELECT *, ({NOW} - ts) / 86400 AS age, ({NOW} - coalesce(greatest(used, hit), ts)) / 86400 AS idle FROM v)
SELECT id, CASE WHEN kind IN ('rule', 'hub') THEN 0 WHEN kind IN ('refuted', 'outdated') OR {NOW} >= vu THEN 2 WHEN age <= 30 OR idle <= 14 OR w >= 0.85 OR h7 >= 3 THEN 0 WHEN age <= 90 OR idle <= 45 OR w >= 0.5 THEN 1 ELSE 2 END AS level FROM y""",
)
def levels(s: SparkSession, d: str) -> DataFrame:
    return O.decide_level(snap(s, d), hits(s, d), NOW)


@core.query("usage_rollup", f"WITH {LOG}, {HITS} SELECT id, count(*) AS n, round(max(tm), 3) AS last_hit, CAST(least(count(*), 20) AS INTEGER) AS n_kept FROM h GROUP BY 1")
def usage_rollup(s: SparkSession, d: str) -> DataFrame:
    return O.usage(hits(s, d)).withColumn("last_hit", F.round("last_hit", 3))


_REFERENCED = f"ref AS (SELECT DISTINCT {nid('x')} AS id FROM (SELECT unnest(links) AS x FROM n UNION ALL SELECT unnest(children) FROM n UNION ALL SELECT parent FROM n) WHERE trim(x) <> '')"


@core.query("referenced", f"WITH {SNAP}, {_REFERENCED} SELECT id FROM ref")
def referenced(s: SparkSession, d: str) -> DataFrame:
    return O.referenced(snap(s, d))


@core.query("prune_ttl", f"WITH {SNAP} SELECT id, kind FROM n WHERE kind NOT IN ('rule', 'outdated', 'refuted') AND {NOW} >= {iso('valid_until')}")
def prune_ttl(s: SparkSession, d: str) -> DataFrame:
    return O.prune_ttl(snap(s, d), NOW)


@core.query(
    "prune_dupes",
    f"""WITH {SNAP}, {_REFERENCED}, r AS (SELECT id, seq, coalesce(ts, '') AS ts, lower(trim(claim)) AS key, {weight(1.0)} AS w FROM n WHERE kind <> 'rule' AND lower(trim(claim)) <> ''),
x AS (SELECT *, count(*) OVER p AS c, max(w) OVER p AS top, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS rn FROM r WINDOW p AS (PARTITION BY key))
SELECT id, CASE WHEN rn = 1 THEN 'keep' WHEN id IN (SELECT id FROM ref) THEN 'referenced' ELSE 'delete' END AS role, round(CASE WHEN rn = 1 THEN top ELSE w END, 6) AS weight FROM x WHERE c > 1""",
)
def prune_dupes(s: SparkSession, d: str) -> DataFrame:
    return O.prune_dupes(snap(s, d))


@core.query("prune_prefix", f"WITH {SNAP} SELECT id, kind FROM n WHERE kind <> 'rule' AND starts_with(source, 'report ')")
def prune_prefix(s: SparkSession, d: str) -> DataFrame:
    return O.prune_prefix(snap(s, d), "report ")


_WEAK = f"SELECT id, kind, seq FROM n WHERE kind <> 'rule' AND {weight(1.0)} <= 0.1 AND {REF} < {NOW} - 30 * 86400 AND id NOT IN (SELECT id FROM ref)"


@core.query("prune_weak", f"WITH {SNAP}, {_REFERENCED} SELECT id, kind FROM ({_WEAK})")
def prune_weak(s: SparkSession, d: str) -> DataFrame:
    return O.prune_weak(snap(s, d), NOW)


@core.query("prune_capped", f"WITH {SNAP}, {_REFERENCED} SELECT id, seq FROM ({_WEAK}) ORDER BY seq LIMIT 100")
def prune_capped(s: SparkSession, d: str) -> DataFrame:
    n = snap(s, d)
    return O.prune_capped(O.prune_weak(n, NOW), n, 100)


@core.query("summarize_preview", f"WITH {SNAP}, m AS (SELECT id, seq, {iso('ts')} AS tm FROM n WHERE kind NOT IN ('rule', 'outdated', 'refuted') AND starts_with(source, 'log of')), k AS (SELECT * FROM m ORDER BY tm NULLS FIRST, seq LIMIT 500) SELECT count(*) AS size, round(min(tm), 3) AS first_at, round(max(tm), 3) AS last_at FROM k")
def summarize_preview(s: SparkSession, d: str) -> DataFrame:
    return O.summarize_preview(snap(s, d), "log of").select("size", F.round("first_at", 3).alias("first_at"), F.round("last_at", 3).alias("last_at"))


@core.query("with_ttl", f"WITH {SNAP} SELECT id, round(coalesce({iso('valid_until')}, {iso('ts')} + 48 * 3600), 3) AS until FROM n WHERE coalesce({iso('valid_until')}, {iso('ts')}) IS NOT NULL")
def with_ttl(s: SparkSession, d: str) -> DataFrame:
    return O.with_ttl(snap(s, d), 48).withColumn("until", F.round("until", 3))


@core.query(
    "validate",
    f"""WITH {SNAP}, c AS (SELECT id, list_filter([CASE WHEN trim(coalesce(claim, '')) = '' THEN 'claim' END, CASE WHEN kind IS NULL OR kind NOT IN ('fact', 'hypothesis', 'refuted', 'outdated', 'context_summary', 'rule', 'hub') THEN 'kind' END,
 CASE WHEN weight IS NULL OR weight NOT BETWEEN 0.05 AND 1 THEN 'weight' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN level NOT BETWEEN 0 AND 2 THEN 'level' END,
 CASE WHEN {iso('ts')} IS NULL THEN 'ts' END, CASE WHEN valid_until IS NOT NULL AND {iso('valid_until')} IS NULL THEN 'valid_until' END, CASE WHEN {nid('parent')} = id THEN 'parent' END], lambda x: x IS NOT NULL) AS b FROM n)
SELECT id, array_to_string(b, ',') AS bad, CAST(len(b) AS INTEGER) AS n_bad FROM c WHERE len(b) > 0""",
)
def validate(s: SparkSession, d: str) -> DataFrame:
    return O.violations(snap(s, d))


@core.query("children_of", f"WITH {SNAP}, k AS (SELECT DISTINCT id AS parent_id, {nid('c')} AS child_id FROM (SELECT id, unnest(children) AS c FROM n)) SELECT parent_id, child_id, kind AS child_kind FROM k JOIN n ON n.id = child_id")
def children_of(s: SparkSession, d: str) -> DataFrame:
    """DM-7: existing children of every node."""
    n = snap(s, d)
    k = n.select(C("id").alias("parent_id"), F.explode("children").alias("c")).select("parent_id", norm_id(C("c")).alias("child_id")).where("child_id is not null").distinct()
    return k.join(n.select(C("id").alias("child_id"), C("kind").alias("child_kind")), "child_id").select("parent_id", "child_id", "child_kind")


@core.query("stats_kinds", f"WITH {SNAP} SELECT kind, count(*) AS n FROM n GROUP BY 1")
def stats_kinds(s: SparkSession, d: str) -> DataFrame:
    return snap(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@core.query("stats_tags", f"WITH {SNAP}, t AS (SELECT unnest(tags) AS tag, seq FROM n) SELECT tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, min(seq), tag LIMIT 20")
def stats_tags(s: SparkSession, d: str) -> DataFrame:
    t = snap(s, d).select(F.explode("tags").alias("tag"), "seq")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(C("n").desc(), "first", "tag").limit(20).drop("first")


@core.query("stats_edges", "WITH e AS (SELECT DISTINCT * FROM edges) SELECT coalesce(rel, 'untyped') AS rel, coalesce(author, 'unknown') AS author, count(*) AS n FROM e GROUP BY ALL")
def stats_edges(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "edges").distinct()
    return e.groupBy(F.coalesce("rel", F.lit("untyped")).alias("rel"), F.coalesce("author", F.lit("unknown")).alias("author")).agg(F.count(F.lit(1)).alias("n"))


@core.query(
    "stats_orphans",
    f"""WITH {SNAP}, {LINKS}, o AS (SELECT id FROM n WHERE id NOT IN (SELECT dst FROM l) AND id NOT IN (SELECT src FROM l) AND {nid('parent')} IS NULL AND coalesce(len(children), 0) = 0)
SELECT (SELECT count(*) FROM o) AS orphans, count(*) AS n, round(100.0 * (SELECT count(*) FROM o) / count(*), 4) AS pct FROM n""",
)
def stats_orphans(s: SparkSession, d: str) -> DataFrame:
    """AG-4: nodes without any link, parent or children."""
    n = snap(s, d)
    links = O.long_links(n)
    linked = links.select(C("src").alias("id")).union(links.select("dst")).distinct().withColumn("linked", F.lit(True))
    flagged = n.select("id", norm_id(C("parent")).alias("p"), F.coalesce(F.size("children"), F.lit(0)).alias("k")).join(linked, "id", "left")
    lonely = C("linked").isNull() & C("p").isNull() & (C("k") <= 0)
    return flagged.agg(F.count_if(lonely).alias("orphans"), F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(lonely) / F.count(F.lit(1)), 4).alias("pct"))


@core.query("stats_weights", f"WITH {SNAP}, w AS (SELECT {weight(1.0)} AS w, lower(trim(claim)) AS key FROM n) SELECT round(min(w), 4) AS w_min, round(max(w), 4) AS w_max, round(avg(w), 4) AS w_mean, round(100.0 * count(*) FILTER (w >= 0.9999) / count(*), 4) AS pct_full, count(key) - count(DISTINCT key) AS dup_nodes FROM w")
def stats_weights(s: SparkSession, d: str) -> DataFrame:
    """AG-5, AG-6."""
    w = snap(s, d).select(S.falsy(C("weight"), 1.0).alias("w"), S.canonical_key(C("claim")).alias("key"))
    per_key = w.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("w").alias("a"), F.max("w").alias("b"), F.sum("w").alias("t"), F.count_if(C("w") >= 0.9999).alias("f"))
    total = F.sum("c")
    return per_key.agg(F.round(F.min("a"), 4).alias("w_min"), F.round(F.max("b"), 4).alias("w_max"), F.round(F.sum("t") / total, 4).alias("w_mean"), F.round(100.0 * F.sum("f") / total, 4).alias("pct_full"), (F.sum(F.when(C("key").isNotNull(), C("c"))) - F.count("key")).alias("dup_nodes"))


@core.query("stats_flags", f"WITH {SNAP} SELECT count(*) FILTER (kind IN ('refuted', 'outdated') OR {NOW} >= {iso('valid_until')}) AS inactive, count(*) FILTER (len(list_filter(coalesce(evidence, []), lambda x: trim(x) <> '')) = 0) AS no_evidence, count(*) FILTER (level > 0) AS quantized, count(*) FILTER (coalesce(level, 0) = 0) AS l0, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, sum(octet_length(encode(coalesce(claim, '')))) AS claim_bytes FROM n")
def stats_flags(s: SparkSession, d: str) -> DataFrame:
    """AG-7."""
    live = S.is_active(C("kind"), C("valid_until"), NOW)
    proofs = F.size(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: F.length(F.btrim(x)) > 0))
    lv = F.coalesce("level", F.lit(0))
    return snap(s, d).agg(F.count_if(~live).alias("inactive"), F.count_if(proofs == 0).alias("no_evidence"), F.count_if(lv > 0).alias("quantized"), F.count_if(lv == 0).alias("l0"), F.count_if(lv == 1).alias("l1"), F.count_if(lv == 2).alias("l2"), F.sum(F.octet_length(F.coalesce("claim", F.lit("")))).alias("claim_bytes"))
