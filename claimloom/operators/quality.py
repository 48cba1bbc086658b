"""Row checks P1-P6, gates G1-G5 and token joins for near-duplicate and contrary claims (TG, GT, JN-5, 6, 9, 11, 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators.store import long_links
from claimloom.runtime import map_batches, norm_id, staged

C = F.col
DUPLICATE, CONTRARY = 0.55, 0.30
#: share of sets from which on the number of meetings at a token is broadcast
RARE_FROM = 1e-4


def truth_gate(snap: DataFrame, now: float) -> DataFrame:
    """TG-1..7: six checks, their number and the verdict (pass from four on)."""
    raw = snap.select("id", F.explode("links").alias("raw")).select("id", norm_id(C("raw")).alias("dst"))
    kinds = snap.select(C("id").alias("dst"), C("kind").alias("k"))
    broken = raw.join(kinds, "dst", "left").groupBy("id").agg(F.max(C("dst").isNull() | F.coalesce(C("k") == "refuted", F.lit(False))).alias("broken"))
    ts = S.iso_seconds(C("ts"))
    filled = lambda c: F.length(F.btrim(F.coalesce(c, F.lit("")))) > 0
    proofs = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), filled)
    p = {
        "p1": F.coalesce((ts <= now + 300) & (ts >= now - 365 * 86400), F.lit(False)),
        "p2": filled(C("source")),
        "p3": F.coalesce(C("claim").rlike(r"\p{Nd}"), F.lit(False)),
        "p4": ~F.coalesce("broken", F.lit(False)),
        "p5": F.coalesce(proofs, F.lit(False)),
        "p6": filled(C("context")),
    }
    score = sum((c.cast("int") for c in p.values()), F.lit(0))
    rows = snap.join(broken, "id", "left").select("id", *[c.alias(k) for k, c in p.items()], score.alias("score"))
    return rows.withColumn("verdict", F.when(C("score") >= 4, "pass").otherwise("fail"))


def confidence_gate() -> Column:
    """GT-1 as a column over claim, kind, source and confidence."""
    low = F.lower(F.coalesce("claim", F.lit("")))
    c = F.lit(0.75)
    c = F.when(S.any_of(low, S.HEDGES), F.least(c, F.lit(0.35))).otherwise(c)
    c = F.when(S.any_of(low, S.CERTAIN), F.greatest(c, F.lit(0.85))).otherwise(c)
    c = F.when(F.length(F.btrim(F.coalesce("source", F.lit("")))) == 0, F.least(c, F.lit(0.25))).otherwise(c)
    conf = F.coalesce("confidence", c)
    return F.when(C("kind") == "hypothesis", "pass").when(conf < 0.30, "reject").when(conf < 0.50, "flag").otherwise("pass")


def staleness_gate(now: float) -> Column:
    """GT-2 without subjects, as both pipelines of the survey call it: 7 days for volatile topics, else 365."""
    ts = S.iso_seconds(C("ts"))
    days = F.when(S.any_of(F.lower(F.coalesce("claim", F.lit(""))), S.VOLATILE), 7).otherwise(365)
    return F.when(ts.isNull() | (F.lit(now) - ts > days * 86400), "reject").otherwise("pass")


def recency_conflicts(snap: DataFrame) -> DataFrame:
    """JN-9: rows for whose subject (first two gate tokens) a newer row says something else."""
    rows = snap.select("id", "seq", "claim", S.iso_seconds(C("ts")).alias("t"), F.array_join(F.slice(S.gate_tokens(C("claim")), 1, 2), " ").alias("subject")).where("t is not null and subject <> ''")
    newest = rows.groupBy("subject").agg(F.max(F.struct("t", "seq", "claim", "id")).alias("top"))
    return rows.join(newest, "subject").where((C("top.t") > C("t")) & (C("top.claim") != C("claim"))).select("id", "subject", C("top.id").alias("newer_id"))


def source_gate(snap: DataFrame) -> DataFrame:
    """GT-3: tier of the source, and whether a link leads to a fact of tier C."""
    bad = snap.where((S.source_tier(C("source")) == "C") & (C("kind") == "fact")).select(C("id").alias("dst"))
    first = long_links(snap).join(bad, "dst").groupBy(C("src").alias("id")).agg(F.min(F.struct("pos", "dst")).alias("b"))
    t = S.source_tier(C("source"))
    verdict = F.when(C("b").isNotNull(), "reject").when((t == "C") & (C("kind") == "fact"), "reject").when(t == "C", "flag").otherwise("pass")
    return snap.join(first, "id", "left").select("id", t.alias("tier"), F.coalesce("b.dst", F.lit("")).alias("bad_link"), verdict.alias("verdict"))


def relevance_gate(snap: DataFrame, queries: DataFrame, threshold: float = 2.0) -> DataFrame:
    """GT-5 for every stated query ``(qid, q)`` against all rows: substring hits of its tokens, 3 in claim, 1.5 in context, 1 in source."""
    q = F.broadcast(queries.select("qid", S.gate_tokens(C("q")).alias("qt")))
    rows = snap.select("id", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("claim", "context", "source")])
    hits = lambda c: F.aggregate("qt", F.lit(0), lambda acc, t: acc + F.contains(C(c), t).cast("int"))
    score = 3.0 * hits("claim") + 1.5 * hits("context") + 1.0 * hits("source")
    # The query set is stated and small; any token of a query must occur, so rows meet queries through an existence test, not pairs of rows.
    return rows.join(q, F.exists("qt", lambda t: F.contains(C("claim"), t) | F.contains(C("context"), t) | F.contains(C("source"), t))).select("qid", "id", F.round(score, 6).alias("score"), F.when(score < threshold, "reject").otherwise("pass").alias("verdict"))


def claim_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets ``(e, side, w)`` with token similarity >= threshold, by an exact prefix-filter join (JN-5, JN-6, §4.3).

    ``w`` holds distinct token hashes.  The result ``(a, b)`` has every pair once: with a < b where ``side`` is null, else a
    with ``side`` true and b with false.  Tokens are ordered from those whose rows meet seldom to those that meet often; two
    sets above the threshold share a token among their first n - ceil(t * n) + 1.  A row of this prefix carries a bitmap
    of the tokens from its own on.  At their first common token two similar sets have all common tokens in these, so most
    meetings end in the join; the rest is verified by all tokens.  Only the counts of frequent tokens, from RARE_FROM of all
    sets on, are broadcast; these are at most (tokens a set) / RARE_FROM, whatever the number of sets.
    """
    spark, least = sets.sparkSession, threshold - 5e-7  # similarity counts as rounded to six places
    floor = max(1, int(RARE_FROM * sets.count()))
    count = F.count(F.lit(1))
    cost = F.when(F.count("side") > 0, F.count_if(C("side")) * F.count_if(~C("side"))).otherwise(count)
    known = sets.select("side", F.explode("w").alias("w")).groupBy("w").agg(count.alias("n"), cost.alias("cost"))
    known = known.where(C("n") > floor).select("w", "cost").toArrow()
    order = np.argsort(known.column("w").to_numpy())
    table = spark.sparkContext.broadcast((known.column("w").to_numpy()[order], known.column("cost").to_numpy()[order].astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, costs = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("w")
            flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            cost = np.zeros(len(flat), np.int64)
            if len(words):
                i = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                cost = np.where(words[i] == flat, costs[i], 0)
            flat = flat[np.lexsort((flat, cost, owner))]
            pos = np.arange(len(flat)) - starts[owner]
            bit = flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
            own = np.where((bit >> np.uint64(6))[:, None] == np.arange(4, dtype=np.uint64), (np.uint64(1) << (bit & np.uint64(63)))[:, None], np.uint64(0))
            # From the last token of each set to the first, the tokens behind join in.
            for back in range(1, int(size.max())):
                at = (starts + size - 1 - back)[size > back]
                own[at] |= own[at + 1]
            kept = pos < (size - np.ceil(size * least - 1e-9) + 1)[owner]
            who = owner[kept]
            columns = [pa.array(flat[kept]), batch.column("e").take(pa.array(who)), pa.array(size[who].astype(np.int32)), pa.array((size[who] - pos[kept]).astype(np.int32)), *[pa.array(own[kept, k].view(np.int64)) for k in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "e", "n", "rest", "b0", "b1", "b2", "b3"])

    schema = "t bigint, e bigint, n int, rest int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
    side = lambda x: map_batches(sets.where(x).select("e", "w"), prefixes, schema)
    one, other = side("side is null or side"), side("side is null or not side")
    other = other.select("t", *[C(c).alias(f"{c}_o") for c in other.columns if c != "t"])
    share = (C("n") + C("n_o")) * (least / (1 + least)) - 1e-6
    differ = sum((F.bit_count(C(f"b{k}").bitwiseXOR(C(f"b{k}_o"))) for k in range(4)), F.lit(0))
    near = (F.least("rest", "rest_o") >= share) & (C("rest") + C("rest_o") - differ >= 2 * share)
    # Merge joins, as either side grows with the corpus and must never be sent to the driver.
    met = one.hint("merge").join(other, "t")
    met = met.where(near).select(C("e").alias("a"), C("e_o").alias("b"))
    pairs = met.where("a < b").distinct() if sets.where("side is not null").isEmpty() else met.distinct()
    of = lambda x, name, w: sets.where(x).select(C("e").alias(name), C("w").alias(w))
    both = pairs.hint("merge").join(of("side is null or side", "a", "wa"), "a").hint("merge").join(of("side is null or not side", "b", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(F.round(common / (F.size("wa") + F.size("wb") - common), 6) >= threshold).select("a", "b")


def claim_facets(snap: DataFrame) -> DataFrame:
    """``(id, seq, kind, weight, w, cid, neg, salient)`` of rows with tokens, written once for all joins that follow; ``w`` are token hashes, ``salient`` is a hash."""
    tokens = F.array_sort(F.array_distinct(F.transform(S.content_tokens(C("claim")), lambda t: F.xxhash64(t))))
    rows = snap.select("id", "seq", "kind", S.falsy(C("weight"), 1.0).alias("weight"), tokens.alias("w"), S.has_negation(C("claim")).alias("neg"), F.xxhash64(S.salient(C("claim"))).alias("salient"))
    # Rows without tokens go after the write: a filter before it would make all tokens twice.
    return staged(rows.withColumn("cid", F.xxhash64("w")), "facets").where(F.size("w") > 0)


def gate_duplicates(snap: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """JN-5: each row with an earlier duplicate (similarity >= .55, same polarity, same salient set): the earliest one and their number of classes.

    Rows are folded to (class, polarity, salient set) first, so copies are never paired with each other.  Polarity and
    salient set are part of every token, so only rows that agree in both meet.
    """
    f = claim_facets(snap) if facets is None else facets
    e = F.xxhash64("cid", "neg", "salient")
    kinds = staged(f.groupBy(e.alias("e"), F.xxhash64("neg", "salient").alias("g")).agg(F.min(F.struct("seq", "id")).alias("first"), F.first("w").alias("w")), "kinds")
    shared = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    sets = staged(kinds.hint("merge").join(shared, "g", "left_semi").select("e", F.lit(None).cast("boolean").alias("side"), F.transform("w", lambda t: F.xxhash64(t, "g")).alias("w")), "sets")
    pairs = staged(claim_pairs(sets, DUPLICATE), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    linked = both.hint("merge").join(kinds.select(C("e").alias("b"), C("first").alias("f")), "b").groupBy(C("a").alias("e")).agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n"))
    best = kinds.select("e", "first").hint("merge").join(linked, "e", "left").select("e", F.least("first", "f").alias("dup"), F.coalesce("n", F.lit(0)).alias("n_similar"))
    return f.select("id", "seq", e.alias("e")).hint("merge").join(best, "e").where(C("dup.seq") < C("seq")).select("id", C("dup.id").alias("duplicate_of"), "n_similar")


def gate_contrary(snap: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """JN-6: rows with a claim of opposite polarity at similarity >= .30: the earliest such row (by seq) and its standing."""
    f = claim_facets(snap) if facets is None else facets
    kinds = staged(f.groupBy(C("cid").alias("e"), C("neg").alias("side")).agg(F.min(F.struct("seq", "id", "kind", "weight")).alias("f"), F.first("w").alias("w")), "kinds")
    # Only claims of opposite polarity meet; few claims are negative.
    pairs = staged(claim_pairs(kinds.select("e", "side", "w"), CONTRARY), "pairs")
    ends = pairs.select("a", "b", F.lit(False).alias("there")).union(pairs.select("b", "a", F.lit(True).alias("there"))).toDF("cid", "e", "side")
    linked = ends.hint("merge").join(kinds.select("e", "side", "f"), ["e", "side"]).groupBy("cid", (~C("side")).alias("neg")).agg(F.min("f").alias("f"))
    return f.select("id", "cid", "neg").hint("merge").join(linked, ["cid", "neg"]).select("id", C("f.id").alias("against"), F.when((C("f.kind") == "fact") & (C("f.weight") >= 0.5), "strong").otherwise("weak").alias("standing"))


def consistency_gate(snap: DataFrame) -> DataFrame:
    """GT-4 with batch semantics: duplicates among earlier rows are rejected, contrary claims of strong facts too, of weak rows flagged."""
    f = claim_facets(snap)
    d, c = gate_duplicates(snap, f).select("id", "duplicate_of"), gate_contrary(snap, f)
    refutes = (C("kind") == "refuted") & (F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0)
    j = snap.select("id", "kind", "evidence").join(d, "id", "left").join(c, "id", "left")
    verdict = F.when(C("duplicate_of").isNotNull(), "reject").when(C("standing") == "strong", F.when(refutes, "pass").otherwise("reject")).when(C("standing") == "weak", "flag").otherwise("pass")
    return j.select("id", verdict.alias("verdict"), F.coalesce("duplicate_of", "against", F.lit("")).alias("other_id"))


def gated(snap: DataFrame, now: float) -> DataFrame:
    """GT-6: ``(id, gate, verdict, other_id)``: G1, G3, G4, G2 in this order, the first that does not pass decides; other_id is what G4 found."""
    g3 = source_gate(snap).select("id", C("verdict").alias("g3"))
    g4 = consistency_gate(snap).select("id", C("verdict").alias("g4"), "other_id")
    j = snap.select("id", confidence_gate().alias("g1"), staleness_gate(now).alias("g2")).join(g3, "id").join(g4, "id")
    first = lambda pick: F.coalesce(*[F.when(C(g) != "pass", pick(g)) for g in ("g1", "g3", "g4", "g2")])
    return j.select("id", F.coalesce(first(lambda g: F.lit(g)), F.lit("")).alias("gate"), F.coalesce(first(lambda g: C(g)), F.lit("pass")).alias("verdict"), "other_id")


def write_gates(snap: DataFrame, now: float) -> DataFrame:
    return gated(snap, now).drop("other_id")
