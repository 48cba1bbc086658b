"""Logs and sessions: reads, heartbeats, compaction by position (SC-6..9, WN-7, WN-8, WN-12, CX-1..3, ST-9, AG-24).

A session or an agent may hold a third of all rows.  Positions therefore come from counts
per time slot: a prefix sum over the slots of a key (few rows) plus the rank within a slot,
so no key is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def positions(rows: DataFrame, key: str, seconds: Column, tie: str, slot: float = 86400.0) -> DataFrame:
    """``rows`` with ``pos`` (from 1, by time then ``tie``) and ``n`` within ``key``."""
    keyed = rows.withColumn("_t", seconds).withColumn("_slot", F.floor(C("_t") / slot))
    counts = keyed.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_slot", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(key)).alias("n"))
    inner = Window.partitionBy(key, "_slot").orderBy("_t", tie)
    return keyed.withColumn("_r", F.row_number().over(inner)).join(starts, [key, "_slot"]).withColumn("pos", C("_before") + C("_r")).drop("_slot", "_before", "_r")


def bus_read(bus: DataFrame, sender: str | None = None, receiver: str | None = None, kinds: tuple[str, ...] = (), after: str | None = None, before: str | None = None, limit: int | None = None) -> DataFrame:
    """SC-6: messages by sender, receiver (a broadcast to ``all`` meets everyone), kind and inclusive time bounds; the first ``limit``."""
    out = bus
    if sender:
        out = out.where(C("from_id") == sender)
    if receiver:
        out = out.where(C("to_id").isin(receiver, "all", "*"))
    if kinds:
        out = out.where(C("kind").isin(*kinds))
    if after:
        out = out.where(C("ts") >= F.lit(after).cast("timestamp_ntz"))
    if before:
        out = out.where(C("ts") <= F.lit(before).cast("timestamp_ntz"))
    return out if limit is None else out.orderBy("msg_id").limit(limit)


def tail(log: DataFrame, n: int, **equal: str) -> DataFrame:
    """SC-9: the last ``n`` records that match, oldest first."""
    for k, v in equal.items():
        log = log.where(C(k) == v)
    return log.orderBy(C("rec_id").desc()).limit(n).orderBy("rec_id")


def clipped(c: Column, limit: int = 400, marker: str = "…") -> Column:
    """SC-7."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def last_beats(bus: DataFrame) -> DataFrame:
    """AG-24: messages and last heartbeat of each agent."""
    beat = C("kind") == "heartbeat"
    return bus.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(beat).alias("n_beats"), F.coalesce(F.max(F.when(beat, C("msg_id"))), F.lit(-1)).alias("last_beat"))


def heartbeat_gaps(bus: DataFrame, seconds: Column, interval: float = 3600.0) -> DataFrame:
    """WN-7: seconds since the heartbeat before, and whether they reach the interval; the first beat of an agent always does."""
    p = positions(bus.where("kind = 'heartbeat'").select("msg_id", "from_id", seconds.alias("t")), "from_id", C("t"), "msg_id", 30 * 86400.0).select("msg_id", "from_id", "t", "pos")
    before = p.select("from_id", (C("pos") + 1).alias("pos"), C("t").alias("last"))
    gap = F.round(C("t") - C("last"), 3)
    return p.join(before, ["from_id", "pos"], "left").select("msg_id", F.coalesce(gap, F.lit(-1.0)).alias("gap"), (gap.isNull() | (gap >= interval)).alias("due"))


def compact_window(messages: DataFrame, key: str, keep: int = 8) -> DataFrame:
    """CX-2, WN-8: size of each session, and how many of its messages stay as they are."""
    n = messages.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, "n", F.greatest(C("n") - keep, F.lit(0)).alias("n_old"), F.least(C("n"), F.lit(keep)).alias("n_recent"))


def compact_chunks(placed: DataFrame, key: str, keep: int = 8, chunk: int = 3) -> DataFrame:
    """CX-3: chunks of the messages before the window: the fresh half in threes, the old half in sixes; ``placed`` has pos and n."""
    old = C("n") - keep
    mid = F.floor(old / 2)
    i = C("pos") - 1
    rows = placed.where((old > 0) & (i < old)).withColumn("part", F.when(i >= mid, "fresh").otherwise("old"))
    place = F.when(C("part") == "fresh", F.floor((i - mid) / chunk)).otherwise(F.floor(i / (2 * chunk)))
    return rows.withColumn("chunk", place.cast("int")).groupBy(key, "part", "chunk").agg(F.count(F.lit(1)).alias("n_messages"), F.min("rec_id").alias("first_rec"))


def compact_levels(chunks: DataFrame, key: str, cap: int = 6, rounds: int = 12) -> DataFrame:
    """CX-3: summaries of summaries until at most ``cap`` are left: number of levels and of summaries of each session."""
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    fold = f"aggregate(sequence(1, {rounds}), struct(c as cur, c as total, 1 as levels), (a, x) -> if(a.cur > {cap}, struct(ceil(a.cur / {cap}) as cur, a.total + ceil(a.cur / {cap}) as total, a.levels + 1 as levels), a))"
    return c.select(key, F.expr(fold).alias("r")).select(key, C("r.levels").alias("levels"), C("r.total").alias("summaries"))


def preamble(lines: DataFrame, key: str, order: str, text: str, limit: int = 700) -> DataFrame:
    """WN-12: lines of each key in order up to the first that overflows ``limit`` characters.  Every line has a character, so only ``limit`` lines can matter."""
    rows = lines.where(F.length(text) > 0)
    w = Window.partitionBy(key).orderBy(order)
    few = rows.withColumn("r", F.row_number().over(w)).where(C("r") <= limit)
    run = few.withColumn("used", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(C("used") <= limit)
    return run.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.max("used").alias("used"))


def prefix_stability(log: DataFrame, cutoff: str) -> DataFrame:
    """ST-9, CX-7: whether what was known of a session at ``cutoff`` is a prefix of what is known now, by time: no late record lies before a known one."""
    known = C("arrived_at") < F.lit(cutoff).cast("timestamp_ntz")
    per = log.where("session_id is not null").groupBy("session_id").agg(
        F.count_if(known).alias("n_then"), F.count(F.lit(1)).alias("n_now"), F.max(F.when(known, F.struct("ts", "rec_id"))).alias("last"), F.min(F.when(~known, F.struct("ts", "rec_id"))).alias("late")
    )
    return per.select("session_id", "n_then", "n_now", F.coalesce(C("late") > C("last"), F.lit(True)).alias("stable"))
