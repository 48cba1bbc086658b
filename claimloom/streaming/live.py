"""Structured Streaming forms of the logs (ST-1, 2, 3, 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.store_io import BUS_SCHEMA


def bus_stream(spark: SparkSession, path: str) -> DataFrame:
    """ST-1: the bus as a stream of JSON files; torn lines are skipped."""
    return spark.readStream.schema(BUS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def emitted_heartbeats(stream: DataFrame, interval: float = 3600.0) -> DataFrame:
    """ST-2: of each agent's heartbeats those at least ``interval`` seconds after the last one emitted; the state is that one time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for b in batches for x in b["t"].tolist()):
            if last is None or t - last >= interval:
                last = t
                kept.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"from_id": pd.Series([key[0]] * len(kept), dtype=object), "t": pd.Series(kept, dtype="float64")})

    beats = stream.where("kind = 'heartbeat'").select("from_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return beats.groupBy("from_id").applyInPandasWithState(step, "from_id string, t double", "last double", "append", "NoTimeout")


def valid_prepasses(prepares: DataFrame, grounds: DataFrame, ttl: str = "1 hour", late: str = "12 days") -> DataFrame:
    """ST-3: pairs of a ground record and each valid earlier pre-pass of its session, as a join of two streams with watermarks.

    Both need ``(rec_id, session_id, ts timestamp)``; the latest pre-pass of a record is the one with the greatest prepared_at.
    """
    p = prepares.withWatermark("ts", late).select(F.col("session_id").alias("p_session"), F.col("ts").alias("prepared_at"), F.col("rec_id").alias("prepass_id"))
    g = grounds.withWatermark("ts", late)
    return g.join(p, F.expr(f"session_id = p_session and prepared_at < ts and ts <= prepared_at + interval {ttl}")).select("rec_id", "session_id", "prepass_id", "prepared_at")


def usage_counts(stream: DataFrame, late: str = "12 days", window: str = "1 hour") -> DataFrame:
    """ST-6: hits ``(id, ts)`` per node and hour; late ones up to the watermark still count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_hit"))
