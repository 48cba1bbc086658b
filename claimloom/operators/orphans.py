"""References to records that do not exist, by a broadcast Bloom filter and an exact join (problem 6).

The filter holds every key of nodes and tombstones.  A reference that misses it is a
definite orphan and is reported without a join; the others are verified by an exact
join.  Its size follows the number of keys up to a fixed bound (8 MB); beyond that it
answers "maybe" more often, and the exact join decides more references.

Null and blank references don't count; repeated ones count once; extra columns are
ignored; empty tables give no rows.  A parent without arrival time can't be late.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.runtime import norm_id, staged

MAX_BLOOM_BITS = 1 << 26
PROBES = 4


def _positions(key: Column, bits: int) -> list[Column]:
    """Double hashing: PROBES bit positions; both hashes are reduced first, so that no sum overflows."""
    a, b = F.pmod(F.xxhash64(key), F.lit(bits).cast("long")), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(bits).cast("long"))
    return [F.pmod(a + F.lit(i).cast("long") * b, F.lit(bits).cast("long")) for i in range(PROBES)]


def bloom_words(keys: DataFrame, key: str, expected: int, max_bits: int = MAX_BLOOM_BITS) -> tuple[DataFrame, int]:
    """One row with the filter as an array of longs, and its number of bits (16 a key, at most ``max_bits``)."""
    bits = min(max_bits, max(1 << 14, 1 << math.ceil(math.log2(max(1, expected) * 16))))
    set_bits = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    full = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "w").join(words, "w", "left")
    return full.agg(F.expr("transform(array_sort(collect_list(struct(w, coalesce(v, 0L) as v))), x -> x.v)").alias("words")), bits


def might_contain(words: Column, key: Column, bits: int) -> Column:
    hit = F.lit(True)
    for p in _positions(key, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = hit & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


def references(nodes: DataFrame, edges: DataFrame, ground_log: DataFrame) -> DataFrame:
    """Distinct ``(ref_table, ref_key, target_id, ref_at)``; ref_at is the first arrival of the referring record."""

    def of(df: DataFrame, table: str, key: Column, targets: Column) -> DataFrame:
        rows = df.select(key.cast("string").alias("ref_key"), targets.alias("targets"), "arrived_at").where("ref_key is not null")
        # Redelivered rows have the same content, so the first arrival of each reference is that of its record.
        return rows.select("ref_key", F.explode(F.array_distinct(F.transform("targets", norm_id))).alias("target_id"), "arrived_at").where("target_id is not null").withColumn("ref_table", F.lit(table))

    every = (
        of(nodes, "nodes", norm_id(F.col("id")), F.col("links"))
        .unionByName(of(edges, "edges", F.col("edge_id"), F.array("src", "dst")))
        .unionByName(of(ground_log, "ground_log", F.col("rec_id"), F.col("node_ids")))
    )
    return every.groupBy("ref_table", "ref_key", "target_id").agg(F.min("arrived_at").alias("ref_at"))


def parents(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``(target_id, first_at, last_at, deleted_at, is_node)`` for every id of nodes and tombstones."""
    alive = nodes.select(norm_id(F.col("id")).alias("target_id"), F.col("arrived_at").alias("at"), F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(True).alias("is_node"))
    gone = tombstones.select(norm_id(F.col("id")).alias("target_id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("deleted_at").alias("gone"), F.lit(False).alias("is_node"))
    return (
        alive.unionByName(gone)
        .where("target_id is not null")
        .groupBy("target_id")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("gone").alias("deleted_at"), F.max("is_node").alias("is_node"))
    )


def orphan_references(nodes: DataFrame, edges: DataFrame, ground_log: DataFrame, tombstones: DataFrame, max_bits: int = MAX_BLOOM_BITS) -> DataFrame:
    """One row for each distinct reference to a target that is missing, deleted or arrived later."""
    known = staged(parents(nodes, tombstones), "parents")
    words, bits = bloom_words(known, "target_id", known.count(), max_bits)
    words = staged(words, "bloom")
    refs = references(nodes, edges, ground_log)
    tested = refs.withColumn("maybe", might_contain(words.scalar(), F.col("target_id"), bits))
    right = known.withColumnRenamed("target_id", "known_id")
    positive = tested.where("maybe").join(right, F.col("target_id") == F.col("known_id"), "left")
    status = (
        F.when(F.col("known_id").isNull(), F.lit("missing"))
        .when(~F.col("is_node") | (F.col("deleted_at") > F.col("last_at")), F.lit("deleted"))
        .when(F.col("first_at") > F.col("ref_at"), F.lit("late"))
    )
    out = ["ref_table", "ref_key", "target_id", "status", F.date_format("ref_at", "yyyy-MM").alias("period")]
    verified = positive.withColumn("status", status).where("status is not null").select(*out)
    definite = tested.where("not maybe").withColumn("status", F.lit("missing")).select(*out)
    return verified.unionByName(definite)


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphan references per table, month and status."""
    return found.groupBy("ref_table", "period", "status").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("target_id").alias("n_targets"))
