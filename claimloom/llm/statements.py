"""Duplicates hidden by formatting differences (problem 1).

A claim's plain form is its letters, marks and digits without letter case; a full
stop or comma counts only between two digits.  A list of labelled fields has a second
form, its set of fields.  Both are hashed to 128 bits (MD5) with an independent 64-bit
check, and groups are aggregated with map-side combining: a group never travels as
rows, however large it is.  Two texts whose 128 bits collide keep different checks and
so stay different groups.

Null claims and claims without a letter, mark or digit state nothing and have no rows.
Rows delivered again count once, ties are broken by the smaller id, extra columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.runtime import norm_id

IGNORED = r"(?<!\p{N})[.,]|[.,](?!\p{N})|[^\p{L}\p{M}\p{N}.,]"
#: label, then ":", "=" or "->", then a value that holds a letter or digit
FIELD = r"(?s)^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{M}\p{N}_ .-]*?)\s*(?::|=|->|→)\s*(.*[\p{L}\p{N}].*)$"
#: what FIELD takes for the first label, however long, read once without going back: a "-" before ">" may stand in the label's own run
MAYBE_LIST = r"(?s)^[^\p{L}\p{N}]*+\p{L}[\p{L}\p{M}\p{N}_ .-]*+\s*+(?::|=|→|->|(?<=-)>).*[;|,\r\n]"


def fold(c: Column) -> Column:
    """Full case folding: upper case first, so that ß equals SS and final sigma equals sigma; dotless i stays itself."""
    upper = F.replace(F.upper(F.translate(c, "\u0131", "\ue000")), F.lit("\u1e9e"), F.lit("SS"))
    return F.lower(upper)


def plain_form(c: Column) -> Column:
    return fold(F.regexp_replace(c, IGNORED, ""))


def field_form(c: Column) -> Column:
    """Sorted distinct ``label=value`` in plain form for a list of at least two labelled fields, else null.

    Fields are parted by ";" or "|" or line breaks, by ";" or "|" alone (a line break may stand inside
    a value), or by commas that are not between digits: whichever gives the most fields.
    """

    def way(separator: str, rank: int) -> Column:
        parts = F.filter(F.split(c, separator), lambda s: s.rlike(r"[\p{L}\p{N}]"))
        one = F.transform(parts, lambda s: F.concat(plain_form(F.regexp_extract(s, FIELD, 1)), F.lit("\x1f"), plain_form(F.regexp_extract(s, FIELD, 2))))
        whole = (F.size(parts) >= 2) & F.forall(parts, lambda s: s.rlike(FIELD))
        return F.when(whole, F.struct(F.size(parts).alias("n"), F.lit(rank).alias("rank"), F.array_join(F.array_sort(F.array_distinct(one)), "\x1e").alias("key")))

    ways = F.array_compact(F.array(way(r"[;|\r\n]+", 3), way(r"[;|]+", 2), way(r",(?!\p{N})|(?<!\p{N}),", 1)))
    return F.when(c.rlike(MAYBE_LIST), F.array_max(ways)["key"])


def hash128(c: Column) -> Column:
    """128-bit hash and an independent check in one key, so a collision of the hash can't join two texts."""
    return F.concat(F.unhex(F.md5(c)), F.unhex(F.lpad(F.hex(F.xxhash64(c)), 16, "0")))


def statement_keys(nodes: DataFrame, id_col: str = "id", text_col: str = "claim") -> DataFrame:
    """``(id, plain, fields)``: hashes of both forms for each node that states something."""
    plain = plain_form(F.col(text_col))
    rows = nodes.select(norm_id(F.col(id_col)).alias("id"), plain.alias("plain"), field_form(F.col(text_col)).alias("fields"))
    rows = rows.where("id is not null and plain <> ''")
    return rows.select("id", hash128(F.col("plain")).alias("plain"), hash128(F.col("fields")).alias("fields"))


def statement_groups(keys: DataFrame) -> DataFrame:
    """``(plain, key)``-level aggregates: key joins plain forms that have the same set of fields."""
    by_plain = keys.groupBy("plain").agg(F.min("fields").alias("fields"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    return by_plain.select("plain", F.coalesce("fields", "plain").alias("key"), "lo", "hi")


def statements(nodes: DataFrame) -> DataFrame:
    """Each statement once: ``(first_id, n_ids, n_forms)``; n_forms counts the different raw claims.

    Counting distinct ids first by (key, id) keeps a group that holds a third of all rows spread over all tasks.
    """
    rows = nodes.select("id", "claim", F.xxhash64("claim").alias("raw"))
    keyed = rows.select(norm_id(F.col("id")).alias("id"), "raw", hash128(plain_form(F.col("claim"))).alias("plain"), hash128(field_form(F.col("claim"))).alias("fields"), (F.length(plain_form(F.col("claim"))) > 0).alias("ok")).where("ok and id is not null")
    by_plain = keyed.groupBy("plain").agg(F.min("fields").alias("f"))
    listed = by_plain.where("f is not null")
    with_key = keyed.join(listed, "plain", "left").select(F.coalesce("f", "plain").alias("key"), "id", "raw")
    by_id = with_key.groupBy("key", "id").agg(F.min("raw").alias("raw"))
    by_raw = by_id.groupBy("key", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    return by_raw.groupBy("key").agg(F.min("lo").alias("first_id"), F.sum("n").alias("n_ids"), F.count(F.lit(1)).alias("n_forms")).drop("key")


def statement_copies(nodes: DataFrame) -> DataFrame:
    """``(first_id, copy_id)`` for each id other than the smallest of its group of equal claims."""
    keys = statement_keys(nodes)
    groups = statement_groups(keys)
    firsts = groups.groupBy("key").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id")).where("first_id < last_id")
    # Only groups with a copy go on: they are few, and each plain form once.
    mapping = groups.join(firsts, "key").select("plain", "first_id")
    return keys.select("plain", "id").join(mapping, "plain").where("id > first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
