"""Snapshots and logs on disk (SC-1..5, 7, 10, 12).

A snapshot is a new versioned folder; a small pointer file names the current one, so a
reader never sees half a table and a failed job changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_FIELDS = {
    "seq": "bigint", "id": "string", "kind": "string", "claim": "string", "source": "string", "evidence": "array<string>", "context": "string", "ts": "string",
    "links": "array<string>", "weight": "double", "last_used": "string", "children": "array<string>", "parent": "string", "confidence": "double",
    "valid_until": "string", "tags": "array<string>", "level": "int", "decayed_at": "string",
    "link_meta": "map<string, struct<author: string, ts: string, rel: string, rel_by: string, rel_ts: string>>",
}
NODE_SCHEMA = ", ".join(f"{k} {v}" for k, v in NODE_FIELDS.items())
BUS_FIELDS = {"msg_id": "bigint", "ts": "timestamp", "from_id": "string", "to_id": "string", "kind": "string", "text": "string"}
BUS_SCHEMA = ", ".join(f"{k} {v}" for k, v in BUS_FIELDS.items())


def load_store_json(spark: SparkSession, path: str) -> DataFrame:
    """SC-1, SC-2: one JSON object ``{id: node}`` per file as rows; a corrupt file gives no rows (see `corrupt_files`), non-objects are skipped."""
    row = {k: v for k, v in NODE_FIELDS.items() if k != "seq"}
    kind = "map<string, struct<" + ", ".join(f"{k}: {v}" for k, v in row.items()) + ">>"
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", kind).alias("m")).where("m is not null")
    rows = parsed.select(F.posexplode(F.map_entries("m")).alias("seq", "e")).where("e.value is not null")
    return rows.select(F.col("seq").cast("bigint").alias("seq"), F.coalesce("e.value.id", "e.key").alias("id"), *[F.col(f"e.value.{k}").alias(k) for k in row if k != "id"])


def corrupt_files(spark: SparkSession, path: str) -> DataFrame:
    """SC-2: files that are no JSON object, for the quarantine."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.where(F.try_parse_json("value").isNull() | ~F.btrim("value").startswith("{")).select("file")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save_snapshot(df: DataFrame, base: str) -> str:
    """SC-3: write a new version and swing the pointer to it; returns the version's folder."""
    spark = df.sparkSession
    version = f"{base}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    fs, path = _fs(spark, base)
    fresh = path(f"{base}/CURRENT.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    fs.delete(path(f"{base}/CURRENT"), False)
    fs.rename(fresh, path(f"{base}/CURRENT"))
    return version


def load_snapshot(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{base}/CURRENT").first()[0])


def create_empty(spark: SparkSession, base: str) -> str:
    """SC-4: an empty store; a place that holds anything is refused."""
    fs, path = _fs(spark, base)
    if fs.exists(path(base)) and len(fs.listStatus(path(base))):
        raise FileExistsError(base)
    return save_snapshot(spark.createDataFrame([], NODE_SCHEMA), base)


def append_messages(messages: DataFrame, path: str) -> None:
    """SC-5: validated append to the bus; a message without sender or of another kind stops the batch."""
    if not messages.where("from_id is null or trim(from_id) = '' or kind is null or kind not in ('msg', 'heartbeat', 'duty')").isEmpty():
        raise ValueError("messages need a sender and one of the known kinds")
    messages.select(*[F.col(k).cast(v) for k, v in BUS_FIELDS.items()]).write.mode("append").json(path)


def export_rows(rows: DataFrame, path: str) -> None:
    """SC-10: rows about to be deleted, as JSON lines, before the delete."""
    rows.write.mode("errorifexists").json(path)


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py", ".md", ".json", ".yaml"), max_bytes: int = 1 << 20) -> DataFrame:
    """SC-12: ``(path, content, sha, modified)`` of text files below root; hidden, vendored and large files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("path").endswith(s)
    kept = files.where(wanted & ~F.col("path").rlike(r"/(\.[^/]+|node_modules|venv|__pycache__)/|\.bak"))
    return kept.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("content"), F.sha1("content").alias("sha"), F.col("modificationTime").alias("modified"))
