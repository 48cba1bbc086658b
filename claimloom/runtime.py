"""Session helpers shared by every operator: shared storage, tables that cut lineage, id normal form."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The session's ``spark.checkpoint.dir`` decides.  Only a local session without
    that setting gets a folder of its own; a cluster without it is an error, as a
    machine-local folder would be unreadable for the other executors.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="claimloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


_roots: dict[str, str] = {}


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder of the shared one; the whole folder is dropped when the application ends.

    Results read their stages lazily, so none can be dropped before; operators drop what only they read.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/claimloom/{app}"
        atexit.register(_drop_root, app, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex}"


def _drop_root(app: str, jvm: object, conf: object) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(_roots.pop(app))
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have ended first
        return


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does, survives the loss of
    executors, and gives the planner true sizes for the next join.
    """
    path = path or stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="claimloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/claimloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("claimloom") / p.relative_to(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through ``f``, with this package importable wherever it runs."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def norm_id(c: Column) -> Column:
    """Form in which node ids compare: lower case, no outer blanks; a blank id is null."""
    trimmed = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(trimmed) > 0, trimmed)
