import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


NODE = "seq bigint, id string, kind string, claim string, source string, evidence array<string>, context string, ts string, links array<string>, weight double, last_used string, children array<string>, parent string, confidence double, valid_until string, tags array<string>, level int, arrived_at timestamp_ntz, extra string"


@pytest.fixture(scope="session")
def make_nodes(spark):
    """Rows of nodes from dictionaries; what is left out gets a plain default."""
    from datetime import datetime

    names = [f.split()[0] for f in NODE.split(", ")]

    def make(*rows):
        base = {"kind": "fact", "claim": "", "source": "note", "evidence": [], "context": "", "ts": "2026-06-30T00:00:00Z", "links": [], "weight": 1.0, "last_used": None, "children": [], "parent": None, "confidence": 0.5, "valid_until": None, "tags": [], "level": 0, "arrived_at": datetime(2026, 6, 30), "extra": "x"}
        data = [tuple({**base, "seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, NODE)

    return make
