import json
from datetime import datetime as dt
from datetime import timedelta

import pytest
from claimloom.sources import store_io as IO
from claimloom.streaming import live


def test_json_store_and_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"mn_1": {"id": "mn_1", "claim": "x", "links": ["mn_2"]}, "mn_2": {"claim": "y", "weight": 0.5}}))
    (tmp_path / "in/b.json").write_text("{broken")
    rows = {r.id: r for r in IO.load_store_json(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"mn_1", "mn_2"} and rows["mn_1"].links == ["mn_2"] and rows["mn_2"].weight == 0.5
    assert [r.file.endswith("b.json") for r in IO.corrupt_files(spark, str(tmp_path / "in")).collect()] == [True]


def test_snapshots(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    IO.create_empty(spark, base)
    assert IO.load_snapshot(spark, base).count() == 0
    with pytest.raises(FileExistsError):
        IO.create_empty(spark, base)
    old = IO.load_snapshot(spark, base)
    IO.save_snapshot(spark.createDataFrame([(1, "a")], "seq bigint, id string"), base)
    assert IO.load_snapshot(spark, base).count() == 1 and old.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "src/.git").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/.git/b.py").write_text("x = 1")
    (tmp_path / "src/c.bin").write_text("x")
    (tmp_path / "src/d.py").write_text("y" * 300)
    got = IO.source_files(spark, str(tmp_path / "src"), max_bytes=200).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in got] == [("a.py", "x = 1")]


def test_bus_and_heartbeats(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    at = lambda m: dt(2026, 1, 1, 0, m)
    rows = [(1, at(0), "a", "all", "heartbeat", ""), (2, at(5), "a", "all", "heartbeat", ""), (3, at(11), "a", "all", "heartbeat", ""), (4, at(6), "b", "all", "heartbeat", ""), (5, at(7), "a", "b", "msg", "hi")]
    IO.append_messages(spark.createDataFrame(rows, IO.BUS_SCHEMA), path)
    with pytest.raises(ValueError):
        IO.append_messages(spark.createDataFrame([(9, at(1), " ", "a", "msg", "x")], IO.BUS_SCHEMA), path)
    q = live.emitted_heartbeats(live.bus_stream(spark, path), 600).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert {(r.from_id, r.t % 3600 / 60) for r in spark.table("beats").collect()} == {("a", 0.0), ("a", 11.0), ("b", 6.0)}
    finally:
        q.stop()


def drained(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").start()
    try:
        q.processAllAvailable()
        return stream.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_prepasses_expire(spark, tmp_path):
    """A pre-pass counts for later records of its own session within the hour."""
    at = lambda m: dt(2026, 1, 1, 0, 0) + timedelta(minutes=m)
    schema = "rec_id bigint, session_id string, ts timestamp"
    spark.createDataFrame([(1, "s", at(0)), (2, "s", at(30)), (3, "t", at(0)), (4, None, at(0))], schema).write.json(f"file://{tmp_path}/prepare")
    spark.createDataFrame([(10, "s", at(40)), (11, "s", at(70)), (12, "s", at(200)), (13, "t", at(0)), (14, None, at(1))], schema).write.json(f"file://{tmp_path}/ground")
    read = lambda x: spark.readStream.schema(schema).json(f"file://{tmp_path}/{x}")
    got = {(r.rec_id, r.prepass_id) for r in drained(live.valid_prepasses(read("prepare"), read("ground")), "prepasses", tmp_path)}
    assert got == {(10, 1), (10, 2), (11, 2)}


def test_usage_counts_with_late_and_repeated_hits(spark, tmp_path):
    at = lambda m: dt(2026, 1, 1, 0, 0) + timedelta(minutes=m)
    rows = [("a", at(5)), ("a", at(50)), ("a", at(65)), ("b", at(5)), ("a", at(5)), (None, at(1))]
    spark.createDataFrame(rows, "id string, ts timestamp").write.json(f"file://{tmp_path}/hits")
    hits = spark.readStream.schema("id string, ts timestamp").json(f"file://{tmp_path}/hits")
    got = {(r.id, r.window.start.minute + 60 * r.window.start.hour, r.n) for r in drained(live.usage_counts(hits), "usage", tmp_path, "update")}
    assert got == {("a", 0, 3), ("a", 60, 1), ("b", 0, 1), (None, 0, 1)}
