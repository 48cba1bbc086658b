"""Queries over the logs and sessions (SC-6..9, WN-7, 8, 12, CX-2, 3, ST-9, JN-14, AG-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import code as K
from claimloom.operators import sessions as L
from claimloom.plans.registry import core
from claimloom.plans.sqlbits import BUS, LOG
from claimloom.plans.store import log, seconds
from claimloom.runtime import table

C = F.col


def bus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bus_messages").dropDuplicates(["msg_id"])


@core.query("bus_read", f"WITH {BUS} SELECT msg_id, from_id, kind FROM b WHERE kind IN ('msg', 'duty') AND to_id IN ('ag_moto', 'all', '*') AND ts >= TIMESTAMP '2025-06-01' AND ts <= TIMESTAMP '2026-06-01' ORDER BY msg_id LIMIT 200")
def bus_read(s: SparkSession, d: str) -> DataFrame:
    return L.bus_read(bus(s, d), receiver="ag_moto", kinds=("msg", "duty"), after="2025-06-01", before="2026-06-01", limit=200).select("msg_id", "from_id", "kind")


@core.query("bus_agents", f"WITH {BUS} SELECT from_id, count(*) AS n, count(*) FILTER (kind = 'heartbeat') AS n_beats, coalesce(max(CASE WHEN kind = 'heartbeat' THEN msg_id END), -1) AS last_beat FROM b GROUP BY 1")
def bus_agents(s: SparkSession, d: str) -> DataFrame:
    return L.last_beats(bus(s, d))


@core.query(
    "heartbeat_gaps",
    f"WITH {BUS}, x AS (SELECT msg_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY from_id ORDER BY ts, msg_id), 3) AS gap FROM b WHERE kind = 'heartbeat') SELECT msg_id, coalesce(gap, -1)::DOUBLE AS gap, gap IS NULL OR gap >= 3600 AS due FROM x",
)
def heartbeat_gaps(s: SparkSession, d: str) -> DataFrame:
    return L.heartbeat_gaps(bus(s, d), seconds("ts"))


@core.query("ground_log_tail", f"WITH {LOG} SELECT rec_id, event, coalesce(CASE WHEN length(query) > 24 THEN query[1:24] || '…' ELSE query END, '') AS query FROM (SELECT * FROM g WHERE event = 'prepare' ORDER BY rec_id DESC LIMIT 500)")
def ground_log_tail(s: SparkSession, d: str) -> DataFrame:
    """SC-7, SC-9: the last 500 prepare records, long queries clipped."""
    return L.tail(log(s, d), 500, event="prepare").select("rec_id", "event", F.coalesce(L.clipped(C("query"), 24), F.lit("")).alias("query"))


_MSG = f"{LOG}, m AS (SELECT session_id, rec_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, rec_id) AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM g WHERE session_id IS NOT NULL AND trim(query) <> '')"


def messages(s: SparkSession, d: str) -> DataFrame:
    """CX-1: the questions of a session are its messages."""
    return log(s, d).where("session_id is not null and trim(query) <> ''").select("session_id", "rec_id", "query", seconds("ts").alias("t"))


@core.query("compact_window", f"WITH {_MSG} SELECT session_id, count(*) AS n, greatest(count(*) - 8, 0) AS n_old, least(count(*), 8) AS n_recent FROM m GROUP BY 1")
def compact_window(s: SparkSession, d: str) -> DataFrame:
    return L.compact_window(messages(s, d), "session_id")


_CHUNKS = """o AS (SELECT *, pos - 1 AS i, (n - 8) // 2 AS mid FROM m WHERE n > 8 AND pos <= n - 8), ch AS (SELECT session_id, CASE WHEN i >= mid THEN 'fresh' ELSE 'old' END AS part, CAST(CASE WHEN i >= mid THEN (i - mid) // 3 ELSE i // 6 END AS INTEGER) AS chunk, count(*) AS n_messages, min(rec_id) AS first_rec FROM o GROUP BY ALL)"""


@core.query("compact_buckets", f"WITH {_MSG}, {_CHUNKS} SELECT * FROM ch")
def compact_buckets(s: SparkSession, d: str) -> DataFrame:
    return L.compact_chunks(L.positions(messages(s, d), "session_id", C("t"), "rec_id"), "session_id")


@core.query(
    "compact_levels",
    f"""WITH RECURSIVE {_MSG}, {_CHUNKS}, f(session_id, cur, total, levels) AS (SELECT session_id, count(*), count(*), 1 FROM ch GROUP BY 1 UNION ALL SELECT session_id, (cur + 5) // 6, total + (cur + 5) // 6, levels + 1 FROM f WHERE cur > 6)
SELECT session_id, max(levels) AS levels, max(total) AS summaries FROM f GROUP BY 1""",
)
def compact_levels(s: SparkSession, d: str) -> DataFrame:
    return L.compact_levels(compact_buckets(s, d), "session_id")


@core.query("preamble_cut", f"WITH {BUS}, x AS (SELECT from_id, msg_id, sum(length(text)) OVER (PARTITION BY from_id ORDER BY msg_id) AS used FROM b WHERE text <> '') SELECT from_id, count(*) AS n_lines, max(used)::BIGINT AS used FROM x WHERE used <= 700 GROUP BY 1")
def preamble_cut(s: SparkSession, d: str) -> DataFrame:
    return L.preamble(bus(s, d), "from_id", "msg_id", "text")


@core.query(
    "prefix_stability",
    f"""WITH {LOG}, p AS (SELECT session_id, count(*) FILTER (arrived_at < TIMESTAMP '2026-01-01') AS n_then, count(*) AS n_now, max(CASE WHEN arrived_at < TIMESTAMP '2026-01-01' THEN struct_pack(t := ts, r := rec_id) END) AS last, min(CASE WHEN arrived_at >= TIMESTAMP '2026-01-01' THEN struct_pack(t := ts, r := rec_id) END) AS late FROM g WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session_id, n_then, n_now, coalesce(late > last, true) AS stable FROM p""",
)
def prefix_stability(s: SparkSession, d: str) -> DataFrame:
    return L.prefix_stability(log(s, d), "2026-01-01")


@core.query(
    "manifest_diff",
    """WITH f AS (SELECT url, doc_id, fetched_at, sha1(coalesce(text, '')) AS sha, http_status FROM documents WHERE url IS NOT NULL), a AS (SELECT url, sha FROM f WHERE fetched_at < TIMESTAMP '2026-01-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, doc_id DESC) = 1),
b AS (SELECT url, sha FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, doc_id DESC) = 1) WHERE coalesce(http_status, 200) < 400)
SELECT coalesce(a.url, b.url) AS path, CASE WHEN a.url IS NULL THEN 'new' WHEN b.url IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.url = b.url WHERE a.sha IS DISTINCT FROM b.sha""",
)
def manifest_diff(s: SparkSession, d: str) -> DataFrame:
    """JN-14: pages as files: new, changed and deleted since the start of the year."""
    f = table(s, d, "documents").where("url is not null").select(C("url").alias("path"), F.struct("fetched_at", "doc_id").alias("v"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha"), F.coalesce("http_status", F.lit(200)).alias("status"))
    old = f.where(C("v.fetched_at") < F.lit("2026-01-01").cast("timestamp_ntz")).groupBy("path").agg(F.max_by("sha", "v").alias("sha"))
    new = f.groupBy("path").agg(F.max_by("sha", "v").alias("sha"), F.max_by("status", "v").alias("status")).where("status < 400")
    return K.manifest_diff(old, new)


@core.query("code_symbols")
def code_symbols(s: SparkSession, d: str) -> DataFrame:
    """CD-1 over a literal repository."""
    return K.symbols(K.parsed(K.sample_files(s))).select("qname", "symbol_kind", "file", "line", "signature")


@core.query("resolve_calls")
def resolve_calls(s: SparkSession, d: str) -> DataFrame:
    return K.resolved(K.parsed(K.sample_files(s)))


@core.query("code_callers")
def code_callers(s: SparkSession, d: str) -> DataFrame:
    return K.callers(K.resolved(K.parsed(K.sample_files(s))), "shop.cart.Cart.total")


@core.query("code_search")
def code_search(s: SparkSession, d: str) -> DataFrame:
    return K.search(K.symbols(K.parsed(K.sample_files(s))), K.sample_queries(s))


@core.query("code_callees", "SELECT * FROM (VALUES ('shop.base.Record.save', 'CALLS', 'shop/cart.py'), ('shop.cart.Cart.total', 'CALLS', 'shop/cart.py')) t(target, relation, file)")
def code_callees(s: SparkSession, d: str) -> DataFrame:
    return K.callees(K.resolved(K.parsed(K.sample_files(s))), "shop.cart.Cart.pay")


@core.query("code_methods", "SELECT * FROM (VALUES ('shop.cart.Cart.total'), ('shop.cart.Cart.pay')) t(qname)")
def code_methods(s: SparkSession, d: str) -> DataFrame:
    return K.selected(K.symbols(K.parsed(K.sample_files(s))), "shop/cart.py", "method").select("qname")


@core.query("code_files")
def code_files(s: SparkSession, d: str) -> DataFrame:
    f = K.sample_files(s)
    return K.file_search(K.symbols(K.parsed(f)), f, K.sample_queries(s))


@core.query("code_counters")
def code_counters(s: SparkSession, d: str) -> DataFrame:
    r = K.parsed(K.sample_files(s))
    return K.counters(r, K.resolved(r))
