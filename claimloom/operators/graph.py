"""Graph queries over typed edges ``(src, dst, rel, author)`` (GR-*, AG-16, AG-17).

All results are rows.  Distances are searched in tasks of 64 sources each over one broadcast
adjacency, so that rows of pairs are made only where they are written; a graph too large for
that is searched by joins of a frontier with the edges, staged after every step.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators.search import node_text
from claimloom.runtime import map_batches, norm_id, stage_path, staged

C = F.col
ROUTERS = ("sys_cmd", "persona_def", "world_state")
#: Directed edges and sources up to which distances broadcast the graph; a worker then holds about 400 MB at most.
LOCAL_PAIRS, LOCAL_SOURCES = 1 << 23, 1 << 20
#: Sources searched at once (the bits of a word), and rows of a batch.
WIDTH, BATCH = 64, 8192


def resolved(edges: DataFrame, snap: DataFrame) -> DataFrame:
    """Distinct ``(src, dst, rel)`` whose ends exist."""
    ids = snap.select("id")
    e = edges.select("src", "dst", "rel").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbours(edges: DataFrame, snap: DataFrame, of: DataFrame) -> DataFrame:
    """GR-1: existing neighbours of the ids in ``of(id)`` with relation and direction."""
    e = resolved(edges, snap)
    out = e.join(of.select(C("id").alias("src")), "src", "left_semi").select(C("src").alias("id"), C("dst").alias("neighbour"), "rel", F.lit("out").alias("direction"))
    inc = e.join(of.select(C("id").alias("dst")), "dst", "left_semi").select(C("dst").alias("id"), C("src").alias("neighbour"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(inc)


def distances(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """GR-2: smallest number of undirected edges from each source ``(id)`` to every node it reaches, or to those within ``max_hops``."""
    root = stage_path(edges.sparkSession, "distances")
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    adj = staged(e.union(e.select("dst", "src")).distinct(), "adjacency", f"{root}/adjacency")
    ends = adj.select(C("src").alias("id"), F.lit(0).alias("asked")).union(sources.where("id is not null").select("id", F.lit(1)))
    ids = staged(ends.groupBy("id").agg(F.max("asked").alias("asked")), "ids", f"{root}/ids")
    n = ids.where("asked = 1").count()
    if adj.count() <= LOCAL_PAIRS and n <= LOCAL_SOURCES:
        return _distances_by_source(adj, ids, n, root, max_hops)
    return _distances_by_joins(adj, ids.where("asked = 1").select("id"), root, max_hops)


def _distances_by_joins(adj: DataFrame, sources: DataFrame, root: str, max_hops: int | None) -> DataFrame:
    """Rows of the frontier join the edges, hop by hop; what was seen is staged."""
    spark = adj.sparkSession
    front = staged(sources.select(C("id").alias("source"), C("id").alias("node"), F.lit(0).alias("hops")), "front", f"{root}/seen/0")
    for h in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        seen = spark.read.schema("source string, node string, hops int").option("recursiveFileLookup", True).parquet(f"{root}/seen")
        step = front.join(adj, C("node") == C("src")).select("source", C("dst").alias("node"), F.lit(h).alias("hops")).distinct()
        front = staged(step.join(seen, ["source", "node"], "left_anti"), "front", f"{root}/seen/{h}")
        if front.isEmpty():
            break
    return spark.read.schema("source string, node string, hops int").option("recursiveFileLookup", True).parquet(f"{root}/seen")


def _distances_by_source(adj: DataFrame, ids: DataFrame, n: int, root: str, max_hops: int | None) -> DataFrame:
    """Breadth-first searches of ``WIDTH`` sources at once in each task; the ``n`` sources have the first numbers."""
    spark = adj.sparkSession
    order = F.row_number().over(Window.orderBy(C("asked").desc(), "id")) - 1
    numbered = staged(ids.select("id", "asked", order.alias("no")), "numbered", f"{root}/numbered")
    u, v = (numbered.select(C("id").alias(end), C("no").alias(no)) for end, no in (("src", "u"), ("dst", "v")))
    pairs = adj.join(u, "src").join(v, "dst").select("u", "v").toArrow()
    names = numbered.orderBy("no").select("id").toArrow().column("id").combine_chunks()
    starts, by = pairs.column("u").to_numpy(), np.argsort(pairs.column("u").to_numpy(), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(names)))]).astype(np.int32)
    to = pairs.column("v").to_numpy()[by]
    shared = spark.sparkContext.broadcast((names, first, to, np.argsort(_parts(first, to)[:n], kind="stable").astype(np.int32)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, to, order = shared.value
        for base in (x for b in batches for x in b.column(0).to_pylist()):
            asked = order[base : base + WIDTH]
            for nodes, hops, bits in _in_batches(levels(first, to, asked, max_hops)):
                flags = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
                at = np.concatenate([[0], np.cumsum(np.count_nonzero(flags, axis=1))]).astype(np.int32)
                members = asked[np.flatnonzero(flags) % WIDTH]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(nodes)), pa.array(hops), pa.ListArray.from_arrays(pa.array(at), pa.array(members))], ["node", "hops", "sources"])

    blocks = spark.range(0, n, WIDTH, max(1, min(-(-n // WIDTH), 4096)))
    found = map_batches(blocks, search, "node string, hops int, sources array<int>").select("node", "hops", F.explode("sources").alias("no"))
    return found.join(F.broadcast(numbered.where("asked = 1").select("no", C("id").alias("source"))), "no").select("source", "node", "hops")


def _parts(first: np.ndarray, to: np.ndarray, rounds: int = 64) -> np.ndarray:
    """A number for each node, mostly the same in a connected part. It only says which sources to search together."""
    part, linked = np.arange(len(first) - 1), np.flatnonzero(np.diff(first))
    for _ in range(rounds if len(linked) else 0):
        near = part.copy()
        near[linked] = np.minimum(part[linked], np.minimum.reduceat(part[to], first[linked]))
        near = near[near]
        if np.array_equal(near, part):
            break
        part = near
    return part


def levels(first: np.ndarray, to: np.ndarray, sources: np.ndarray, max_hops: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(hops, nodes, bits)``: the nodes that at most 64 sources reach first after so many hops; bit k stands for source k.

    Neighbours of node i are ``to[first[i]:first[i + 1]]``. A small frontier sends its bits, a large one is read from every node.
    """
    nodes, bits = sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
    seen = np.zeros(len(first) - 1, np.uint64)
    seen[nodes] = bits
    linked = np.flatnonzero(np.diff(first))
    for h in itertools.count() if max_hops is None else range(max_hops + 1):
        yield h, nodes, bits
        degree = first[nodes + 1] - first[nodes]
        if not (total := int(degree.sum())):
            return
        if total * 8 < len(to):
            at = np.repeat(first[nodes] - (np.cumsum(degree) - degree), degree) + np.arange(total)
            ends = to[at]
            by = np.argsort(ends, kind="stable")
            ends = ends[by]
            heads = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            nodes, bits = ends[heads], np.bitwise_or.reduceat(np.repeat(bits, degree)[by], heads)
        else:
            front = np.zeros(len(seen), np.uint64)
            front[nodes] = bits
            nodes, bits = linked, np.bitwise_or.reduceat(front[to], first[linked])
        bits = bits & ~seen[nodes]
        new = bits != 0
        nodes, bits = nodes[new], bits[new]
        if not len(nodes):
            return
        seen[nodes] |= bits


def _in_batches(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels as ``(nodes, hops, bits)`` of about ``BATCH`` rows, so that a long path doesn't make a batch a hop."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for h, nodes, bits in found:
        for i in range(0, len(nodes), BATCH):
            kept.append((nodes[i : i + BATCH], np.full(len(nodes[i : i + BATCH]), h, np.int32), bits[i : i + BATCH]))
            rows += len(kept[-1][0])
            if rows >= BATCH:
                yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                kept, rows = [], 0
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def conflicts(edges: DataFrame, snap: DataFrame) -> DataFrame:
    """GR-5: directed edges that state a conflict, both ends existing."""
    return resolved(edges.where(C("rel").isin("conflicts_with", "supersedes", "duplicate_of")), snap)


def router() -> Column:
    """GR-9: the first router tag, or ?."""
    return F.coalesce(F.get(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isin(*ROUTERS)), F.lit(0)), F.lit("?"))


def hub_members(edges: DataFrame, snap: DataFrame) -> DataFrame:
    """AG-16, AG-17: members (has_part targets) of each hub by router."""
    hubs = snap.where("kind = 'hub'").select(C("id").alias("src"))
    m = resolved(edges.where("rel = 'has_part'"), snap).join(hubs, "src", "left_semi").select("src", "dst").distinct()
    return m.join(snap.select(C("id").alias("dst"), router().alias("router")), "dst").groupBy(C("src").alias("hub_id"), "router").agg(F.count(F.lit(1)).alias("n_members"))


def superseded(edges: DataFrame, snap: DataFrame, now: float) -> DataFrame:
    """GR-7: targets of supersedes edges whose source is active."""
    live = snap.where(S.is_active(C("kind"), C("valid_until"), now)).select(C("id").alias("src"))
    return resolved(edges.where("rel = 'supersedes'"), snap).join(live, "src", "left_semi").groupBy(C("dst").alias("id")).agg(F.min("src").alias("by"), F.count(F.lit(1)).alias("n"))


def broken_edges(edges: DataFrame, snap: DataFrame) -> DataFrame:
    """JN-2: edges whose target does not exist."""
    return edges.join(snap.select(C("id").alias("dst")), "dst", "left_anti").select("edge_id", "src", "dst")


def rules_for(edges: DataFrame, snap: DataFrame, situations: DataFrame, now: float, limit: int = 10) -> DataFrame:
    """GR-4: rules that apply in a situation ``(qid, q)``.

    Pool: 1 for each matching hub a node is a part of (a hub matches by its ``entity:`` tag), half for each common
    token, .8 once through supersedes or conflicts; then weight, freshness, kind and supersession.
    """
    e = resolved(edges, snap)
    hubs = snap.where("kind = 'hub'").select(C("id").alias("src"), F.explode(F.filter("tags", lambda t: t.startswith("entity:"))).alias("t")).select("src", F.substring("t", 8, 100).alias("entity"))
    q = F.broadcast(situations)
    via_hub = hubs.join(q, F.contains(S.norm_text(C("q")), C("entity"))).join(e.where("rel = 'has_part'").select("src", "dst"), "src").select("qid", C("dst").alias("id"), F.lit(1.0).alias("s"))
    words = snap.where("kind <> 'hub'").select("id", F.explode(F.array_distinct(S.budget_tokens(node_text()))).alias("token"))
    qt = situations.select("qid", F.explode(F.array_distinct(S.budget_tokens(C("q")))).alias("token"))
    via_word = words.join(F.broadcast(qt), "token").select("qid", "id", F.lit(0.5).alias("s"))
    pool = via_hub.unionByName(via_word).groupBy("qid", "id").agg(F.sum("s").alias("s"))
    hop = e.where("rel in ('supersedes', 'conflicts_with')")
    both = hop.select(C("src").alias("id"), C("dst").alias("nb")).union(hop.select("dst", "src"))
    near = pool.join(both, "id").select("qid", C("nb").alias("id")).distinct().join(pool, ["qid", "id"], "left_anti").withColumn("s", F.lit(0.8))
    down = e.where("rel = 'supersedes'").select(C("dst").alias("id")).distinct().withColumn("down", F.lit(-1.5))
    upw = e.where("rel = 'supersedes'").select(C("src").alias("id")).distinct().withColumn("upw", F.lit(0.5))
    rules = snap.where(~C("kind").isin("refuted", "outdated", "hub") & F.array_contains("tags", "sys_cmd"))
    days = F.floor((F.lit(now) - F.coalesce(S.iso_seconds(C("ts")), F.lit(now))) / 86400)
    w = S.decayed(S.falsy(C("weight"), 0.05), C("kind"), S.iso_seconds(C("last_used")), now)
    j = pool.unionByName(near).join(rules, "id").join(down, "id", "left").join(upw, "id", "left")
    zero = F.lit(0.0)
    score = C("s") + w + F.greatest(zero, 1 - days / 60.0) + F.when(C("kind") == "rule", 0.5).otherwise(zero) + F.coalesce("down", zero) + F.coalesce("upw", zero)
    ranked = j.select("qid", "id", F.round(score, 3).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(C("score").desc(), C("id").desc())))
    return ranked.where(C("rank") <= limit)
