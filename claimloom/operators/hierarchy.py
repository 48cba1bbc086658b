"""Parent-child links to full hierarchies by bottom-up leaf peeling (problem 2).

A round peels LEVELS levels of leaves: every descendant list is sent LEVELS links up,
and only links whose child is still higher than that stay for the next round.  Few
nodes are high, so the links left shrink fast and there are depth / LEVELS rounds.
The lists travel as rows ``(ancestor, descendant, hops)``, not as arrays, so that a
root above a third of all nodes never becomes one huge row; the size of a subtree is
the number of its rows, and a node's path is its ancestors in the order of hops,
which is the peel order reversed.

Links that a round can't peel lie on cycles or above them.  All pairs among these residual
nodes come from pointer doubling (paths of twice the length each round, so a cycle of n
nodes takes log n rounds), and the lists that reached them are sent on through these pairs.

Null, blank and unknown ids are no links.  Extra columns are ignored.  Repeated
rows count once.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.runtime import drop_path, norm_id, stage_path, staged


def hierarchy_links(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", children_col: str = "children") -> DataFrame:
    """Distinct links ``(child, parent)`` that either end states, with both ends in ``nodes``."""
    base = nodes.select(norm_id(F.col(id_col)).alias("own"), norm_id(F.col(parent_col)).alias("up"), F.col(children_col).alias("down"))
    ids = base.select(F.col("own").alias("other")).where("other is not null").distinct()
    up = base.select(F.col("own"), F.col("up").alias("other"), F.lit(True).alias("is_up"))
    down = base.select("own", F.explode("down").alias("raw")).select("own", norm_id(F.col("raw")).alias("other"), F.lit(False).alias("is_up"))
    stated = up.unionByName(down).where("own is not null and other is not null")
    known = stated.join(ids, "other", "left_semi")
    return known.select(
        F.when(F.col("is_up"), F.col("own")).otherwise(F.col("other")).alias("child"),
        F.when(F.col("is_up"), F.col("other")).otherwise(F.col("own")).alias("parent"),
    ).distinct()


#: Levels of leaves peeled in one round; a cycle of at most so many nodes is recognised while it is walked.
LEVELS = 8


def _climb(frontier: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """Send rows ``(descendant_id, at, hops)`` up to ``levels`` links up: a0 = at, a1, ... are the nodes passed.

    A climb ends at a root, where it meets a node of the same climb again, and where it is back at its start.
    """
    rows = frontier.select("descendant_id", "hops", F.col("at").alias("a0"))
    for i in range(1, levels + 1):
        up = links.select(F.col("child").alias(f"a{i - 1}"), F.col("parent").alias(f"a{i}"))
        rows = rows.join(up, f"a{i - 1}", "left")
        repeats = F.col(f"a{i - 1}") == F.col("descendant_id")
        for j in range(i):
            repeats = repeats | (F.col(f"a{i}") == F.col(f"a{j}"))
        rows = rows.withColumn(f"a{i}", F.when(~repeats, F.col(f"a{i}")))
    return rows


def doubled(links: DataFrame, root: str) -> DataFrame:
    """All pairs ``(ancestor_id, descendant_id, hops)`` of ``links(child, parent)`` by pointer doubling, hops being the smallest number of links.

    With every pair of up to n links known, one of up to 2 n is a pair of exactly n and one of up to n.
    """
    known = staged(links.select(F.col("parent").alias("ancestor_id"), F.col("child").alias("descendant_id"), F.lit(1).alias("hops")), "doubled", f"{root}/1")
    n = 1
    while True:
        ends = known.where(F.col("hops") == n).select("descendant_id", F.col("ancestor_id").alias("at"), F.col("hops").alias("first"))
        if ends.isEmpty():
            return known
        onward = known.select("ancestor_id", F.col("descendant_id").alias("at"), F.col("hops").alias("then"))
        longer = ends.join(onward, "at").select("ancestor_id", "descendant_id", (F.col("first") + F.col("then")).cast("int").alias("hops"))
        every = known.unionByName(longer).groupBy("ancestor_id", "descendant_id").agg(F.min("hops").alias("hops"))
        n *= 2
        known = staged(every, "doubled", f"{root}/{n}")
        drop_path(links.sparkSession, f"{root}/{n // 2}")


def peel(links: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All pairs ``(ancestor_id, descendant_id, hops)`` of ``links(child, parent)``, hops being the smallest number of links."""
    spark = links.sparkSession
    root = stage_path(spark, "peel")
    schema = "ancestor_id string, descendant_id string, hops int"
    live = staged(links, "links", f"{root}/links-0")
    left, done = live.count(), 1
    parts = [live.select(F.col("parent").alias("ancestor_id"), F.col("child").alias("descendant_id"), F.lit(1).alias("hops"))]
    frontier = live.select(F.col("child").alias("descendant_id"), F.lit(1).alias("hops"), F.col("parent").alias("at"))
    while left:
        rows = _climb(frontier, live, levels)
        steps = F.array(*[F.struct(F.col(f"a{i}").alias("ancestor_id"), (F.col("hops") + i).cast("int").alias("hops")) for i in range(1, levels + 1)])
        sent = rows.select("descendant_id", F.explode(F.filter(steps, lambda x: x["ancestor_id"].isNotNull())).alias("s")).select("s.ancestor_id", "descendant_id", "s.hops").distinct()
        out = staged(sent, "pairs", f"{root}/pairs-{done}")
        parts.append(out)
        done += levels
        frontier = out.where(F.col("hops") == done).select("descendant_id", "hops", F.col("ancestor_id").alias("at"))
        kept = staged(live.join(frontier.select(F.col("at").alias("child")).distinct(), "child", "left_semi"), "links", f"{root}/links-{done}")
        n = kept.count()
        if n == left:
            # No leaf is left: cycles, and what lies above them.
            pairs = doubled(kept, f"{root}/residual")
            above = pairs.select("ancestor_id", F.col("descendant_id").alias("at"), F.col("hops").alias("more"))
            parts += [pairs, frontier.join(above, "at").select("ancestor_id", "descendant_id", (F.col("hops") + F.col("more")).cast("int").alias("hops"))]
            break
        live, left = kept, n
    every = parts[0].select("ancestor_id", "descendant_id", "hops")
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("ancestor_id", "descendant_id").agg(F.min("hops").alias("hops")).to(T.StructType.fromDDL(schema))


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """One row for each node and each of its ancestors: ``(ancestor_id, descendant_id, hops)``."""
    return peel(hierarchy_links(nodes))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """For each node: path from its root, depth, root, number of descendants and whether it lies in or below a cycle.

    A node in or below a cycle has no root: root_id is null, depth is -1, and path holds
    its ancestors by distance.  Where links name several parents, path is a list of all
    ancestors, the farthest first (ties by id).  Ids without any link are trees of one node.
    The path of a node is as long as its depth; descendants come as rows (`ancestor_pairs`).
    """
    pairs = ancestor_pairs(nodes)
    ids = nodes.select(norm_id(F.col("id")).alias("node_id")).where("node_id is not null").distinct()
    loops = pairs.where("ancestor_id = descendant_id").select(F.col("ancestor_id")).withColumn("loop", F.lit(True))
    marked = pairs.join(loops, "ancestor_id", "left")
    above = marked.groupBy(F.col("descendant_id").alias("node_id")).agg(
        F.expr("transform(array_sort(collect_list(struct(-hops as h, ancestor_id as a))), x -> x.a)").alias("above"),
        F.max("hops").alias("hops"),
        F.coalesce(F.max("loop"), F.lit(False)).alias("cyclic"),
    )
    below = pairs.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    cyclic = F.coalesce(F.col("cyclic"), F.lit(False))
    path: Column = F.concat_ws("/", F.coalesce(F.col("above"), F.array().cast("array<string>")), F.col("node_id"))
    return (
        ids.join(above, "node_id", "left")
        .join(below, "node_id", "left")
        .select(
            "node_id",
            path.alias("path"),
            F.when(cyclic, F.lit(-1)).otherwise(F.coalesce(F.col("hops"), F.lit(0))).alias("depth"),
            F.when(~cyclic, F.coalesce(F.get("above", F.lit(0)), F.col("node_id"))).alias("root_id"),
            F.coalesce(F.col("n_descendants"), F.lit(0)).alias("n_descendants"),
            cyclic.alias("in_cycle"),
        )
    )
