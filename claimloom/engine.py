"""One entry to the operators by tool name (HD-1, HD-4, HD-5, HD-14, FL-3, FL-4, FL-6, SO-2, SR-13): ``Engine(nodes, edges, log).call(tool, **arguments)``.

Every tool returns a DataFrame and changes nothing; writing its rows is the caller's choice.  Arguments are coerced as
they arrive from outside: numbers and flags as text are read, counts are clamped to their range, one value stands for a
list of it.  Unknown tools, unknown arguments and missing texts are errors.
"""

from __future__ import annotations

import inspect
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import graph as G
from claimloom.operators import grounding as N
from claimloom.operators import intake as I
from claimloom.operators import quality as Q
from claimloom.operators import search as R
from claimloom.operators import store as O
from claimloom.runtime import norm_id

C = F.col


def as_int(value: Any, default: int, low: int, high: int) -> int:
    """A count within its range; what is no number is the default."""
    try:
        return max(low, min(high, int(float(value))))
    except (TypeError, ValueError, OverflowError):
        return default


def as_float(value: Any, default: float) -> float:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return x if x == x else default


def as_flag(value: Any, default: bool = False) -> bool:
    if value is None or value == "":
        return default
    return str(value).strip().lower() in ("1", "true", "yes", "on", "да")


def as_list(value: Any) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else [str(x) for x in value]


def text_of(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that is not blank")
    return value


class Engine:
    """Tools over a snapshot of ``nodes``, its ``edges`` and, for usage, the ``log`` of the same columns as the tables."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, now: float | None = None) -> None:
        self.spark = nodes.sparkSession
        self.snap = O.snapshot(nodes)
        e = edges.select("edge_id", norm_id(C("src")).alias("src"), norm_id(C("dst")).alias("dst"), F.coalesce("rel", F.lit("related_to")).alias("rel"), F.coalesce("author", F.lit("unknown")).alias("author"))
        self.edges = e.where("src is not null and dst is not null").distinct()
        self.now = time.time() if now is None else now

    @classmethod
    def tools(cls) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(cls) if n.startswith("tool_"))

    def call(self, tool: str, **arguments: Any) -> DataFrame:
        if tool not in self.tools():
            raise KeyError(f"unknown tool {tool}; known are {', '.join(self.tools())}")
        f = getattr(self, f"tool_{tool}")
        if extra := arguments.keys() - inspect.signature(f).parameters.keys():
            raise ValueError(f"{tool} takes no {', '.join(sorted(extra))}")
        return f(**arguments)

    def _ask(self, q: str) -> DataFrame:
        return self.spark.createDataFrame([(1, q)], "qid int, q string")

    def _one(self, node_id: Any) -> DataFrame:
        return self.snap.where(C("id") == norm_id(F.lit(text_of(node_id, "node_id"))))

    def tool_search(self, query: Any = None, mode: str = "substring", top_k: Any = 5, tags: Any = None, kind: Any = None, relevance: Any = None) -> DataFrame:
        """SR-13; tags, kind and the relevance gate filter what the search has already cut to top_k (FL-6)."""
        q, k = self._ask(text_of(query, "query")), as_int(top_k, 5, 1, 50)
        budget = lambda depth: R.ranked(R.budget_score(self.snap, q, self.now), depth)
        if mode == "substring":
            got = I.with_fallback(R.search_substring(self.snap, q, self.now, k), budget(k), q)
        elif mode == "exact":
            got = R.search_exact(self.snap, q, self.now, k)
        elif mode == "budget":
            got = budget(k)
        elif mode == "rrf":
            # Stale rows and hubs hold their ranks in the lists and go after the fusion.
            depth = max(k, 20)
            fused = R.rrf([budget(depth).select("qid", "id", "rank"), R.bm25(self.snap, q, depth).select("qid", "id", "rank")], 50)
            got = fused.join(R.live(self.snap, self.now).select("id"), "id", "left_semi").where(C("rank") <= 50).orderBy("rank").limit(k)
        else:
            raise ValueError("mode is substring, exact, budget or rrf")
        rows = got.join(self.snap.select("id", "claim", C("kind").alias("node_kind"), C("tags").alias("node_tags")), "id")
        if wanted := as_list(tags):
            rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("node_tags", F.array().cast("array<string>")))) == 0)
        if kind:
            rows = rows.where(C("node_kind") == str(kind))
        if relevance is not None:
            rows = rows.join(I.read_gates(self.snap, q, self.now, as_float(relevance, 2.0)).select("id"), "id", "left_semi")
        return rows.drop("qid", "node_tags").orderBy("rank")

    def tool_answer(self, query: Any = None) -> DataFrame:
        """GN-3: whether one row answers the question by itself."""
        q = self._ask(text_of(query, "query"))
        return N.graph_first(self.snap, R.budget_score(self.snap, q, self.now), q, self.now)

    def tool_ground(self, answer: Any = None, pre_pass: Any = None) -> DataFrame:
        """GN-2: verdict of an answer; without a pre-pass it is ungrounded."""
        a = self.spark.createDataFrame([(1, text_of(answer, "answer"))], "answer_id int, text string")
        judged = N.answer_verdicts(a, N.verify_claims(self.snap, N.split_claims(a)))
        return N.with_prepass(judged, self.spark.createDataFrame([(1, 0 if as_flag(pre_pass) else -1)], "answer_id int, prepass_id int"))

    def tool_add(self, rows: DataFrame | None = None) -> DataFrame:
        """DM-13 for a batch of rows with the columns of the nodes: judged beside all rows that are there."""
        if rows is None:
            raise ValueError("rows must be a DataFrame with the columns of the nodes")
        batch = O.snapshot(rows)
        both = self.snap.unionByName(batch.select(*[C(c) if c in batch.columns else F.lit(None).cast(self.snap.schema[c].dataType).alias(c) for c in self.snap.columns]))
        return I.intake(both, self.now).join(batch.select("id"), "id", "left_semi")

    def tool_verify(self, node_id: Any = None) -> DataFrame:
        wanted = self._one(node_id).select("id")
        return I.verified_weights(self.snap, self.now).join(wanted, "id", "left_semi")

    def tool_reinforce(self, node_id: Any = None, delta: Any = 0.05) -> DataFrame:
        more = max(0.0, as_float(delta, 0.05))
        return self._one(node_id).select("id", F.least(F.lit(1.0), S.falsy(C("weight"), 1.0) + more).alias("weight"))

    def tool_decay(self, half_life_hours: Any = S.HALF_LIFE_H) -> DataFrame:
        return O.decay(self.snap, self.now, as_float(half_life_hours, S.HALF_LIFE_H))

    def tool_prune(self, rule: str = "expired_ttl", prefix: Any = "") -> DataFrame:
        """DM-17..20: the rows a rule names; nothing is deleted."""
        rules = {"expired_ttl": lambda: O.prune_ttl(self.snap, self.now), "exact_dupes": lambda: O.prune_dupes(self.snap), "weak": lambda: O.prune_weak(self.snap, self.now), "source_prefix": lambda: O.prune_prefix(self.snap, text_of(prefix, "prefix"))}
        if rule not in rules:
            raise ValueError(f"rule is one of {', '.join(sorted(rules))}")
        return rules[rule]()

    def tool_graph(self, action: str = "neighbors", node_id: Any = None, situation: Any = None, limit: Any = 10) -> DataFrame:
        """GR-1, GR-3..7."""
        if action == "neighbors":
            return G.neighbours(self.edges, self.snap, self._one(node_id).select("id"))
        if action == "distances":
            return G.distances(G.resolved(self.edges, self.snap), self._one(node_id).select("id"))
        if action == "rules_for":
            return G.rules_for(self.edges, self.snap, self._ask(text_of(situation, "situation")), self.now, as_int(limit, 10, 1, 100))
        simple = {"conflicts": lambda: G.conflicts(self.edges, self.snap), "hubs": lambda: I.related_hubs(self.edges, self.snap), "superseded": lambda: G.superseded(self.edges, self.snap, self.now), "broken": lambda: G.broken_edges(self.edges, self.snap)}
        if action not in simple:
            raise ValueError(f"action is one of neighbors, distances, rules_for, {', '.join(sorted(simple))}")
        return simple[action]()

    def tool_stats(self) -> DataFrame:
        """AG-1, AG-6: rows, mean weight and stale rows of each kind."""
        live = S.is_active(C("kind"), C("valid_until"), self.now)
        return self.snap.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.falsy(C("weight"), 1.0)), 4).alias("mean_weight"), F.count_if(~live).alias("n_inactive"))

    def tool_gates(self) -> DataFrame:
        return Q.write_gates(self.snap, self.now)
