"""Near-duplicate claims by a MinHash LSH forest with exact verification (problem 4).

A claim in its one consistent form (problem 5) is the set of its words.  Claims with the
same letters and the same set are one class; classes are compared, members join at the
end, so copies are never compared with each other.

Every tree of the forest orders all words anew.  The signature of a class in a tree is the
sequence of its words in that order, a path in a sorted prefix trie.  Two classes agree on
a prefix as long as no word of just one of them comes first.  The matched prefix is
shortened adaptively, to the first node that few classes can share: it ends with the
``hits``-th word held by at most ``cap`` classes, wherever in the path that is.  All words
take part, frequent ones too; they only don't end a path.

How far prefixes are shortened follows from the target recall.  Of all partners at the
claim threshold the worst lacks or adds telling words only (`least_meeting`), which gives
the least chance to meet in a tree, and so the trees that a class needs.  Where these are
more than TREES, the class shortens its prefixes further: the cap grows by the factor WIDEN
as often as needed, in the end to all classes, where every path is a single word.  A class
also stands in the tries of the smaller caps before, so two classes always meet in those of
the one that needed less.  No class is left out and no node is cut.  Among the pairs of
first cap and hits the one with the least cost, rows plus expected meetings, is taken
(`plan`): larger corpora get longer prefixes and more trees.

Pairs that meet are filtered by size and a bitmap of words and verified by their exact
similarity.  Null and blank claims, other scripts and claims with fewer than `min_words`
distinct words are in no pair.  Repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.lookalike import normaliser
from claimloom.llm.statements import field_form, hash128, plain_form
from claimloom.operators.components import components
from claimloom.runtime import map_batches, norm_id, staged

THRESHOLD = 0.6
MIN_WORDS = 8
#: least chance that a pair at the threshold is met, whatever the frequency of the words it shares
TARGET = 0.99
#: share of classes from which on the frequency of a word is broadcast: at most (words a class) / RARE_FROM words, whatever the size of the corpus
RARE_FROM = 1e-4
#: trees of one cap at most; factor from one cap to the next; most words of a prefix that must be telling; cost of a row in meetings
TREES, WIDEN, HITS, ROW_COST = 48, 4, 3, 64

WORD = re.compile(r"[\ẁ-ͯ]+")
OTHER_SCRIPT = re.compile(r"[^\W\d_A-Za-zªµºÀ-ʯЀ-ԯḀ-ỿ]")
OWN_SCRIPT = re.compile(r"[A-Za-zªµºÀ-ʯЀ-ԯḀ-ỿ]")


def word_set(form: str, min_words: int = MIN_WORDS) -> list[int] | None:
    """Hashes of the distinct words of a claim in Latin or Cyrillic script, or None."""
    others = len(OTHER_SCRIPT.findall(form))
    if others and others * 2 > len(OWN_SCRIPT.findall(form)):
        return None
    words = {w for part in WORD.findall(form.casefold()) for w in part.split("_") if w}
    if len(words) < min_words:
        return None
    return sorted(xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words)


def claim_classes(nodes: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """members(id, cid) and classes(cid, key, plain, words), both as written tables."""
    make = normaliser(nodes.sparkSession, nodes.select("claim"), "claim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = make()
        for batch in batches:
            forms = [n.lines(t) for t in batch.column("claim").to_pylist()]
            sets = [word_set(f, min_words) for f in forms]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "form", "words"])

    rows = nodes.select(norm_id(F.col("id")).alias("id"), "claim").where("id is not null and claim is not null")
    read = map_batches(rows, run, "id string, form string, words array<bigint>").where("words is not null")
    plain = hash128(plain_form(F.col("form")))
    keyed = read.select("id", "words", plain.alias("plain"), F.coalesce(hash128(field_form(F.col("form"))), plain).alias("key"))
    every = staged(keyed.withColumn("cid", F.xxhash64("plain", "key", "words")), "word-sets")
    classes = staged(every.groupBy("cid").agg(F.first("key").alias("key"), F.first("plain").alias("plain"), F.first("words").alias("words")), "classes")
    return every.select("id", "cid").distinct(), classes


def least_meeting(sizes: np.ndarray, telling: np.ndarray, hits: int) -> np.ndarray:
    """Chance that a class of ``sizes`` words, ``telling`` of them telling, agrees with its worst partner at the threshold on a prefix with ``hits`` telling words.

    The partner lacks x words and adds y, all of them telling: telling - x are shared, and each must come before the x + y others.
    """
    worst = np.ones(len(sizes))
    for share in (0.0, 0.1, 0.2, (1 - THRESHOLD) / (1 + THRESHOLD), 0.3, 1 - THRESHOLD):
        lacks = np.floor(share * sizes + 1e-9)
        adds = np.maximum(np.floor((sizes - lacks) / THRESHOLD - sizes + 1e-9), 0)
        p = np.ones(len(sizes))
        for i in range(hits):
            p *= np.clip(telling - lacks - i, 0, None) / np.maximum(telling + adds - i, 1)
        worst = np.minimum(worst, p)
    return np.minimum(worst, 1.0)


def trees_needed(sizes: np.ndarray, telling: np.ndarray, hits: int) -> np.ndarray:
    """Trees in which the worst partner is met with the target recall; more than TREES stands for too many."""
    p = np.minimum(least_meeting(sizes, telling, hits), 1 - 1e-9)
    few = p > 1e-6
    return np.where(few, np.minimum(np.ceil(math.log(1 - TARGET) / np.log1p(-np.where(few, p, 0.5))), TREES + 1), TREES + 1).astype(np.int64)


def chain(cap: int, n: int) -> list[int]:
    """The caps that prefixes are shortened by, one after another; the last lets every word end a path."""
    caps = [cap]
    while caps[-1] < n:
        caps.append(min(caps[-1] * WIDEN, n))
    return caps


def plan(n: int, mean: float, found: dict[tuple[int, int], tuple[float, float]], together: dict[int, float]) -> tuple[int, int]:
    """The ``(cap, hits)`` of least cost.

    ``found`` has the share of classes that reach the target and the mean number of trees for each cap and hits,
    ``together`` the chance that two classes have the same telling first word.
    """

    def cost(cap: int, hits: int) -> float:
        left, total = 1.0, 0.0
        for c in chain(cap, n):
            near = min((x for x, h in found if h == hits), key=lambda x: abs(x - c))
            reached, trees = found[near, hits]
            total += left * n * trees * ROW_COST + trees * (left * n) ** 2 / 2 * together[near] ** hits
            left = min(left, 1 - reached)
        return total

    return min(found, key=lambda k: (cost(*k), k))


def _mix(words: np.ndarray, seed: int) -> np.ndarray:
    x = words ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefixes(words: np.ndarray, starts: np.ndarray, telling: np.ndarray, hits: int, tree: int) -> np.ndarray:
    """Hash of each class's prefix in a tree, up to its ``hits``-th telling word; every class has that many.

    ``words`` holds the sets one after another, ``starts`` where each begins.  The words of a prefix in the order of the
    tree are those up to its last one, so a sum over them names the node.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    with np.errstate(over="ignore"):
        order = _mix(words, (tree + 1) * 0x632BE59BD9B4E019 % (1 << 64))
        ends = np.where(telling, order, top)
        for _ in range(hits - 1):
            ends = np.where(ends > np.minimum.reduceat(ends, starts)[owner], ends, top)
        inside = order <= np.minimum.reduceat(ends, starts)[owner]
        return np.add.reduceat(np.where(inside, _mix(order, 77), np.uint64(0)), starts)


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` of class ids, a < b, that share a prefix in a tree and can be similar enough."""
    spark = classes.sparkSession
    n = classes.count()
    floor = max(1, int(RARE_FROM * n))
    frequent = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    known = frequent.toArrow()
    order = np.argsort(known.column("w").to_numpy())
    freq = known.column("n").to_numpy()[order].astype(np.int64)
    table = spark.sparkContext.broadcast((known.column("w").to_numpy()[order], freq))
    grid = [floor]
    while grid[-1] < n:
        grid.append(min(grid[-1] * 2, n))

    def sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("words")
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        w, f = table.value
        if not len(w):
            return flat, np.diff(offsets), np.full(len(flat), floor, np.int64)
        i = np.minimum(np.searchsorted(w, flat), len(w) - 1)
        return flat, np.diff(offsets), np.where(w[i] == flat, f[i], floor)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(grid), HITS, 3))
        words = 0
        for batch in batches:
            if batch.num_rows:
                _, sizes, df = sets(batch)
                starts = np.cumsum(sizes) - sizes
                words += len(df)
                for i, cap in enumerate(grid):
                    told = np.add.reduceat((df <= cap).astype(np.int64), starts)
                    for h in range(HITS):
                        need = trees_needed(sizes, told, h + 1)
                        total[i, h] += (need <= TREES).sum(), np.minimum(need, TREES).sum(), len(sizes)
        i, h = (x.ravel() for x in np.indices((len(grid), HITS)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, h + 1, *total.reshape(-1, 3).T, np.full(len(i), words))], names=["i", "hits", "reached", "trees", "rows", "words"])

    seen = map_batches(classes.select("words"), survey, "i bigint, hits bigint, reached double, trees double, rows double, words bigint")
    seen = seen.groupBy("i", "hits").agg(F.sum("reached"), F.sum("trees"), F.sum("rows"), F.sum("words")).collect()
    mean = max((r[5] / r[4] for r in seen if r[4]), default=1.0)
    found = {(grid[r[0]], r[1]): (r[2] / r[4], r[3] / r[4]) for r in seen if r[4]} or {(1, 1): (1.0, 1.0)}
    together = {cap: (float((freq[freq <= cap].astype(float) ** 2).sum()) / max(n, 1) + mean * floor) / (mean * mean * max(n, 1)) for cap in [1, *grid]}
    cap, hits = plan(n, mean, found, together)
    caps = chain(cap, n)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes, df = sets(batch)
            cid = batch.column("cid").to_numpy()
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bit = _mix(flat.view(np.uint64), 2) >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            low, high = (np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == half, one, np.uint64(0)), starts).view(np.int64) for half in (0, 1))
            left = np.ones(len(sizes), bool)
            places, who = [], []
            for level, c in enumerate(caps):
                telling = df <= c
                told = np.add.reduceat(telling.astype(np.int64), starts)
                # The last cap serves every class left, whatever it needs.
                need = np.minimum(trees_needed(sizes, told, hits), TREES)
                done = trees_needed(sizes, told, hits) <= TREES if level + 1 < len(caps) else left
                for t in range(TREES):
                    rows = left & (told >= hits) & (t < need)
                    if not rows.any():
                        break
                    used = rows[owner]
                    found_at = prefixes(flat[used].view(np.uint64), np.cumsum(sizes[rows]) - sizes[rows], telling[used], hits, t)
                    places.append(_mix(found_at, (level * TREES + t + 1) * 0x2545F4914F6CDD1D % (1 << 64)).view(np.int64))
                    who.append(np.flatnonzero(rows))
                left = left & ~done
            if places:
                place, at = np.concatenate(places), np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(cid[at]), pa.array(sizes[at].astype(np.int32)), pa.array(low[at]), pa.array(high[at])], names=["place", "cid", "n", "low", "high"])

    nodes = map_batches(classes.select("cid", "words"), label, "place bigint, cid bigint, n int, low bigint, high bigint")
    other = nodes.select("place", *[F.col(c).alias(f"{c}_o") for c in nodes.columns if c != "place"])
    # What sizes and bitmaps already show: the smaller set is too small, or too many words differ.
    both = F.col("n") + F.col("n_o")
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("low_o"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_o")))
    near = (F.least("n", "n_o") + 1e-6 >= F.greatest("n", "n_o") * THRESHOLD) & (differ * (1 + THRESHOLD) <= both * (1 - THRESHOLD) + 1e-6)
    return nodes.hint("merge").join(other, "place").where((F.col("cid") < F.col("cid_o")) & near).select(F.col("cid").alias("a"), F.col("cid_o").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of classes above the threshold that are not the same by problem 1: ``(a, b, similarity)``."""
    side = classes.select("cid", "key", "plain", "words")
    left = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    # Merge joins: classes and pairs grow with the corpus, and a broadcast would send either to the driver.
    joined = pairs.hint("merge").join(left, F.col("a") == F.col("cid_a")).hint("merge").join(right, F.col("b") == F.col("cid_b"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    share = both / (F.size("words_a") + F.size("words_b") - both)
    return joined.where((F.col("key_a") != F.col("key_b")) & (F.col("plain_a") != F.col("plain_b"))).select("a", "b", share.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(nodes: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: pairs of node ids whose claims are similar enough, the smaller id first."""
    members, classes = claim_classes(nodes)
    pairs = verified(candidates(classes), classes)
    named = pairs.hint("merge").join(members.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a").hint("merge").join(members.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b")
    return named.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(nodes: DataFrame) -> DataFrame:
    """``(id, group_id, n_links)``: each node with a similar claim, its group (connected by links), and the number of classes its claim is linked with.

    Classes are grouped; copies only follow their class, so a group of a million copies costs one row each.
    """
    members, classes = claim_classes(nodes)
    pairs = staged(verified(candidates(classes), classes).select("a", "b"), "near-pairs")
    groups = components(pairs, "a", "b")
    both = pairs.union(pairs.select("b", "a"))
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    placed = members.hint("merge").join(groups.hint("merge").join(links, F.col("node") == F.col("a")).select(F.col("node").alias("cid"), "component", "n_links"), "cid")
    names = placed.groupBy("component").agg(F.min("id").alias("group_id"))
    return placed.hint("merge").join(names, "component").select("id", "group_id", F.col("n_links").cast("int").alias("n_links"))
