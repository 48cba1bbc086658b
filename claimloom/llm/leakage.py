"""Evaluation texts leaking into training text (problem 7).

The normalised word n-grams of the items are hashed and broadcast; the windows of every
document are hashed in bulk and looked up.  Every hit is verified word by word, so a
collision of hashes reports nothing.  The items are a stated query set: blocks of at most
BLOCK n-grams are broadcast one after another, so the size broadcast is bounded whatever
the number of items.

A word is a run of letters or digits, without letter case.  An item of fewer than n words
must occur whole.  Null and empty texts leak nothing and items without words can't leak;
repeated rows count once; extra columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.runtime import map_batches

N = 12
BLOCK = 1_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


class Grams:
    """Hashed n-grams of a block of items, by length, with the words and items behind each hash."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.by_length: dict[int, dict[int, dict[tuple[str, ...], set[int]]]] = {}
        self.vocabulary: set[str] = set()
        for item, words in items:
            self.vocabulary.update(words)
            k = min(n, len(words))
            if not k:
                continue
            hashes = window_hashes(word_hashes(words), k)
            for i, h in enumerate(hashes.tolist()):
                self.by_length.setdefault(k, {}).setdefault(h, {}).setdefault(tuple(words[i : i + k]), set()).add(item)
        self.sorted = {k: np.array(sorted(t), np.uint64) for k, t in self.by_length.items()}


def word_hashes(words: list[str], cache: dict[str, int] | None = None) -> np.ndarray:
    if cache is None:
        return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    get = cache.get
    return np.array([get(w) or cache.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of k words."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(k):
            out = out * BASE + h[i : i + m]
    return out


def hits_of(texts: list[list[str]], grams: Grams) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item, first word, number of words)`` for each window of a text that is an n-gram of an item.

    A word that no item has is hashed to itself only, so texts are joined without windows across their ends.
    """
    sizes = np.array([len(t) for t in texts])
    if not len(sizes) or not sizes.sum():
        return
    # Words outside the items' vocabulary can't be in a hit; they share one value.
    codes = {w: xxhash.xxh3_64_intdigest(w) for w in grams.vocabulary}
    flat = np.fromiter((codes.get(w, 0) for t in texts for w in (*t, "")), np.uint64, int(sizes.sum()) + len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for k, table in grams.by_length.items():
        found = window_hashes(flat, k)
        for at in np.flatnonzero(np.isin(found, grams.sorted[k])).tolist():
            t = int(owner[at])
            first = at - int(begin[t])
            key = tuple(texts[t][first : first + k])
            for item in table[int(found[at])].get(key, ()):
                yield t, item, first, k


def _blocks(items: DataFrame, n: int, block: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of bounded size, as the driver reads them."""
    out, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id").toLocalIterator():
        words = words_of(r.text)
        if out and size + len(words) > block:
            yield out
            out, size = [], 0
        out.append((r.item_id, words))
        size += len(words)
    if out:
        yield out


def leak_spans(documents: DataFrame, items: DataFrame, n: int = N, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, span_start, span_end)``: spans of characters that a document shares with an item, overlapping windows merged."""
    spark = documents.sparkSession
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, span_start int, span_end int"
    out = spark.createDataFrame([], schema)
    for items_of_block in _blocks(items, n, block):
        grams = spark.sparkContext.broadcast(items_of_block)

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            known = Grams(grams.value, n)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                found: dict[tuple[int, int], list[list[int]]] = {}
                for t, item, first, k in sorted(hits_of([words_of(x) for x in texts], known)):
                    spans = found.setdefault((t, item), [])
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], first + k)
                    else:
                        spans.append([first, first + k])
                cols: list[list[int]] = [[], [], [], []]
                places: dict[int, list[tuple[int, int]]] = {}
                for (t, item), spans in found.items():
                    if t not in places:
                        places[t] = word_places(texts[t])
                    for a, b in spans:
                        for c, v in zip(cols, (ids[t], item, places[t][a][0], places[t][b - 1][1]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "span_start", "span_end"])

        out = out.unionByName(map_batches(rows, scan, schema))
    return out.distinct()


def word_places(text: str) -> list[tuple[int, int]]:
    """Character span of each word; folding can change lengths and even join words, so words are found as `words_of` finds them."""
    folded = text.casefold()
    if len(folded) == len(text):
        return [m.span() for m in WORD.finditer(folded)]
    origin = [i for i, c in enumerate(text) for _ in c.casefold()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(folded)]


def leaks(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold n consecutive words of an item, or the whole of a shorter one."""
    return leak_spans(documents, items, n).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, n: int = N, drop_share: float = 0.5) -> DataFrame:
    """Clean corpus ``(doc_id, text, n_removed)``: leaked spans are cut out; a document that leaked for ``drop_share`` of its characters or more is left out."""
    spans = leak_spans(documents, items, n).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("spans"))
    # Overlapping spans of several items merge into one pass from left to right.
    step = "struct(s.span_end as at, concat(acc.text, substring(text, acc.at + 1, greatest(0, s.span_start - acc.at))) as text, acc.cut + greatest(0, s.span_end - greatest(acc.at, s.span_start)) as cut)"
    keep = "aggregate(spans, struct(0 as at, '' as text, 0 as cut), (acc, s) -> if(s.span_end <= acc.at, acc, %s), acc -> struct(concat(acc.text, substring(text, acc.at + 1)) as text, acc.cut as cut))" % step
    joined = documents.select("doc_id", "text").where("text is not null").join(spans, "doc_id", "left")
    cleaned = joined.withColumn("c", F.when(F.col("spans").isNotNull(), F.expr(keep)))
    size = F.length("text")
    return cleaned.where(F.col("c").isNull() | (F.col("c.cut") < drop_share * size)).select("doc_id", F.coalesce("c.text", "text").alias("text"), F.coalesce("c.cut", F.lit(0)).cast("int").alias("n_removed"))
