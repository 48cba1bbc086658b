"""Mixing sources to target weights by Efraimidis-Spirakis sampling (problem 8).

Each source gets share x size tokens of a mix.  Complete epochs of a source come first,
as long as the budget holds its tokens and the cap allows; the rest is a weighted sample
without replacement: every document draws the key -ln(u) / weight, and documents enter
in the order of keys until the budget is full.

The order is never sorted in one task, though a source may hold most documents: keys fall
into buckets, bucket sums (a table bounded by rows of targets x BUCKETS) give each bucket
the tokens before it, and only the bucket in which the budget ends matters.  It is divided
into buckets again, between its smallest and its largest key, until it holds EDGE documents
at most, whatever the weights are; only these are sorted.  The document that crosses the
budget is taken if that leaves the sum nearer.

The vocabulary file is read by the driver and broadcast (its size is fixed).  Long texts go
to the tokenizer in pieces that end where its split pattern always ends a piece, before
white space, so the number of tokens is that of the whole text.

u comes from a hash of document id, source and seed, so a run repeats exactly.  Sources
compare without letter case and outer blanks; documents without source, and sources
without target, are in no mix, but count in the tokens of the corpus.  A source without
documents, or too small for its share even with all repeats, contributes what it can; the
other shares do not grow for it, and the report shows the gap.  Null texts have no tokens;
repeated document ids count once; an empty table gives empty mixes.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.runtime import map_batches, staged

BUCKETS = 1024
#: documents of one source that are sorted in one task at most
EDGE = 100_000
#: characters from which on a text is cut before the next white space
PIECE = 1 << 16
CUT = re.compile(r"(?<=\S)(?=\s)")


def default_tokenizer() -> str:
    return os.environ.get("CLAIMLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes):
    """Byte-level BPE from the content of a file of ranks, one "base64 rank" a line, with the public split pattern of that vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    return encoding_of(Path(path).read_bytes())


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    lo = 0
    while len(text) - lo > size:
        m = CUT.search(text, lo + size)
        if not m:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def source_key(c: Column) -> Column:
    return F.nullif(F.lower(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(""))


def quality_weight(documents: DataFrame) -> Column:
    """Weight of a document in the sample: error pages and very short pages are drawn less often.  Always above zero."""
    status = F.coalesce(F.col("http_status"), F.lit(200))
    length = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.coalesce(F.length("text"), F.lit(0)) / 400.0))
    return length * F.when(status >= 400, 0.25).otherwise(1.0)


def token_sizes(documents: DataFrame, tokenizer: str | None = None, weight: Column | None = None) -> DataFrame:
    """``(doc_id, source, tokens, weight)`` as a written table, so each text is tokenized once."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(Path(tokenizer or default_tokenizer()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding_of(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = [sum(len(encode(x)) for x in pieces(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("tokens", pa.array(sizes, pa.int64()))

    w = quality_weight(documents) if weight is None else weight
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), w.alias("weight"), "text").where("doc_id is not null")
    sized = map_batches(rows, run, "doc_id bigint, source string, weight double, tokens bigint")
    return staged(sized.dropDuplicates(["doc_id"]), "token-sizes")


def _key(seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.col("weight")


def _cuts(keyed: DataFrame, plan: DataFrame, edge: int) -> list[tuple]:
    """``(mix, source, epochs, rest, lo, hi, start)`` for each mix and source: the budget ends between the keys lo and hi, with start tokens before lo.

    One row a row of targets; null keys where the whole source fits.
    """
    spark = keyed.sparkSession
    schema = "mix string, source string, epochs int, rest double, lo double, hi double, start bigint"
    open_ = [(r.mix, r.source, r.epochs, r.rest, 0.0, math.inf, 0) for r in plan.collect()]
    done = []
    while open_:
        ranges = F.broadcast(spark.createDataFrame(open_, schema))
        rows = keyed.join(ranges, "source").where("k >= lo and k <= hi")
        # Of equal probability at first for weights about 1, of equal width inside a bucket.
        part = F.when(F.col("hi") == math.inf, 1 - F.exp(-F.col("k"))).otherwise((F.col("k") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
        bucket = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
        sums = rows.groupBy("mix", "source", "epochs", "rest", "start", bucket.alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("z"))
        before = F.col("start") + F.coalesce(F.sum("t").over(Window.partitionBy("mix", "source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("before", before).where("before <= rest").groupBy("mix", "source", "epochs", "rest").agg(F.max_by(F.struct("a", "z", "before", "n"), "b").alias("c"))
        open_now = []
        for r in last.collect():
            row = (r.mix, r.source, r.epochs, r.rest, r.c.a, r.c.z, r.c.before)
            (done if r.c.n <= edge or r.c.a == r.c.z else open_now).append(row)
        open_ = open_now
    return done


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 0, edge: int = EDGE) -> DataFrame:
    """``(mix, source, doc_id, tokens, copies)``: how often each chosen document stands in each mix."""
    plan = allotment(sizes, targets).where("budget > 0 and have > 0").select("mix", "source", "epochs", "rest")
    keyed = sizes.where("source is not null and tokens > 0").withColumn("k", _key(seed))
    cuts = _cuts(keyed, plan, edge)
    wanted = sizes.sparkSession.createDataFrame(cuts, "mix string, source string, epochs int, rest double, lo double, hi double, start bigint")
    rows = keyed.join(F.broadcast(wanted), "source")
    edge_rows = rows.where("k between lo and hi").withColumn("run", F.col("start") + F.sum("tokens").over(Window.partitionBy("mix", "source").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    # Half of the document that crosses the budget lies inside: then the sum with it is nearer.
    edge_rows = edge_rows.withColumn("copies", F.col("epochs") + ((F.col("run") - F.col("tokens") / 2.0) <= F.col("rest")).cast("int"))
    others = rows.where("k < lo or k > hi").withColumn("copies", F.col("epochs") + (F.col("k") < F.col("lo")).cast("int"))
    cols = ["mix", "source", "doc_id", "tokens", "copies"]
    return others.select(*cols).unionByName(edge_rows.select(*cols)).where("copies > 0")


def allotment(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each mix and source: budget, tokens there are, complete epochs and tokens of the fractional rest."""
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    every = by_source.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("corpus"))
    t = targets.select("mix", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").where("source is not null and mix is not null")
    t = t.groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    joined = t.join(F.broadcast(by_source.where("source is not null")), "source", "left").withColumn("corpus", every.scalar())
    have = F.coalesce("have", F.lit(0))
    budget = F.coalesce(F.col("target_share") * F.col("size_ratio") * F.col("corpus"), F.lit(0.0))
    epochs = F.when(have > 0, F.least(F.floor(budget / F.nullif(have, F.lit(0))), F.col("max_repeats"))).otherwise(0).cast("int")
    rest = F.when(epochs < F.col("max_repeats"), budget - epochs * have).otherwise(0.0)
    return joined.select("mix", "source", "target_share", "max_repeats", budget.alias("budget"), have.alias("have"), epochs.alias("epochs"), F.coalesce(rest, F.lit(0.0)).alias("rest"))


def mixture_report(sizes: DataFrame, targets: DataFrame, seed: int = 0, edge: int = EDGE) -> DataFrame:
    """For each mix and source: wanted and actual tokens and shares, documents and the most copies of one."""
    chosen = mixture(sizes, targets, seed, edge)
    per = chosen.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    plan = allotment(sizes, targets).select("mix", "source", "target_share", "max_repeats", F.round("budget").cast("bigint").alias("target_tokens"))
    joined = plan.join(per, ["mix", "source"], "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix"))
    zero = F.lit(0)
    return joined.select(
        "mix", "source", "target_share", "target_tokens",
        F.coalesce("tokens", zero).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.nullif(total, zero), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("most_copies", zero).alias("most_copies"), "max_repeats",
    )
