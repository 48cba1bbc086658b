import pytest
from claimloom.llm.mixing import default_tokenizer, encoding, mixture, mixture_report, pieces, token_sizes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(i, "big", 1.0 + i % 3, 50 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 1.0, 100) for i in range(10)] + [(20_000, None, 1.0, 500), (20_001, "unused", 1.0, 500), (20_002, "big", 1.0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, weight double, tokens bigint").cache()


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "mix string, source string, target_share double, max_repeats int, size_ratio double")


def test_budgets_epochs_and_caps(spark, sizes):
    total = sizes.agg(F.sum("tokens")).first()[0]
    t = targets(spark, ("m", " BIG", 0.9, 3, 0.5), ("m", "small", 0.03, 4, 0.5), ("m", "Small2", 0.07, 4, 0.5), ("cap", "small", 1.0, 2, 0.5), ("m", None, 0.1, 1, 0.5))
    r = {(x.mix, x.source): x for x in mixture_report(sizes, t).collect()}
    big, small, cap = r[("m", "big")], r[("m", "small")], r[("cap", "small")]
    assert abs(big.tokens - 0.45 * total) <= 28 and big.most_copies == 1
    assert abs(small.tokens - 0.015 * total) <= 50 and small.most_copies <= 4 and small.n_docs == 10
    assert cap.tokens == 2 * 1000 and cap.most_copies == 2 and cap.n_docs == 10
    assert r[("m", "small2")].tokens == 0 and abs(sum(x.actual_share for k, x in r.items() if k[0] == "m") - 1) < 1e-5
    assert len(r) == 4


def test_sample_repeats_and_follows_weights(spark, sizes):
    t = targets(spark, ("m", "big", 1.0, 1, 0.2))
    a = {tuple(x) for x in mixture(sizes, t, 1).collect()}
    assert a == {tuple(x) for x in mixture(sizes, t, 1).collect()} != {tuple(x) for x in mixture(sizes, t, 2).collect()}
    n = [sum(1 for x in a if x[2] % 3 == k) for k in range(3)]
    assert n[0] < n[1] < n[2]
    assert mixture(sizes.limit(0), t).count() == 0 and mixture(sizes, t.limit(0)).count() == 0


def test_tokenizer_round_trip():
    e = encoding(default_tokenizer())
    for t in ("Hello  world\n\n", "Привет, мир 12345", "日本語", ""):
        assert e.decode(e.encode_ordinary(t)) == t


@pytest.mark.parametrize("weight", [0.025, 0.1, 1.0])
def test_small_weights_leave_no_large_last_bucket(spark, sizes, weight):
    """All keys of small weights lie beyond the first buckets; the edge is divided until it is small."""
    light = sizes.where("source = 'big'").withColumn("weight", F.lit(weight))
    t = targets(spark, ("m", "big", 1.0, 1, 0.3))
    fine, coarse = ({tuple(x) for x in mixture(light, t, 3, edge=e).collect()} for e in (20, 10**6))
    total = light.agg(F.sum("tokens")).first()[0]
    assert fine == coarse and abs(sum(x[3] for x in fine) - 0.3 * total) <= 28


def test_equal_keys_and_whole_source(spark):
    s = spark.createDataFrame([(7, "a", 1.0, 10)] * 5 + [(8, "a", 1.0, 10)], "doc_id bigint, source string, weight double, tokens bigint")
    r = mixture_report(s, targets(spark, ("m", "a", 1.0, 1, 0.5), ("n", "a", 1.0, 1, 1.0), ("o", "a", 1.0, 2, 1.0)), edge=1).collect()
    assert {x.mix: x.tokens for x in r} == {"m": 30, "n": 60, "o": 60}


def test_long_texts_count_whole(spark):
    e = encoding(default_tokenizer())
    texts = ["word  and, more\n\n " * 9000, "x" * 70_000 + " tail", "日本語 " * 30_000, "a b", None, ""]
    for t in texts[:3]:
        assert "".join(pieces(t, 1000)) == t and sum(len(e.encode_ordinary(x)) for x in pieces(t, 1000)) == len(e.encode_ordinary(t))
    d = spark.createDataFrame([(i, " S ", 200, t) for i, t in enumerate(texts)], "doc_id bigint, source string, http_status int, text string")
    assert {r.doc_id: r.tokens for r in token_sizes(d).collect()} == {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)}
