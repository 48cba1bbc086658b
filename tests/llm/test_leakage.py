import random

from claimloom.llm.leakage import leak_spans, leaks, without_leaks, word_places, words_of


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    return d, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def brute(docs, items, n):
    out = set()
    for d, t in enumerate(docs):
        dw = words_of(t or "")
        for i, x in enumerate(items):
            iw = words_of(x or "")
            k = min(n, len(iw))
            if k and {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} & {tuple(dw[j : j + k]) for j in range(len(dw) - k + 1)}:
                out.add((d, i))
    return out


def test_random_texts(spark):
    r = random.Random(5)
    word = lambda: r.choice("ab")
    docs = [" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(60)] + [None, "", "a" * 50_000]
    items = [" ".join(word() for _ in range(r.randrange(1, 9))) for _ in range(12)] + [None, "", "...", "a"]
    d, i = frames(spark, docs, items)
    assert {tuple(x) for x in leaks(d, i, 5).collect()} == brute(docs, items, 5)
    # several blocks of items give the same
    assert {(x.doc_id, x.item_id) for x in leak_spans(d, i, 5, block=10).collect()} == brute(docs, items, 5)
    assert leaks(d.limit(0), i).count() == leaks(d, i.limit(0)).count() == 0


def test_spans_and_cleaning(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = ["Start. ONE, two-three four\nfive six seven eight nine ten (eleven) twelve! End of a page that goes on for quite a while after this, with enough text to stay in.", item, "nothing here"]
    d, i = frames(spark, docs, [item, item])
    s = {(r.doc_id, r.item_id): docs[r.doc_id][r.span_start : r.span_end] for r in leak_spans(d, i).collect()}
    assert s[(0, 0)] == s[(0, 1)] == "ONE, two-three four\nfive six seven eight nine ten (eleven) twelve" and s[(1, 0)] == item and len(s) == 4
    c = {r.doc_id: (r.text, r.n_removed) for r in without_leaks(d, i).collect()}
    assert c[2] == ("nothing here", 0) and c[0][0].startswith("Start. !") and c[0][1] == len(s[(0, 0)]) and 1 not in c


def test_places_follow_folding():
    t = "Straße İx ﬁn"
    u = "Straße und Öl"
    assert [u[a:b] for a, b in word_places(u)] == ["Straße", "und", "Öl"]
    assert len(word_places(t)) == len(words_of(t))
