"""Verification of answers against the claims (GN-*, TX-22..24, AG-12, AG-13, JN-8).

Answers ``(answer_id, text)`` become claims, claims tokens, and tokens meet the postings
of the nodes.  A node supports a claim by its share of the claim's idf mass, a token that
no node has weighing as much as the rarest known one.  Only the rarest known tokens of a
claim look for candidates: CANDIDATE_TOKENS of them, all their nodes.  Answers made of
quotes (quote_verdicts) have every node that shares a token as a candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators.search import budget_idf, budget_postings, node_text
from claimloom.runtime import norm_id, staged

C = F.col
STRONG, WEAK, GROUNDED, PARTIAL = 0.60, 0.30, 0.80, 0.40
MAX_CLAIMS, MIN_TOKENS, CANDIDATE_TOKENS, TTL = 24, 2, 8, 3600
BROADCAST_TOKENS = 1 << 20
VERDICTS = ("supported", "partial", "unsupported", "refuted")
FIXED = -(1 << 62)
NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"


def split_claims(answers: DataFrame) -> DataFrame:
    """TX-22 in its look-around-free form: ``(answer_id, pos, claim)``, first MAX_CLAIMS assertions, repeats left out."""
    lines = F.regexp_replace(F.regexp_replace("text", r"([.!?…])\s+", "$1\n"), r"\s*;\s+|[\r\n]+", "\n")
    pieces = answers.select("answer_id", F.posexplode(F.split(lines, "\n")).alias("p", "raw"))
    clean = F.btrim(F.regexp_replace(F.regexp_replace("raw", r"[*`~]+", " "), r"^\s*(?:[-•—]|[0-9]+[.)])\s+", ""))
    kept = pieces.select("answer_id", "p", clean.alias("c")).where(~C("c").endswith("?"))
    kept = kept.select("answer_id", "p", F.regexp_replace("c", r"^[ \t\r\n\-—:;.!…]+|[ \t\r\n\-—:;.!…]+$", "").alias("claim")).where(F.size(S.budget_tokens(C("claim"))) >= MIN_TOKENS)
    first = kept.groupBy("answer_id", S.norm_text(C("claim")).alias("key")).agg(F.min(F.struct("p", "claim")).alias("x"))
    w = Window.partitionBy("answer_id").orderBy("x.p")
    return first.withColumn("pos", F.row_number().over(w)).where(C("pos") <= MAX_CLAIMS).select("answer_id", "pos", C("x.claim").alias("claim"))


def number_contexts(text: Column) -> Column:
    """TX-24: struct of the distinct numbers of a text and of "number, neighbour" pairs.

    Neighbours are stems: "=" of the word that holds the number, "<" of the word before, ">" of the word behind.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))
    stem = lambda w: F.coalesce(F.get(S.budget_tokens(w, 2), F.lit(0)), F.lit(""))
    places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("[0-9]"), i)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        near = F.array(*[F.concat(F.lit(mark), stem(F.get(words, i + k))) for mark, k in (("=", 0), ("<", -1), (">", 1))])
        nums = F.transform(F.regexp_extract_all(F.get(words, i), F.lit(NUMBER), F.lit(0)), S.norm_number)
        return F.transform(nums, lambda v: F.struct(v.alias("num"), F.transform(F.filter(near, lambda x: F.length(x) > 1), lambda x: F.concat(v, F.lit(" "), x)).alias("near")))

    found = F.flatten(F.transform(places, at))
    return F.struct(F.array_distinct(F.transform(found, lambda x: x["num"])).alias("nums"), F.array_distinct(F.flatten(F.transform(found, lambda x: x["near"]))).alias("near"))


def numbers_missing(wants: Column, has: Column) -> Column:
    """TX-24: how many numbers of a claim a node lacks, or has beside other words only; a number that stands alone on one side counts as it is."""

    def lacks(v: Column) -> Column:
        of = lambda p: p.startswith(F.concat(v, F.lit(" ")))
        common = F.exists(wants["near"], lambda p: of(p) & F.array_contains(has["near"], p))
        return ~F.array_contains(has["nums"], v) | (F.exists(wants["near"], of) & F.exists(has["near"], of) & ~common)

    return F.size(F.filter(wants["nums"], lacks))


def supports(snap: DataFrame, claims: DataFrame) -> DataFrame:
    """SR-14, SR-15: ``(answer_id, pos, id, seq, coverage, live)`` for each claim and candidate node.

    The rare tokens of a claim find its candidates, and their mass is summed in that join; only the frequent tokens
    beyond them are looked up in the tokens of the candidates.
    """
    own = F.array_distinct(S.budget_tokens(node_text()))
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    nodes = staged(snap.where("kind <> 'hub'").select("id", "seq", (~C("kind").isin("refuted", "outdated")).alias("live"), own.alias("own")), "node-tokens")
    post = nodes.select("id", F.explode("own").alias("token"))
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = staged(post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", F.round(F.ln(1 + n / C("df")), 6).alias("idf")), "idf")
    unseen = idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("m")).scalar()
    key = ["answer_id", "pos"]
    ct = claims.select(*key, F.explode(F.array_distinct(S.budget_tokens(C("claim")))).alias("token")).join(idf, "token", "left")
    mass = ct.groupBy(*key).agg(F.sum(F.coalesce("idf", unseen)).alias("mass"))
    known = staged(ct.where("idf is not null").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(C("idf").desc(), "token"))), "claim-tokens")
    found = known.where(C("r") <= CANDIDATE_TOKENS).join(post, "token").groupBy(*key, "id").agg(F.sum("idf").alias("rare"))
    rest = known.where(C("r") > CANDIDATE_TOKENS).groupBy(*key).agg(F.collect_list(F.struct(F.xxhash64("token").alias("t"), "idf")).alias("rest"))
    told = mass.join(rest, key, "left").withColumn("rest", F.coalesce("rest", F.array().cast("array<struct<t:bigint,idf:double>>")))
    more = F.aggregate("rest", F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains("h", t["t"]), t["idf"]).otherwise(0.0))
    j = found.join(told, key).join(nodes.select("id", "seq", "live", hashed(C("own")).alias("h")), "id")
    return j.select(*key, "id", "seq", F.round((C("rare") + more) / C("mass"), 6).alias("coverage"), "live")


def verify_claims(snap: DataFrame, claims: DataFrame) -> DataFrame:
    """GN-1: verdict of each claim from its best live and best stale support; a claim that several answers make is looked up once."""
    made = staged(claims.select("answer_id", "pos", "claim"), "claims")
    first = staged(made.groupBy("claim").agg(F.min(F.struct("answer_id", "pos")).alias("x")).select("x.*", "claim"), "claims-once")
    judged = verdicts(supports(snap, first), first, snap)
    named = first.join(judged, ["answer_id", "pos"]).drop("answer_id", "pos")
    return made.join(named, "claim").drop("claim")


def verdicts(s: DataFrame, claims: DataFrame, snap: DataFrame) -> DataFrame:
    """GN-1 over the supports ``s`` of the claims; numbers are compared for the best node of each side alone."""
    best = s.groupBy("answer_id", "pos", "live").agg(F.max(F.struct("coverage", (-C("seq")).alias("s"), "id")).alias("b")).withColumn("id", C("b.id"))
    texts = snap.join(best.select("id").distinct(), "id", "left_semi").select("id", number_contexts(node_text()).alias("has"))
    wants = claims.select("answer_id", "pos", number_contexts(C("claim")).alias("wants"))
    top = best.join(texts, "id").join(wants, ["answer_id", "pos"]).select("answer_id", "pos", "live", F.struct("b.coverage", "b.id", numbers_missing(C("wants"), C("has")).alias("missing")).alias("b"))
    side = lambda x, name: top.where(x).select("answer_id", "pos", C("b.coverage").alias(f"{name}_cov"), C("b.id").alias(f"{name}_id"), C("b.missing").alias(f"{name}_missing"))
    j = claims.select("answer_id", "pos").join(side("live", "l"), ["answer_id", "pos"], "left").join(side("not live", "s"), ["answer_id", "pos"], "left")
    stale_wins = (C("s_cov") >= STRONG) & (C("s_cov") >= F.coalesce("l_cov", F.lit(0.0)))
    cov, node, missing = F.coalesce("l_cov", "s_cov"), F.coalesce("l_id", "s_id"), F.coalesce("l_missing", "s_missing")
    verdict = F.when(stale_wins, "refuted").when((cov >= STRONG) & (missing == 0), "supported").when(cov >= WEAK, "partial").otherwise("unsupported")
    zero = F.lit(0.0)
    return j.select("answer_id", "pos", verdict.alias("verdict"), F.coalesce(F.when(stale_wins, C("s_cov")).otherwise(cov), zero).alias("coverage"), F.coalesce(F.when(stale_wins, C("s_id")).otherwise(node), F.lit("")).alias("support_id"))


def ratio_of_claims() -> Column:
    return F.coalesce((C("supported") + 0.5 * C("partial")) / F.nullif(C("total"), F.lit(0)), F.lit(0.0))


def answer_verdict() -> Column:
    """AG-12 over the counts of an answer's claims."""
    ratio = ratio_of_claims()
    return (
        F.when((C("total") == 0) | (C("supported") == 0), "ungrounded")
        .when(C("refuted") > 0, F.when(ratio < GROUNDED, "ungrounded").otherwise("partial"))
        .when((ratio >= GROUNDED) & (C("unsupported") == 0), "grounded")
        .when(ratio >= PARTIAL, "partial")
        .otherwise("ungrounded")
    )


def answer_verdicts(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """AG-12: verdict of an answer from those of its claims; an answer without claims is ungrounded."""
    n = lambda v: F.count_if(C("verdict") == v)
    per = verdicts.groupBy("answer_id").agg(n("supported").alias("supported"), n("partial").alias("partial"), n("unsupported").alias("unsupported"), n("refuted").alias("refuted"), F.count("verdict").alias("total"))
    j = answers.select("answer_id").distinct().join(per, "answer_id", "left").fillna(0)
    return j.select("answer_id", "supported", "partial", "unsupported", "refuted", "total", F.round(ratio_of_claims(), 6).alias("ratio"), answer_verdict().alias("verdict"))


def claims_of(text: Column) -> Column:
    """TX-22 within a row: the claims that split_claims makes of one answer, in order."""
    lines = F.regexp_replace(F.regexp_replace(text, r"([.!?…])\s+", "$1\n"), r"\s*;\s+|[\r\n]+", "\n")
    clean = F.transform(F.split(lines, "\n"), lambda raw: F.btrim(F.regexp_replace(F.regexp_replace(raw, r"[*`~]+", " "), r"^\s*(?:[-•—]|[0-9]+[.)])\s+", "")))
    told = F.transform(F.filter(clean, lambda c: ~c.endswith("?")), lambda c: F.regexp_replace(c, r"^[ \t\r\n\-—:;.!…]+|[ \t\r\n\-—:;.!…]+$", ""))
    kept = F.filter(told, lambda c: F.size(S.budget_tokens(c)) >= MIN_TOKENS)
    keyed = F.transform(F.array(kept), lambda cs: F.struct(cs.alias("claims"), F.transform(cs, S.norm_text).alias("keys")))
    first = F.transform(keyed, lambda x: F.filter(x["claims"], lambda c, i: F.array_position(x["keys"], S.norm_text(c)) == i + 1))
    return F.slice(F.get(first, F.lit(0)), 1, MAX_CLAIMS)


def arrived_first(nodes: DataFrame) -> DataFrame:
    """store.snapshot by leaving out the few rows that came again, so that no texts are shuffled; ``seq`` is unique."""
    keyed = nodes.withColumn("id", norm_id(C("id"))).where("id is not null")
    each = keyed.groupBy("id").agg(F.array_sort(F.collect_list("seq")).alias("x")).where(F.size("x") > 1)
    again = staged_alone(each.select(F.explode(F.slice("x", 2, F.size("x"))).alias("seq")), "came-again")
    return keyed.join(F.broadcast(again) if again.count() <= BROADCAST_TOKENS else again, "seq", "left_anti")


WORDS = range(4)


def bitmap(tokens: Column, name: str) -> list[Column]:
    """256 bits in which a set of tokens is looked through before the tokens themselves."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda i: F.filter(hashes, lambda h: h.bitwiseAND(F.lit(192)) == 64 * i)
    return [F.aggregate(of(i), F.lit(0).cast("bigint"), lambda a, h: a.bitwiseOR(bit(h))).alias(f"{name}{i}") for i in WORDS]


def staged_alone(df: DataFrame, name: str) -> DataFrame:
    """``staged``; the shuffle files of the write, which nothing reads again, are dropped with its end."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(key, before)


def quoted_claims(snap: DataFrame, texts: DataFrame, fixed: str, answers: list[Column | None], own: DataFrame) -> DataFrame:
    """The claims of each answer to a quote, with the mass that the quoted node has of them and the tokens that find a better node."""
    stats = staged_alone(own.select("live", F.explode_outer("own").alias("token")).where("token is not null").groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df"), F.max("live").alias("live")), "token-counts")
    n = own.count()
    least, vocabulary = stats.agg(F.min("df"), F.count(F.lit(1))).first()
    idf = lambda df: F.round(F.ln(1 + n / df), 6)
    unseen = F.lit(1.0) if least is None else idf(F.lit(least))
    small = vocabulary <= BROADCAST_TOKENS

    fixed_claims = texts.sparkSession.range(1).select(claims_of(F.lit(fixed))).first()[0]
    fix = F.array(*map(F.lit, fixed_claims)).cast("array<string>")
    spread = texts.repartition("seq")
    told = spread.select("seq", "text", "lacks", "more", fix.alias("fix"), F.array(*[fix if a is None else claims_of(a) for a in answers]).alias("forms")).withColumn("claims", F.array_distinct(F.flatten("forms")))
    words = F.array_distinct(F.flatten(F.array(*[S.budget_tokens(a) for a in answers if a is not None])))
    tokens = spread.select("seq", words.alias("words")).select("seq", F.explode_outer("words").alias("token"))
    known = tokens.join(F.broadcast(stats) if small else stats, "token").groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("df", "live").alias("v")))).alias("known"))
    quoted = told.withColumn("quoted", F.concat(F.array_except(S.budget_tokens(C("text")), C("lacks")), "more"))
    each = quoted.join(known, "seq", "left").select("seq", "quoted", "known", "forms", "fix", F.posexplode_outer("claims").alias("pos", "claim")).where("pos is not null")
    each = each.select("seq", "pos", "claim", "quoted", "known", F.transform("forms", lambda f: F.array_contains(f, C("claim"))).alias("held"), ((C("seq") != FIXED) & F.array_contains("fix", C("claim"))).alias("fixed"))
    # Claims that don't depend on the quote are judged once, with the text that is theirs.
    each = each.withColumn("tokens", F.when(~C("fixed"), F.array_distinct(S.budget_tokens(C("claim")))).otherwise(F.array().cast("array<string>")))

    def looked_up(t: Column) -> Column:
        one = F.transform(F.array(F.try_element_at("known", t)), lambda v: F.struct(F.coalesce(v["df"], F.lit(0)).alias("df"), t.alias("t"), F.when(v["df"] > 0, idf(v["df"])).otherwise(unseen).alias("idf"), F.array_contains("quoted", t).alias("own"), F.coalesce(v["live"], F.lit(False)).alias("live")))
        return F.get(one, F.lit(0))

    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, t: a + t["idf"])
    each = each.select("seq", "pos", "claim", "held", "fixed", F.array_sort(F.transform("tokens", looked_up)).alias("every"))
    each = each.select("seq", "pos", "claim", "held", "fixed", mass(C("every")).alias("mass"), F.filter("every", lambda t: t["df"] > 0).alias("ts"))
    each = each.select("*", mass(C("ts")).alias("reach"), mass(F.filter("ts", lambda t: t["own"])).alias("got"), F.exists("ts", lambda t: t["live"]).alias("any_live"))
    # A node that counts has as much mass as the quoted one, and what a verdict needs; the slack is more than coverages are rounded by.
    each = each.withColumn("need", F.greatest(C("got"), WEAK * C("mass")) - 1e-5 * C("mass"))
    down = lambda a, t, more: F.struct((a["left"] - t["idf"]).alias("left"), F.when(more, a["k"] + 1).otherwise(a["k"]).alias("k"))
    state = lambda left: F.struct(left.alias("left"), F.lit(0).alias("k"))
    looks = F.aggregate("ts", state(C("reach")), lambda a, t: down(a, t, a["left"] >= C("need")), lambda a: a["k"])
    may_lack = F.aggregate(F.reverse("ts"), state(C("reach") - C("need")), lambda a, t: down(a, t, a["left"] >= t["idf"]), lambda a: a["k"])
    # A token that the quoted node alone has finds no other.
    seeks = F.transform(F.filter(F.slice("ts", 1, C("looks")), lambda t: ~(t["own"] & (t["df"] == 1))), lambda t: t["t"])
    each = each.withColumn("spare", C("reach") - C("need")).withColumn("looks", looks).withColumn("may_lack", may_lack).withColumn("seeks", seeks)
    parts = F.when(F.size("seeks") > 0, F.transform("ts", lambda t: F.struct(t["t"].alias("t"), t["idf"].alias("idf"))))
    ties = C("reach") - C("got") < 1e-9
    return staged_alone(each.select("seq", "pos", "claim", "held", "fixed", "mass", "got", "need", "any_live", "spare", "may_lack", ties.alias("ties"), "seeks", parts.alias("parts")), "quoted-claims")


def better_supports(own: DataFrame, made: DataFrame) -> DataFrame:
    """``(seq, pos, node, live, coverage)`` of the nodes that may support a claim better than the node it quotes, or make it stale."""
    key = ["seq", "pos"]
    sought = made.where(F.size("seeks") > 0)
    wanted = staged_alone(sought.select(F.explode_outer("seeks").alias("token")).distinct(), "wanted-tokens")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted
    names = lambda x: [f"{x}{i}" for i in WORDS]
    # Bitmaps are made before rows are tokens.
    mapped = own.select(C("seq").alias("node"), "live", "own", *bitmap(C("own"), "n"))
    post = mapped.select("node", "live", *names("n"), F.explode_outer("own").alias("token")).join(wanted, "token", "left_semi")
    musts = F.transform(F.filter("parts", lambda p: p["idf"] > C("spare")), lambda p: p["t"])
    asks = sought.select(*key, "may_lack", "ties", "seeks", *bitmap(C("parts.t"), "c"), *bitmap(musts, "m"))
    asks = asks.select(*key, "may_lack", "ties", *names("c"), *names("m"), F.explode_outer("seeks").alias("token"))
    lack = lambda name: [C(f"{name}{i}").bitwiseAND(F.bitwise_not(C(f"n{i}"))) for i in WORDS]
    may = reduce(Column.__and__, [x == 0 for x in lack("m")]) & (sum(F.bit_count(x) for x in lack("c")) <= C("may_lack"))
    # Where the quoted node has all that any node has, a live node must come before it.
    late = C("ties") & C("live") & (C("node") > C("seq"))
    pairs = staged_alone(asks.join(post, "token").where((C("node") != C("seq")) & may & ~late).select(*key, "live", "node", (C("may_lack") == 0).alias("all_of")), "pairs")

    def tried(p: DataFrame) -> DataFrame:
        there = own.select(C("seq").alias("node"), F.transform("own", lambda t: F.xxhash64(t)).alias("h"))
        hashes, idfs = F.transform("parts", lambda x: F.xxhash64(x["t"])).alias("hashes"), F.transform("parts", lambda x: x["idf"]).alias("idfs")
        sums = sought.select(*key, "mass", "need", hashes, idfs)
        got = F.aggregate(F.zip_with("hashes", "idfs", lambda x, idf: F.when(F.array_contains("h", x), idf).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        summed = p.join(sums, key).join(there, "node").select(*key, "live", "node", "all_of", "mass", "need", got.alias("got"))
        return staged_alone(summed.select(*key, "live", "node", "all_of", F.round(C("got") / C("mass"), 6).alias("coverage"), (C("got") >= C("need")).alias("enough")), "supports")

    # Nodes that must have all known tokens of a claim are equal but for their place: the first that has them decides.
    first = pairs.where("all_of").groupBy(*key, "live", "all_of").agg(F.min("node").alias("node"))
    once = tried(first.unionByName(pairs.where("not all_of").distinct()))
    failed = once.where("all_of and not enough").select(*key, "live", C("node").alias("past"))
    again = tried(pairs.where("all_of").join(failed, [*key, "live"]).where("node > past").drop("past"))
    return once.unionByName(again).where("enough").select(*key, "node", "live", "coverage")


def quote_verdicts(snap: DataFrame, quotes: DataFrame, answers: list[Column | None], fixed: str) -> DataFrame:
    """GN-1, AG-12: ``(form, verdict, n)`` of answers made of quotes, form being the place in ``answers`` (Columns over "text", None for ``fixed`` itself).

    ``quotes(seq, text, whole)`` are texts of live nodes and the whole text of these nodes; ``fixed`` is a text that answers add. Every node that shares a
    token with a claim is a candidate. What the quoted node has of a claim is known without a search and is what another node must
    reach, so the rarest tokens, whose absence costs a node too much, find all that matter; most claims have one that no other node has.
    """
    own = snap.where("kind <> 'hub'").select("seq", (~C("kind").isin("refuted", "outdated")).alias("live"), F.array_distinct(S.budget_tokens(node_text())).alias("own"))
    # What the quoted node has of the answers: the tokens of the text but those lacking (it may end within a word), and any other it happens to have.
    tokens = quotes.select("seq", "text", S.budget_tokens(C("text")).alias("told"), F.flatten(F.array(*[S.budget_tokens(a) for a in answers if a is not None])).alias("every"), S.budget_tokens(C("whole")).alias("own"))
    facts = tokens.select("seq", "text", F.array_except("told", "own").alias("lacks"), F.array_intersect(F.array_except("every", "told"), "own").alias("more"))
    texts = facts.groupBy("text").agg(F.min(F.struct("seq", "lacks", "more")).alias("x"), F.count(F.lit(1)).alias("n")).select("x.*", "text", "n")
    alone = snap.sparkSession.range(1).select(F.lit(FIXED).alias("seq"), S.budget_tokens(F.lit(fixed)).alias("lacks"), F.array().cast("array<string>").alias("more"), F.lit(fixed).alias("text"), F.lit(0).cast("bigint").alias("n"))
    texts = staged_alone(texts.unionByName(alone), "texts")
    made = quoted_claims(snap, texts, fixed, answers, own)
    side = lambda x, v: F.max(F.when(x, v))
    better = better_supports(own, made).groupBy("seq", "pos").agg(side(C("live"), F.struct("coverage", (-C("node")).alias("s"))).alias("l"), side(~C("live"), C("coverage")).alias("stale"))
    quoted = F.when(C("got") > 0, F.struct(F.round(C("got") / C("mass"), 6).alias("coverage"), (-C("seq")).alias("s")))
    j = made.select("seq", "pos", "claim", "held", "fixed", "mass", "got", "any_live").join(better, ["seq", "pos"], "left").withColumn("l", F.greatest(F.coalesce("l", quoted), F.coalesce(quoted, C("l"))))
    # Below WEAK a coverage makes no difference, but that there is a live candidate does.
    live = F.coalesce("l.coverage", F.when(C("any_live"), 0.0))
    refuted = F.coalesce((C("stale") >= STRONG) & (C("stale") >= F.coalesce(live, F.lit(0.0))), F.lit(False))
    verdict = F.when(C("fixed"), None).when(refuted, "refuted").when(live >= STRONG, "supported").when(F.coalesce(live, C("stale")) >= WEAK, "partial").otherwise("unsupported")
    judged = staged_alone(j.select("seq", "pos", "held", "fixed", F.when(verdict.eqNullSafe("supported") | C("fixed") | (C("seq") == FIXED), C("claim")).alias("claim"), (-C("l.s")).alias("node"), verdict.alias("verdict")), "judged")
    # Numbers are compared for claims that are supported but for them.
    numbered = judged.where((C("verdict") == "supported") & C("claim").rlike("[0-9]")).select("seq", "pos", "node", number_contexts(C("claim")).alias("wants"))
    texts_of = snap.where("kind <> 'hub'").select(C("seq").alias("node"), number_contexts(node_text()).alias("has"))
    short = numbered.join(texts_of, "node").where(numbers_missing(C("wants"), C("has")) > 0).select("seq", "pos", F.lit(True).alias("short"))
    known = judged.join(short, ["seq", "pos"], "left").withColumn("verdict", F.when(C("short"), "partial").otherwise(C("verdict")))
    same = known.where(C("seq") == FIXED).select("claim", C("verdict").alias("fixed_verdict"))
    all_of = known.where(C("seq") != FIXED).join(F.broadcast(same), (known["claim"] == same["claim"]) & C("fixed"), "left").select("seq", "held", F.coalesce("verdict", "fixed_verdict").alias("verdict"))
    of = lambda i, v: F.count_if(C("held")[i] & (C("verdict") == v)).alias(f"{v}{i}")
    each = all_of.groupBy("seq").agg(*[of(i, v) for i in range(len(answers)) for v in VERDICTS])
    counts = F.array(*[F.struct(F.lit(i).alias("form"), *[C(f"{v}{i}").alias(v) for v in VERDICTS]) for i in range(len(answers))])
    rows = texts.where(C("seq") != FIXED).select("seq", "n").join(each, "seq", "left").fillna(0).select("n", F.inline(counts))
    rows = rows.withColumn("total", sum(C(v) for v in VERDICTS))
    return rows.groupBy("form", answer_verdict().alias("verdict")).agg(F.sum("n").alias("n"))


def with_prepass(judged: DataFrame, prepass: DataFrame) -> DataFrame:
    """GN-2: an answer whose session had no valid pre-pass is ungrounded, whatever its claims say; ``prepass(answer_id, prepass_id)`` has -1 for none."""
    ok = F.coalesce(C("prepass_id"), F.lit(-1)) >= 0
    j = judged.withColumnRenamed("verdict", "claims_verdict").join(prepass, "answer_id", "left")
    return j.select(*judged.drop("verdict").columns, "claims_verdict", ok.alias("pre_pass"), F.when(ok, C("claims_verdict")).otherwise("ungrounded").alias("verdict"))


def source_nodes(snap: DataFrame, claims: DataFrame, top: int = 3) -> DataFrame:
    """AG-13: nodes behind an answer with their best coverage, from the top supports of claims that are not unsupported.

    Supports are live nodes, and stale ones where a claim is refuted or has no live candidate.
    """
    s = staged(supports(snap, claims).where("coverage > 0"), "supports")
    judged = verdicts(s, claims, snap).where("verdict <> 'unsupported'").select("answer_id", "pos", "verdict")
    side = Window.partitionBy("answer_id", "pos")
    wanted = F.max("live").over(side) & (C("verdict") != "refuted")
    w = side.orderBy(C("coverage").desc(), "seq")
    best = s.join(judged, ["answer_id", "pos"]).withColumn("wanted", wanted).where(C("live") == C("wanted")).withColumn("r", F.row_number().over(w)).where(C("r") <= top)
    return best.groupBy("answer_id", "id").agg(F.max("coverage").alias("coverage"))


def live_source_nodes(snap: DataFrame, claims: DataFrame, top: int = 3) -> DataFrame:
    """The part of AG-13 with live nodes only, by the coverage of each node."""
    s = supports(snap, claims).where("live")
    w = Window.partitionBy("answer_id", "pos").orderBy(C("coverage").desc(), "seq")
    best = s.withColumn("r", F.row_number().over(w)).where((C("r") <= top) & (C("coverage") >= WEAK))
    return best.groupBy("answer_id", "id").agg(F.max("coverage").alias("coverage"))


def graph_first(snap: DataFrame, scored: DataFrame, queries: DataFrame, now: float, k: int = 10) -> DataFrame:
    """GN-3: whether the leader by coverage among the first k results answers the question by itself (six checks)."""
    from claimloom.operators.search import ranked

    idf = budget_idf(snap).select("token", "idf")
    unseen = idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("m")).scalar()
    qt = queries.select("qid", F.explode(F.array_distinct(S.budget_tokens(C("q")))).alias("token")).join(idf, "token", "left")
    mass = qt.groupBy("qid").agg(F.sum(F.coalesce("idf", unseen)).alias("mass"))
    got = qt.where("idf is not null").join(budget_postings(snap), "token").groupBy("qid", "id").agg(F.sum("idf").alias("got"))
    cov = ranked(scored, k).join(got, ["qid", "id"]).join(mass, "qid").select("qid", "id", "rank", F.round(C("got") / C("mass"), 6).alias("cov"))
    w = Window.partitionBy("qid").orderBy(C("cov").desc(), "rank")
    lead = cov.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("cov").over(w)).where("r = 1")
    j = lead.join(snap.select("id", "kind", "confidence", "valid_until", S.decayed(S.falsy(C("weight"), 0.05), C("kind"), S.iso_seconds(C("last_used")), now).alias("w")), "id")
    second = F.coalesce("second", F.lit(0.0))
    ok = (C("cov") >= 0.65) & (F.round("w", 6) >= 0.5) & (S.falsy(C("confidence"), 0.5) >= 0.5) & C("kind").isin("fact", "rule") & S.is_active(C("kind"), C("valid_until"), now) & ((second <= 0) | (C("cov") >= F.round(second * 1.15, 6)))
    return j.select("qid", C("id").alias("node_id"), C("cov").alias("coverage"), ok.alias("hit"))


def prepass_asof(log: DataFrame, seconds: Column, ttl: float = TTL) -> DataFrame:
    """JN-8: for each ground record the latest earlier prepare record of its session that named nodes, valid for ``ttl`` seconds.

    One session may hold a third of all records, so the look-back is not one window over a session: time is cut into
    slots of ``ttl``; a valid pre-pass lies in the slot of the ground record or the one before.
    """
    rows = log.where("session_id is not null").select("rec_id", "event", "session_id", seconds.alias("t"), F.size(F.coalesce("node_ids", F.array().cast("array<string>"))).alias("n"))
    rows = rows.withColumn("slot", F.floor(C("t") / ttl))
    prep = rows.where("event = 'prepare' and n > 0").select("session_id", "slot", C("t").alias("pt"), C("rec_id").alias("prepass_id"))
    g = rows.where("event = 'ground'").select("rec_id", "session_id", "t", F.explode(F.array(C("slot"), C("slot") - 1)).alias("slot"))
    j = g.join(prep, ["session_id", "slot"]).where((C("pt") < C("t")) & (C("t") - C("pt") <= ttl))
    best = j.groupBy("rec_id").agg(F.max(F.struct("pt", "prepass_id")).alias("b"))
    return rows.where("event = 'ground'").select("rec_id").join(best, "rec_id", "left").select("rec_id", F.coalesce("b.prepass_id", F.lit(-1)).alias("prepass_id"))
