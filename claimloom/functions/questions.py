"""Classification of questions and claims by marker words, digests and cards (TX-8..10, TX-19, TX-26, TX-28, HD-7).

Words are compared in one spaced text, ``" word word "``, so that a marker with blanks on
both sides is a whole word and one with a blank in front is a beginning; this needs no
word boundaries, which engines define differently for scripts other than Latin.
Null texts are empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import scalars as S

PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Marker words of questions.
SIMPLE = ("кто", "где", "когда", "сколько", "какой", "какая", "какое", "на каком", "на какой", "есть ли", "что такое", "who", "where", "when", "how many", "which")
COMPLEX = ("почему", "зачем", "как устроен", "как работает", "как связан", "как поступ", "сравни", "объясни", "что если", "что делать", "в кризисе", "план",
           "стратег", "итог", "история", "все правила", "какие правила", "why", "how does", "compare", "explain")
AND = ("и", "или", "а  также", "плюс")
INTENTS = (
    ("sys_cmd", ("правил", "приказ", "можно ли", "разреш", "запрещ", "обязан", "должен", "нельзя", "что делать", "как поступ", "кризис")),
    ("persona_def", ("кто такой", "кто в команде", "роль", "роли", "личност", "кто принимает", "кто решает", "кто отвечает", "права")),
    ("world_state", ("сколько", "где", "порт", "адрес", "состояни", "на какой", "на каком", "стоит", "значение", "цена", "кошел", "модел", "желез")),
)
BUDGETS = (("simple", 5, 1200), ("medium", 10, 2500), ("complex", 20, 5000))
# Signs of the router of a claim, (router, weight, beginnings); a blank at the end makes a whole word.
ROUTER_SIGNS = (
    ("sys_cmd", 2.0, ("обязан", "запрещ", "нельзя", "не переделывать", "не откатывать", "не ограничиваем", "не возвращать", "не трогаем", "не тащить")),
    ("sys_cmd", 2.5, ("напомнить", "задача после", "после переезда")),
    ("sys_cmd", 2.0, ("обходные пути",)),
    ("sys_cmd", 0.4, ("дефолт ", "по умолчанию ")),
    ("persona_def", 3.0, ("роли команды ",)),
    ("persona_def", 2.5, ("личност", "характер", "семье ", "семья ", "слияни")),
    ("persona_def", 2.0, ("агент команды ", "оркестратор ")),
    ("persona_def", 3.0, ("тебе дан доступ ",)),
    ("persona_def", 1.5, ("пакт ",)),
    ("world_state", 1.5, ("порт", "адрес", "кошел", "эндпоинт", "лендинг", "http")),
    ("world_state", 1.0, ("настроен ", "настроено ", "живет ", "слушает ")),
    ("world_state", 1.0, ("постмортем", "отчет", "ledger")),
    ("world_state", 0.7, ("протокол", "api", "сервер", "модель", "фасилитатор", "маркет", "конкурент")),
    ("world_state", 0.7, ("это движок", "это платн", "это поиск", "это прото", "это кошел")),
)
MEASURE = r"(^|[^\p{L}\p{N}_])[0-9]{1,3}([.,][0-9]+)? ?(usdc|usd|\$|%|узл|байт|сдел|мс|порт|гб|gb)"
ROUTERS = ("sys_cmd", "persona_def", "world_state")


def spaced(c: Column, gap: str = " ") -> Column:
    return F.concat(F.lit(gap), F.array_join(F.regexp_extract_all(S.norm_text(c), F.lit(PIECES), F.lit(0)), gap), F.lit(gap))


def _has(text: Column, words: tuple[str, ...], end: str = "") -> Column:
    return S.any_of(text, tuple(f" {w}{end}" for w in words))


def question_class(q: Column, n_entities: Column | int = 0) -> Column:
    """TX-9: struct of complexity, score, n_words, intent, top_k and tokens; ``n_entities`` comes from `entities_of`."""
    n_entities = F.lit(n_entities) if isinstance(n_entities, int) else n_entities
    one, two = spaced(q), spaced(q, "  ")
    words = F.size(F.regexp_extract_all(S.norm_text(q), F.lit(r"[\p{L}\p{N}_$%.-]+"), F.lit(0)))
    count = lambda w: (F.length(two) - F.length(F.replace(two, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    joins = sum((count(w) for w in (*AND, ",", ";")), F.lit(0.0))
    asks = F.btrim(F.coalesce(q, F.lit(""))).endswith("?")
    score = (
        _has(one, COMPLEX, " ").cast("int") + (joins >= 2).cast("int") + F.when(words >= 14, 2).when(words >= 8, 1).otherwise(0)
        + (n_entities >= 3).cast("int") - (_has(one, SIMPLE, " ") & (words <= 8)).cast("int") - (asks & (words <= 3)).cast("int")
    )
    level = F.when(score <= 0, "simple").when(score <= 2, "medium").otherwise("complex")
    intent = F.coalesce(*[F.when(_has(one, w), r) for r, w in INTENTS], F.lit(""))
    pick = lambda i: F.when(level == BUDGETS[0][0], BUDGETS[0][i]).when(level == BUDGETS[1][0], BUDGETS[1][i]).otherwise(BUDGETS[2][i])
    return F.struct(level.alias("complexity"), score.alias("score"), words.alias("n_words"), intent.alias("intent"), pick(1).alias("top_k"), pick(2).alias("tokens"))


def entities_of(texts, ontology, key: str, text: str):
    """TX-8: ``(key, entity)`` for every text that holds a marker of an entity; ``ontology(entity, marker)`` is a stated table, in lower case."""
    return texts.select(key, S.norm_text(F.col(text)).alias("t")).join(ontology, F.contains(F.col("t"), F.col("marker"))).select(key, "entity").distinct()


def router_class(claim: Column, context: Column, kind: Column) -> Column:
    """TX-10: struct of router and margin between the best and the second score; ties go to sys_cmd, then persona_def."""
    text = F.concat(F.coalesce(claim, F.lit("")), F.lit(" "), F.substring(F.coalesce(context, F.lit("")), 1, 300))
    one, low = spaced(text), S.norm_text(text)
    got = {r: F.lit(0.0) for r in ROUTERS}
    for r, w, words in ROUTER_SIGNS:
        got[r] = got[r] + F.when(_has(one, words), w).otherwise(0.0)
    first = S.any_of(F.substring(one, 1, 9), (" правило ",)) | S.any_of(F.substring(one, 1, 8), (" приказ ",))
    got["sys_cmd"] = got["sys_cmd"] + F.when(first, 3.0).otherwise(0.0) + F.when(_has(one, ("приказ памяти", "правило памяти")) | low.rlike(r"(^|[^\p{L}\p{N}_])(приказ|правило) +[0-9]"), 2.0).otherwise(0.0)
    got["world_state"] = got["world_state"] + F.when(low.rlike(MEASURE), 1.5).otherwise(0.0)
    rule = F.coalesce(kind == "rule", F.lit(False))
    s = F.when(rule, got["sys_cmd"] + 1.5).otherwise(got["sys_cmd"])
    p = got["persona_def"]
    w = F.when(~rule & (got["world_state"] == 0), 0.5).otherwise(got["world_state"])
    best = F.greatest(s, p, w)
    second = s + p + w - best - F.least(s, p, w)
    router = F.when(best <= 0, "world_state").when(s == best, "sys_cmd").when(p == best, "persona_def").otherwise("world_state")
    return F.struct(router.alias("router"), F.when(best <= 0, 0.0).otherwise(F.round(best - second, 2)).alias("margin"))


def router_tags(tags: Column, claim: Column, context: Column, kind: Column) -> Column:
    """TX-10: exactly one router tag, the first one given, else the classified one, behind the other tags."""
    given = F.coalesce(tags, F.array().cast("array<string>"))
    is_router = lambda t: F.lower(t).isin(*ROUTERS)
    own = F.lower(F.get(F.filter(given, is_router), F.lit(0)))
    return F.concat(F.filter(given, lambda t: F.coalesce(~is_router(t), F.lit(True))), F.array(F.coalesce(own, router_class(claim, context, kind)["router"])))


def source_hash(claim: Column, context: Column, source: Column, evidence: Column) -> Column:
    """TX-19: fingerprint of the full text of a row; a changed one makes its levels stale."""
    parts = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in (claim, context, source)]), F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit(""))))
    return F.substring(F.sha1(F.array_join(parts, "\x1f")), 1, 12)


def first_sentence(c: Column, limit: int = 160) -> Column:
    """TX-26, EV-1: the text up to the first end mark before white space, cut at a word within ``limit`` characters."""
    one = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = F.regexp_extract(one, r"^(.*?[.!?…])(?: |$)", 1)
    head = F.when(F.length(head) > 0, head).otherwise(one)
    cut = F.regexp_extract(F.substring(head, 1, limit - 1), r"^(.*) ", 1)
    return F.when(F.length(head) <= limit, head).otherwise(F.concat(F.when(F.length(cut) > 0, cut).otherwise(F.substring(head, 1, limit)), F.lit("…")))


def context_tokens(c: Column) -> Column:
    """Tokens of a message: blank 0, else a quarter of its characters, rounded up."""
    return F.when(F.length(F.btrim(F.coalesce(c, F.lit("")))) == 0, 0).otherwise(F.ceil(F.length(c) / 4.0)).cast("int")


def card(id_: Column, claim: Column, mark: Column, limit: int = 80) -> Column:
    """HD-7, SC-16: one line ``id | claim [mark]``, long claims clipped."""
    c = F.btrim(F.regexp_replace(F.coalesce(claim, F.lit("")), r"\s+", " "))
    return F.concat(id_, F.lit(" | "), F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c), F.lit(" ["), mark.cast("string"), F.lit("]"))
