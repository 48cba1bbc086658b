"""Scalar semantics that all operators share, as Columns (§1.4, TX-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (§7.8).
HALF_LIFE_H, WEIGHT_FLOOR, RULE_FLOOR = 168.0, 0.05, 0.5
ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
DATES = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
TICKERS, NUMBERS = r"(?<![\p{L}\p{N}_])[A-ZА-Я][A-ZА-Я0-9]{1,11}(?![\p{L}\p{N}_])", r"[0-9]+(?:[.,][0-9]+)?"
STOP_WORDS = """который которая которое которые этот эта это эти было были будет может можно нужно только после перед через если чтобы
также тоже ещё еще как что при для или над под уже все всех него нет без there with from that this have контекст основание вывод правило приказ"""
GATE_STOP_WORDS = """что это как так вот ещё уже был была было были будет будут очень просто который которая которые такой такая такие сам
сама сами всего только тоже даже здесь там тут потом потому поэтому например какой какая какие свой своя свои"""
HEDGES = ("наверное", "наверно", "кажется", "возможно", "вероятно", "похоже", "вроде", "вроде бы", "думаю", "полагаю", "не уверен", "не уверена",
          "вряд ли", "как будто", "якобы", "предположительно", "примерно", "может", "probably", "maybe", "i think", "i guess", "not sure", "possibly",
          "perhaps", "seems", "apparently", "supposedly")
CERTAIN = ("точно", "факт", "подтверждено", "подтверждён", "гарантированно", "измерено", "проверено", "100%", "certainly", "definitely", "confirmed",
           "verified", "measured", "checked")
VOLATILE = ("курс", "цена", "ценник", "статус", "баланс", "версия", "погода", "онлайн", "offline", "доступ", "занят", "свободен", "аптайм", "uptime",
            "price", "status", "balance", "version", "online", "капитализация")
TIER_A = ("отчёт", "отчет", "офиц", "документ", "док.", "таблиц", "лог", "измер", "протокол", "спецификац", "данные сенсора", "метрики", "report",
          "document", "official", "log", "measured", "spec", "metrics", "api ")
TIER_C = ("слух", "кто-то", "говорят", "интернет", "chatgpt", "не помню", "в чате", "слышал", "сплетни", "не уверен", "rumor", "someone", "heard",
          "internet", "i don't remember", "где-то прочитал", "кажется из разговора")
NEGATIONS = ("не ", "нет", "никогда", "отсутствует", "недоступн", "не работает", "не было", "не вырос", "упал", "сломан", "потерян", "no ", "not ",
             "never", "unavailable", "down", "offline", "failed", "без ")
DECISIONS = ("approve", "reject", "одобр", "отклон", "да", "нет", "long", "short", "buy", "sell", "лонг", "шорт", "покуп", "прода", "pass", "fail",
             "вход", "выход", "халт", "halt", "стоп", "hold")


def iso_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 string; naive means UTC; junk gives null (TX-31)."""
    x = F.btrim(c)
    base = F.concat(F.regexp_extract(x, ISO, 1), F.lit(" "), F.coalesce(F.nullif(F.regexp_extract(x, ISO, 2), F.lit("")), F.lit("00:00:00")))
    zone = F.regexp_extract(x, ISO, 3)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    shift = F.when(F.length(zone) == 6, sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60)).otherwise(0)
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), base.try_cast("timestamp_ntz"))
    return F.when(x.rlike(ISO), at / 1e6 - shift)


def falsy(c: Column, default: float) -> Column:
    """The default for null and zero, as truthiness has it."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def weight_floor(kind: Column) -> Column:
    return F.when(kind.isin("rule", "hub"), RULE_FLOOR).otherwise(WEIGHT_FLOOR)


def decayed(weight: Column, kind: Column, ref: Column, now: float, half_life: float = HALF_LIFE_H) -> Column:
    """w * 0.5^(hours / half-life), not below the floor; without reference time, or before it, w stays."""
    w = weight * F.pow(F.lit(0.5), (F.lit(now) - ref) / 3600.0 / half_life)
    return F.when(ref.isNull() | (F.lit(now) <= ref), weight).otherwise(F.greatest(weight_floor(kind), w))


def is_active(kind: Column, valid_until: Column, now: float) -> Column:
    until = iso_seconds(valid_until)
    return ~F.coalesce(kind, F.lit("fact")).isin("refuted", "outdated") & (until.isNull() | (F.lit(now) < until))


def canonical_key(claim: Column) -> Column:
    return F.lower(F.btrim(claim))


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether lower-case text contains one of the markers; the text is made once for all of them."""

    def hit(t: Column) -> Column:
        found = F.lit(False)
        for m in markers:
            found = found | F.contains(t, F.lit(m))
        return found

    return F.exists(F.array(text), hit)


def norm_text(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def budget_tokens(c: Column, min_len: int = 3) -> Column:
    """Stems of six letters of words, other tokens whole; without stop stems, node ids and short tokens (TX-2)."""
    stops = sorted({w.replace("ё", "е")[:6] for w in STOP_WORDS.split()} | {w[:6] for w in STOP_WORDS.split()})
    raw = F.regexp_extract_all(norm_text(c), F.lit("[a-zа-я0-9_./-]{2,}"), F.lit(0))
    stripped = F.transform(raw, lambda w: F.regexp_replace(w, r"^[./-]+|[./-]+$", ""))
    kept = F.filter(stripped, lambda w: (F.length(w) >= min_len) & ~w.rlike("^mn_[0-9a-f]{12}(?![a-zа-я0-9_])"))
    stems = F.transform(kept, lambda w: F.when(w.rlike("^[а-яa-z]+$"), F.substring(w, 1, 6)).otherwise(w))
    return F.filter(stems, lambda s: ~s.isin(stops))


def gate_tokens(c: Column) -> Column:
    """Words of three characters or more and numbers of two digits or more, without stop words (TX-3)."""
    stops = sorted(set(GATE_STOP_WORDS.split()))
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s$%]", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 0)
    return F.filter(words, lambda w: ((F.length(w) >= 3) | ((F.length(w) >= 2) & w.rlike(r"^\p{Nd}+$"))) & ~w.isin(stops))




def content_tokens(c: Column) -> Column:
    return gate_tokens(F.regexp_replace(F.coalesce(c, F.lit("")), DATES, " "))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))


def salient(c: Column, strict_parity: bool = False) -> Column:
    """Numbers, tickers and decision words of a claim without its dates, sorted (TX-6).

    strict_parity trims every trailing 0 and full stop, so that 10 equals 1; by default only a fraction loses its zeros.
    """
    text = F.regexp_replace(F.coalesce(c, F.lit("")), DATES, " ")

    def found(text: Column, low: Column) -> Column:
        nums = F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), lambda x: F.translate(x, ",", "."))
        if strict_parity:
            nums = F.transform(nums, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, r"[.0]+$", ""), F.lit("")), F.lit("0")))
        else:
            nums = F.transform(nums, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
        tickers = F.regexp_extract_all(text, F.lit(TICKERS), F.lit(0))
        words = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in DECISIONS]))
        return F.array_sort(F.array_distinct(F.concat(nums, tickers, words)))

    # The text and its lower case are made once, not for each word looked for.
    once = F.struct(text.alias("text"), F.lower(text).alias("low"))
    return F.get(F.transform(F.array(once), lambda x: found(x["text"], x["low"])), F.lit(0))


def has_negation(c: Column) -> Column:
    return any_of(F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" ")), NEGATIONS)


def source_tier(c: Column) -> Column:
    """A, B or C; a blank source is C, and A wins over C (TX-29)."""
    s = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    return F.when(F.length(s) == 0, "C").when(any_of(s, TIER_A), "A").when(any_of(s, TIER_C), "C").otherwise("B")


def estimate_tokens(c: Column) -> Column:
    """Blank 0, else at least 1: Cyrillic characters / 2.6 + others / 4, rounded up."""
    cyr = F.length(F.regexp_replace(c, "[^а-яёА-ЯЁ]", ""))
    n = F.ceil(F.round(cyr / 2.6 + (F.length(c) - cyr) / 4.0, 9))
    return F.when(F.coalesce(F.length(F.btrim(c)), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), n)).cast("int")


def norm_number(c: Column) -> Column:
    x = F.translate(c, ",", ".")
    cut = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.+$", ""), F.lit("")), F.lit("0"))
    return F.when(F.contains(x, F.lit(".")) & ~F.contains(x, F.lit(":")), cut).otherwise(x)


def stem_en(w: Column) -> Column:
    """Inflectional English stem: ies to y, ing and ed, es behind a sibilant, s (TX-12)."""
    n = F.length(w)

    def without(k: int) -> Column:
        return F.left(w, F.greatest(n - k, F.lit(0)))

    return (
        F.when(w.rlike("ies$") & (n >= 6), F.concat(without(3), F.lit("y")))
        .when(w.rlike("ing$") & (n >= 6), without(3))
        .when(w.rlike("ed$") & (n >= 5), without(2))
        .when(w.rlike("(?:s|x|z|ch|sh)es$") & (n >= 5), without(2))
        .when(w.rlike("[^s]s$") & (n >= 4), without(1))
        .otherwise(w)
    )


def hub_id(entity: Column) -> Column:
    return F.concat(F.lit("mn_"), F.substring(F.sha1(F.concat(F.lit("hub:"), entity)), 1, 12))
