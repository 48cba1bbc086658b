from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.runtime import map_batches, staged

#: documents, on two hosts or more, from which on a line recurs
RECURS = 3
FILLER_SHARE, MESSAGE_SHARE = 0.15, 0.5

# Words of the common filler text.
LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
    veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse
    cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
# Phrase rules: what the words of a message say, whatever line they stand in. Each is (kind, patterns that must all be found) on a masked line.
_NOUN = r"\b(?:pages?|files?|address(?:es)?|urls?|links?|documents?|resources?|sites?|websites?|listings?|items?|articles?|products?|posts?|content|requests?|views?)\b"
_GONE = r"(?:\b(?:not|n't|never|cannot|can't|unable to|failed to|could ?n[o']t)\b.{0,25}\b(?:find|found|located?|load(?:ed)?|open(?:ed)?|exists?(?:ed)?|available|reached|served?|displayed|processed|completed)\b|\bno longer\b|\b(?:has|have|was|were|been)\b.{0,12}\b(?:removed|deleted|moved|withdrawn|expired)\b|\b(?:unavailable|missing)\b)"
_SCRIPT = r"(?:java ?scripts?|\bscripts?\b|\bscripting\b|\bjs\b|скрипт|脚本|腳本|スクリプト|자바스크립트|جافا ?سكريبت)"
RULES = tuple(
    (kind, tuple(re.compile(p) for p in parts))
    for kind, *parts in (
        ("script", _SCRIPT, r"\b(?:enabled?|enabling|activated?|allow(?:ed)?|permit|turn(?:ed)?|switch(?:ed)?|disabled?|blocked|off|requires?d?|needs?(?:ed)?|supports?(?:ed)?|must|without|missing|unavailable)\b|aktivier|einschalt|ausgeschaltet|benötig|erforder|\bactiv|\bhabilit|\bdesactiv|désactiv|requier|requiert|nécess|necesi|abilit|attiva|\bativ|włącz|inschakel|включ|отключ|требу|необходим|разреш|启用|开启|打开|啟用|禁用|需要|有効|無効|必要|オン|활성화|필요|تفعيل|تمكين"),
        ("error", _NOUN, _GONE),
        ("error", r"\b(?:can't|cannot|could not|couldn't|unable to|failed to)\b (?:\w+ )?\b(?:find|locate|load|open|display|reach|connect|establish|process|complete|serve|show)\b"),
        ("error", r"\b(?:something|anything)\b.{0,12}\b(?:went wrong|broke|failed)\b|\b(?:an?|unexpected|unknown|internal|fatal|server|database|application|runtime)\b.{0,20}\b(?:error|failure|exception|fault)\b(?:.{0,12}\b(?:occurred|happened|encountered)\b|\W*$)|\berror code\b|\berror 0\b|\berror (?:establishing|connecting|loading|opening|processing|retrieving|reading)\b"),
        ("error", r"\b(?:access|permission|request|entry)\b.{0,15}\b(?:denied|forbidden|refused|blocked|rejected|restricted)\b|\b(?:not|n't)\b.{0,20}\b(?:allowed|authori[sz]ed|permitted|permission|access)\b"),
        ("error", r"\b(?:server|service|site|website|database|system|host|gateway|connection|we)\b.{0,30}\b(?:unavailable|down|offline|maintenance|overloaded|timed out|unreachable|not responding|busy)\b"),
        ("error", r"\btoo many (?:requests|attempts|connections)\b|\brate limit|\b(?:try|retry|reload|come back|check back)\b.{0,20}\b(?:later|again|soon|minutes?|moment)\b"),
        ("error", r"(?:seite|adresse|datei|dokument|inhalt|artikel|angebot)\b.{0,40}(?:nicht (?:gefunden|mehr|verfügbar|vorhanden)|existiert|gelöscht|entfernt|gibt es)|konnten? .{0,40}nicht .{0,20}(?:gefunden|geladen|gefunden werden|finden|öffnen)|zugriff .{0,12}(?:verweigert|gesperrt)|keine berechtigung|(?:server|interner |datenbank)-?fehler|fehler .{0,15}aufgetreten|etwas ist schief|später .{0,15}(?:erneut|nochmals|noch einmal|wieder)|wartungsarbeiten|(?:nicht erreichbar|nicht verfügbar)\W*$"),
        ("error", r"\bintrouvable|n[’']existe (?:plus|pas)|n[’']a(?:vons)? pas (?:été |pu )?(?:être )?trouv|n[’']est (?:plus|pas) (?:disponible|accessible)|accès (?:refusé|interdit)|pas (?:l[’']autorisation|autorisé)|erreur (?:interne|du serveur|est survenue|s[’']est produite)|(?:probl.me|erreur).{0,12}(?:survenue?|produite?)|(?:réessayer|réessayez|revenez).{0,20}(?:plus tard|minutes|instants)|(?:indisponible|en maintenance)\b"),
        ("error", r"\bno (?:se )?(?:ha(?:n)? )?(?:podido |pudo |puede )?(?:encontr|existe\b|disponible|está disponible)|ya no existe|acceso (?:denegado|prohibido)|no tiene (?:permiso|acceso)|error (?:interno|del servidor)|(?:ocurrido|producido) un (?:error|problema)|algo salió mal|(?:inténtelo|intente|vuelva).{0,25}(?:más tarde|nuevo|minutos)|en mantenimiento\b"),
        ("error", r"\bnon (?:è stat[ao] )?(?:trovat[ao]|esiste|disponibile)|accesso negato|errore (?:interno|del server)|riprova|não (?:foi )?(?:encontrad[ao]|existe|disponível)|acesso negado|erro (?:interno|do servidor|\d)|tente novamente|niet gevonden|bestaat niet|toegang geweigerd|probeer het later|nie znaleziono|nie istnieje|odmowa dostępu|spróbuj ponownie"),
        ("error", r"не найден|не существует|не удалось|(?:страниц|адрес|файл|документ).{0,30}(?:удал[её]н|перемещ|недоступ)|доступ.{0,40}(?:запрещ|закрыт|ограничен)|нет (?:прав|доступа|разрешения)|(?:внутренняя )?ошибка (?:сервера|базы|соединения|подключения)|(?:произошла|возникла) ошибка|(?:временно |сейчас )(?:не ?доступ|не работает)|технически[ех] работ|(?:попробуйте|повторите|зайдите).{0,25}(?:позже|позднее|ещё раз|снова)"),
        ("error", r"(?:页面|網頁|网页|地址|文件|内容|链接|頁面).{0,12}(?:不存在|删除|刪除|移动|失效|下架)|找不到|未找到|无法(?:找到|打开|访问|显示|连接|加载)|無法(?:找到|開啟|存取)|(?:拒绝|禁止|被拒)访问|访问.{0,4}(?:被拒|受限)|(?:没有|無|无)(?:权限|權限)|(?:服务器|伺服器|系统|数据库|内部).{0,4}(?:错误|錯誤|异常|繁忙|故障)|(?:稍后|稍候|稍後|以后)(?:再|重)试?|暂时(?:不可用|无法)|(?:正在|系统)维护|出错了"),
        ("error", r"見つかりません|(?:削除|移動)(?:された|した).{0,3}(?:か|可能性)|(?:ページ|ファイル|アドレス|url).{0,15}(?:存在しません|削除|移動|ありません)|アクセス.{0,6}(?:拒否|禁止|できません|権限)|権限がありません|(?:サーバー?|内部|システム|データベース).{0,6}(?:エラー|障害)|エラーが発生|(?:しばらく|後ほど|後で|時間を).{0,15}(?:お試し|試して|アクセス|再度)|(?:利用|表示|接続)できません|メンテナンス中|찾을 수 없|존재하지 않|접근.{0,6}거부|오류가 발생|다시 시도|غير موجود|تم رفض|حدث خطأ"),
        ("filler", r"\b(?:your|sample|example|placeholder|dummy|filler|test|demo|default|some)\b (?:\w+ )?\b(?:text|copy|content|title|heading|headline|paragraph|description|caption|intro|subtitle|message)\b.{0,25}(?:\b(?:here|goes|below|soon|block|section|replace|launch|follows)\b|\W*$)|\b(?:text|copy|content|title|heading|headline|paragraph|description|caption|intro|subtitle)\b (?:goes|comes|will (?:go|appear|be|follow)|to (?:come|follow|be)|coming)\b"),
        ("filler", r"^\W*(?:no (?:description|text|content|title|caption|image|summary)\W*)+$|\bunder construction\b|\bcoming soon\b|^\W*(?:todo|tbd|tba|fixme)\b\W*(?::|$)|\bto be (?:added|written|filled|completed|announced|determined)\b|\bclick (?:here )?to (?:edit|add|change)\b|\b(?:edit|change|replace) this (?:text|copy|content|paragraph|block|heading|title)\b|\b(?:add|insert|write|type|enter|put|place) (?:a |an |your |some |the )?(?:\w+ )?(?:text|copy|content|title|heading|paragraph|description|intro)\b"),
        ("filler", r"(?:hier|beispiel|muster|platzhalter|blind|dummy)[ -]?(?:steht |kommt |folgt )?(?:ihr |der |dein )?(?:text|titel|inhalt)|(?:beschreibung|text|inhalt|titel) (?:folgt|kommt)|text(?:o|e) (?:de|d[’'])\s?(?:ejemplo|exemple|relleno|prueba|remplissage)|(?:escriba|escribe|introduzca|inserte) (?:aquí |su |tu )|(?:votre|saisissez|écrivez|insérez).{0,12}(?:texte|titre|contenu).{0,8}(?:ici|$)|(?:texte|contenu|description|descripción|contenido) (?:à venir|à compléter|próximamente|pendiente)|en (?:construcción|construction)\b"),
        ("filler", r"(?:здесь|тут) (?:будет|появится|должен).{0,20}(?:текст|описан|заголов|контент)|(?:текст|описание|контент|заголовок).{0,12}(?:скоро|появится|будет добавлен|заглушк)|(?:пример|образец) текста|в разработке\W*$|(?:示例|占位|测试|样例|範例)(?:文字|文本|内容)|(?:内容|描述|介绍|简介)(?:待|即将|稍后)|(?:敬请期待|建设中|準備中|工事中|近日公開)|(?:ここ|こちら)に.{0,10}(?:文章|テキスト|本文|タイトル).{0,4}(?:入|書|記)|(?:サンプル|ダミー)(?:テキスト|文章)"),
    )
)
#: Characters up to which a line can be a message by the phrase rules: of a line that recurs, of any other.
RECUR_CHARS, LONE_CHARS = 240, 120
#: Words of one who writes about messages.
ABOUT = re.compile(r"\b(?:says?|said|wrote|writes|reported|called|known as|commonest|message was|messages|last (?:week|month|year)|yesterday|for example|such as|means)\b|[\"“”«»„「『]")
REASONS = (
    "not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|service unavailable|internal server error|gone|request time-?out|"
    "method not allowed|not acceptable|conflict|payload too large|too many requests|web server is down|origin is unreachable|connection timed out|"
    "not implemented|unavailable for legal reasons|payment required"
)
ERROR_LINE = re.compile(rf"(?:(?:error|http|erreur|fehler|ошибка|status)?[ :#]*0[ :.–-]*(?:{REASONS})|(?:{REASONS}) \((?:code|error|status|http) 0\)|(?:{REASONS})|ref [0-9a-f]+|edge/[0.]+|(?:error|erreur|fehler|ошибка|http|エラー|错误) ?0\.?|(?:php )?(?:fatal error|parse error|warning|notice|exception)\b.{{0,300}} on line 0\.?|traceback \(most recent call last\):?|the requested url \S+ (?:could not be served|was not found on this server)\.?)")
MASK = re.compile(r"https?://\S+|\S+@\S+\.\S+|\d[\d.,:/-]*\d|\d")
PLACEHOLDER = re.compile(
    r"\{\{\s*[A-Za-z][\w.]*\s*\}\}|\{%\s*[A-Za-z][\w.]*\s*%\}|<%=?\s*[A-Za-z][\w.]*\s*%>|[$#]\{[A-Za-z][\w.]*\}|%[A-Za-z][\w.]{2,}%|"
    r"\[\[[A-Za-z][\w.]*\]\]|\[(?:INSERT|YOUR|ENTER|Insert|Your|Enter|insert|your|enter) [\w. ]+\]|\[[A-Za-z][A-Za-z_.]{2,}\]|<<[A-Za-z][\w.]*>>|"
    r"<(?!/?(?:p|br|b|i|u|a|em|strong|div|span|li|ul|ol|h\d|table|tr|td|img|hr|code|pre|html|head|body|title|script|style|link|meta|form|input|sup|sub|small)\b)[A-Za-z][\w.]*>|"
    r"__[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*__|@@[A-Za-z][\w.]*@@|\*\|[A-Za-z][\w.]*\|\*|(?<![{$#])\{[A-Za-z][\w.]*\}(?!\})"
)
EXPLAINS = re.compile(
    r"written as|says? that|for example|such as|fields? like|(?:is|are|gets?|be) (?:replaced|substituted|expanded)|(?:is|are) read from|fills? (?:it|them) in|stands? for|means\b|syntax|placeholder|variables? |e\.g\.|escaped|denotes?",
    re.I,
)
STOP = re.compile(r"[.!?。！？…]['\"”»)\]]*(?:\s|$)|\n")
SPACE = re.compile(r"\s+")


def masked(line: str) -> str:
    """Key of a line: lower case, single blanks, numbers and addresses masked."""
    line = SPACE.sub(" ", line).strip().casefold()
    return MASK.sub(lambda m: "0" if m[0][0].isdigit() else "u", line)


def line_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def line_kind(key: str) -> str | None:
    """Kind of a masked line by its form alone: a status line, or the common filler text."""
    if ERROR_LINE.fullmatch(key):
        return "error"
    words = key.split(" ")
    if len(words) >= 8 and sum(w.strip(".,;:!?") in LOREM for w in words) >= 0.6 * len(words):
        return "filler"
    return None


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands where a value should be: no sentence round it explains it."""
    for m in PLACEHOLDER.finditer(text):
        lo = 0
        for s in STOP.finditer(text, max(0, m.start() - 300), m.start()):
            if s[0] != "\n":
                lo = s.end()
        lo = max(lo, m.start() - 300)
        s = next((x for x in STOP.finditer(text, m.end(), m.end() + 300) if x[0] != "\n"), None)
        hi = s.start() if s else min(len(text), m.end() + 300)
        if not EXPLAINS.search(SPACE.sub(" ", text[lo : m.start()] + " _ " + text[m.end() : hi])):
            return True
    return False


FOOTER = re.compile(r"\W{0,4}.{0,6}?[©?�\W]?\s?0 \S{1,60}")
CJK = re.compile("[぀-鿿]")


def _label(key: str) -> bool:
    """Titles and links: a few words without an end mark."""
    if key[-1] in ".!?…。！？:;,":
        return False
    return len(key) <= 20 if CJK.search(key) else len(key) <= 70 and key.count(" ") <= 3


def _repeats(key: str) -> bool:
    """One or two words over and over."""
    words = [w for x in key.split(" ") if (w := x.strip(".,;:!?"))]
    return len(words) >= 3 and len(set(words)) <= max(1, len(words) // 3) and words[0].isalpha()


@lru_cache(maxsize=1 << 16)
def told_kind(key: str) -> str | None:
    """Kind of a masked line by what its words say."""
    if len(key) > RECUR_CHARS or ABOUT.search(key):
        return None
    for kind, parts in RULES:
        if all(p.search(key) for p in parts):
            return kind
    return "filler" if _repeats(key) else None


def rule_kind(key: str, recurs: bool) -> str | None:
    """The same, as far as the length of the line allows: one that recurs on several hosts is told so at greater length, a lone one must be short."""
    return told_kind(key) if recurs or len(key) <= LONE_CHARS else None


#: What a line counts as.
BODY, FILLER, MESSAGE, NOTHING = range(4)
CHARSETS = ("utf-8", "cp1251", "koi8-r", "gb18030", "euc-jp", "shift_jis", "big5")
CYRILLIC = re.compile("[Ѐ-ӿ]+")
WIDE_LATIN = re.compile("[À-ÿ]")
OTHER_LETTERS = re.compile("[Ѐ-ӿ぀-ヿ㐀-鿿가-힣]")


def repaired(text: str, declared: str | None) -> str:
    """The text in the charset that its bytes show, if they were read in the wrong single-byte one."""
    if text.isascii() or not declared or OTHER_LETTERS.search(text):
        return text
    letters = sum(map(str.isalpha, text))
    if 3 * len(WIDE_LATIN.findall(text)) < letters:
        return text
    try:
        raw = text.replace("\ufffd", "?").encode(declared.strip().strip("\"'"), "replace")
    except LookupError:
        return text
    for sent in CHARSETS:
        read = raw.decode(sent, "replace")
        # Two-byte text read as Cyrillic, or one Cyrillic set as the other, has capitals inside words.
        words = CYRILLIC.findall(read)
        cased = sum(len(w) for w in words if w[1:] == w[1:].lower())
        if 10 * read.count("\ufffd") <= len(read) and 5 * cased >= 4 * sum(map(len, words)) and 2 * len(OTHER_LETTERS.findall(read)) >= sum(map(str.isalpha, read)):
            return read
    return text


@lru_cache(maxsize=1 << 16)
def readings(key: str) -> tuple[int, int]:
    """What a masked line counts as if it is alone, and if it recurs."""
    of = {"filler": FILLER, "script": MESSAGE, "error": MESSAGE}
    form = line_kind(key)
    if form:
        return of[form], of[form]
    alone, wide = rule_kind(key, False), rule_kind(key, True)
    if alone:
        return of[alone], of[wide or alone]
    left = NOTHING if _label(key) or (len(key) < 70 and FOOTER.fullmatch(key)) else BODY
    return left, of[wide] if wide else NOTHING


def page_lines(text: str) -> list[str]:
    """Masked lines; menus and paths come apart at their separators."""
    out = []
    for line in text.split("\n"):
        key = masked(line)
        whole = readings(key)[0] if key else NOTHING
        out += [x for p in re.split(r"[|>]", key) if (x := p.strip())] if whole in (BODY, NOTHING) and ("|" in key or ">" in key) else [key] if key else []
    return out


def judge(filler: float, message: float, body: float) -> tuple[str, float] | None:
    total = filler + message + body
    if message and message >= MESSAGE_SHARE * total:
        return "message", message / total
    if filler and filler >= FILLER_SHARE * total:
        return "filler", filler / total
    return None


def page_kind(text: str, recurring: set[int], declared: str | None = None) -> tuple[str, float] | None:
    """(kind, share of the body) if one page is residue, by the hashes of recurring lines; what `residue` does, for tests and single pages."""
    text = repaired(text, declared)
    if has_placeholder(text):
        return "placeholder", 1.0
    sums = [0, 0, 0, 0]
    for key in page_lines(text):
        sums[readings(key)[line_hash(key) in recurring]] += len(key)
    return judge(sums[FILLER], sums[MESSAGE], sums[BODY])


_PAGE = "doc_id bigint, host bigint, line bigint, chars bigint, alone tinyint, wide tinyint, filler bigint, message bigint, placeholder boolean"


def read_pages(documents: DataFrame) -> DataFrame:
    """One row for each page with the sums that don't depend on other pages, and one for each line that counts differently if it recurs."""
    has = {c.lower() for c in documents.columns}
    text = documents.where("text is not null and text <> ''").select("doc_id", "text", *[F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in ("host", "declared_charset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, host, charset in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "host", "declared_charset")), strict=True):
                t, h = repaired(t, charset), line_hash(host or "")
                sums, open_ = [0, 0, 0, 0], {}
                if placeholder := has_placeholder(t):
                    out.append((d, h, None, 0, 0, 0, 0, 0, placeholder))
                    continue
                for key in page_lines(t):
                    alone, wide = readings(key)
                    if alone == wide:
                        sums[alone] += len(key)
                    else:
                        x = line_hash(key)
                        open_[x] = (alone, wide, len(key) + (open_[x][2] if x in open_ else 0))
                out.append((d, h, None, 0, 0, 0, sums[FILLER], sums[MESSAGE], False))
                out += [(d, h, x, n, alone, wide, 0, 0, False) for x, (alone, wide, n) in open_.items()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _PAGE.split(", ")])

    return map_batches(text, run, _PAGE)


def residue(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind, share)`` of the documents to exclude; kind is placeholder, filler or message."""
    read = staged(read_pages(documents), "page-lines")
    lines = read.where("line is not null")
    recurring = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("a"), F.max("host").alias("b")).where((F.col("n") >= RECURS) & (F.col("a") != F.col("b"))).select("line", F.lit(True).alias("recurs"))
    counted = lines.join(recurring, "line", "left").select("doc_id", "chars", F.when(F.col("recurs"), F.col("wide")).otherwise(F.col("alone")).alias("kind"))
    part = lambda kind: F.when(F.col("kind") == kind, F.col("chars")).otherwise(0)
    rows = counted.select("doc_id", part(FILLER).alias("filler"), part(MESSAGE).alias("message"), part(BODY).alias("body"), F.lit(False).alias("placeholder"))
    fixed = read.where("line is null").select("doc_id", "filler", "message", F.lit(0).cast("bigint").alias("body"), "placeholder")
    sums = rows.unionByName(fixed).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("filler", "message", "body")], F.max("placeholder").alias("placeholder"))
    total = F.col("filler") + F.col("message") + F.col("body")
    kind = (
        F.when(F.col("placeholder"), "placeholder")
        .when((F.col("message") > 0) & (F.col("message") >= MESSAGE_SHARE * total), "message")
        .when((F.col("filler") > 0) & (F.col("filler") >= FILLER_SHARE * total), "filler")
    )
    share = F.when(F.col("kind") == "placeholder", 1.0).when(F.col("kind") == "message", F.col("message") / total).otherwise(F.col("filler") / total)
    return sums.withColumn("kind", kind).where("kind is not null").select("doc_id", "kind", share.alias("share"))
