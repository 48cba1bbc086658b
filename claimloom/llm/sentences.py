"""Sentence boundaries across languages and scripts (problem 3).

Rules compile into a finite transducer.  A text is read as a string of events (opening
and closing quotes, marks that may end a sentence); all that decides an event lies in a
bounded window round it.  The transducer's state is the kind of quotation it is in.  A
mark outside quotations ends a sentence; one inside waits until the quotation closes,
and is dropped if the sentence goes on after it.

A long text is cut into chunks.  Each chunk is read once from every start state, which
gives a state-transition function: for each start state the end state, the boundaries
it outputs, and what becomes of those that wait.  The functions compose associatively,
so a scan over chunk functions (`compose`) yields the state in which every chunk starts
without reading the text again.

Null and blank texts have no sentences.  A line break alone and a semicolon end none.
Repeated rows count once, extra columns are ignored.  Nodes without id have no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.statements import field_form
from claimloom.runtime import map_batches, norm_id, staged

#: Characters of a chunk, and of the window round an event, which a chunk overlaps on either side.
CHUNK, WINDOW = 1 << 16, 160

# Abbreviations by what follows them.
NEVER_END = frozenset(
    """dr dra drs mr mrs ms prof st sr sra srta d dª p pp pag pág págs vs approx aprox ca
    env bzw ej vgl sog bspw ggf inkl chap ul ул им стр рис см ср тыс млн млрд гл ст пл пр кв гр
    mme mlle mm jan feb mar apr jun jul aug sep sept oct nov dec capt gen col sgt rev hon mt ft av ave gov sen rep
    डॉ श्री प्रो د أ م ص""".split()
)
MAY_END = frozenset("etc usw no nos nr fig figs art arts abs vol max ed eds ltd inc co corp sec secs hrs hr min am pm jr sr al bros руб коп др пр т.д т.п т.е u.a u.s u.k p.m a.m ff cf dept univ".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
CONTINUES = ("然后", "と", "って", "，", "、", "说", "道", "地", "的", "是")

OPEN_TO_CLOSE = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", '"': '"', "‹": "›"}
QUOTES = {q: i + 1 for i, q in enumerate(OPEN_TO_CLOSE)}
CLOSES = {1: "”", 2: "»", 3: "“”", 4: "」", 5: "』", 6: '"', 7: "›"}
N_STATES = len(OPEN_TO_CLOSE) + 1
CJK_MARKS = "。！？｡"
TERMINALS = ".!?…。！？｡।॥؟۔"
BRACKETS = ")]}）】〉》"
EVENT = re.compile(f"[{TERMINALS}]+|[“”«»„「」『』\"‹›]|(?<=[฀-๿])[^\\S\r\n]+(?=\\S)|(?<=\\S)[^\\S\r\n]+(?=[฀-๿])")
WORD_BEFORE = re.compile(r"[^\s(\[{“„«\"'¡¿/—–-]*$")


def _goes_on(text: str, at: int, after_mark: bool) -> bool:
    """Whether the sentence goes on behind a closed quotation that ends before ``at``."""
    end = min(len(text), at + WINDOW)
    i = at
    while i < end and text[i].isspace():
        i += 1
    if i == end:
        return False
    c = text[i]
    if not after_mark:
        return True
    if c in ",;:—–-،，、;" or text.startswith(CONTINUES, i):
        return True
    if c.islower():
        return True
    if c.isupper() or c.isdigit() or c in "“«„「『\"¡¿‹([":
        return False
    # Scripts without case: those that part words go on, the others end.
    return bool(unicodedata.category(c)[0] == "L" and not _cjk(c))


def _cjk(c: str) -> bool:
    return "぀" <= c <= "鿿" or "豈" <= c <= "﫿" or "가" <= c <= "힣" or "！" <= c <= "￮"


def _abbreviation(text: str, start: int) -> str:
    """The word before a full stop at ``start``, folded."""
    word = WORD_BEFORE.search(text, max(0, start - 40), start)[0]
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
        word = "".join(c for c in word if unicodedata.category(c) != "Cf")
    return word.lstrip("'’")


def _ends(text: str, start: int, stop: int, shouting: bool) -> bool:
    """Whether the run of marks text[start:stop] ends a sentence, quotations aside."""
    run = text[start:stop]
    end = min(len(text), stop + WINDOW)
    i = stop
    closers = False
    while i < end and (text[i] in BRACKETS or text[i] in "'’"):
        closers = closers or text[i] in BRACKETS
        i += 1
    j = i
    while j < end and text[j].isspace():
        j += 1
    nxt = text[j] if j < end else ""
    if not nxt:
        return True
    if run[0] in CJK_MARKS or run[0] in "।॥":
        return True
    # A closing mark of a French quotation may stand behind a space: the quotation decides.
    spaced = j > i
    if run[0] in "!?؟" or "!" in run or "?" in run:
        if closers and (nxt.islower() or nxt in ",;:—–"):
            return False
        return nxt not in ",;:" and (spaced or not nxt.islower() and not nxt.isdigit())
    if run[0] == "…" or len(run) > 1:
        return not (nxt.islower() or nxt in ",;:.)—" or nxt.isdigit() and not spaced) or (run[0] == "…" and _cjk(nxt))
    # A single full stop.
    if nxt in ",;:—–" or (not spaced and (nxt.isdigit() or nxt.islower() or nxt in "@/_-%&=")):
        return False
    word = _abbreviation(text, start)
    low = word.casefold()
    last = low.rsplit(".", 1)[-1]
    letters = bool(last) and last[-1].isalpha()
    if not spaced and not closers:
        # "goods.The" is a boundary, "api.Host" in capitals, "J.K." and "v2.Beta" are none.
        if not (nxt.isupper() or _cjk(nxt) or (nxt.isalpha() and not nxt.islower() and not nxt.isupper()) or nxt in "“«„¡¿\"「"):
            return False
        if shouting or len(last) <= 1 and letters and "." not in low or last in NEVER_END:
            return False
        return not (last.isdigit() and nxt.isdigit())
    if closers and (nxt.islower()):
        return False
    if last in NEVER_END and low not in MAY_END:
        return False
    if low in MAY_END or last in MAY_END:
        return (nxt.isupper() or nxt in "“«„¡¿\"「([") and not shouting
    if letters and len(last) == 1:
        if last == "г" and not nxt.islower():
            return False
        before = text[max(0, start - len(word) - 4) : start - len(word)].casefold()
        if last in "дп" and before.rstrip().endswith("т."):
            return nxt.isupper() and not shouting
        if low in ("p.m", "a.m"):
            return nxt.isupper() or nxt in "“«„"
        return False
    if last.isdigit() and len(last) <= 2 and nxt.isalpha():
        following = re.match(r"[^\W\d_]+", text[j : j + 20])
        if following and following[0].casefold() in MONTHS:
            return False
    return True


class Fragment(NamedTuple):
    """What a chunk does from one start state."""

    state: int
    #: boundaries that are sure, as end offsets
    ends: tuple[int, ...]
    #: boundaries that wait for the close of a quotation that is still open
    waiting: tuple[int, ...]
    #: fate of those that waited before: None still open, else whether they stand
    verdict: bool | None


def _skip_closers(text: str, at: int) -> int:
    end = min(len(text), at + WINDOW)
    while at < end and (text[at] in BRACKETS or text[at] in "'’"):
        at += 1
    return at


def _after_mark(text: str, at: int) -> bool:
    """Whether the last character before ``at``, white space and brackets aside, is a mark."""
    k, low = at, max(0, at - WINDOW)
    while k > low and (text[k - 1].isspace() or text[k - 1] in BRACKETS):
        k -= 1
    return k > low and text[k - 1] in TERMINALS


def run_chunk(text: str, events: list[tuple[int, int, str]], state: int, shouting: bool, shift: int = 0) -> Fragment:
    """Read the events of one chunk from ``state``; ``shift`` is the place of ``text`` in the whole."""
    ends: list[int] = []
    waiting: list[int] = []
    verdict: bool | None = None
    entered = state
    size = len(text)
    for start, stop, what in events:
        c = what[0]
        if c in TERMINALS:
            i = _skip_closers(text, stop)
            if state:
                j = i
                while j < min(size, i + WINDOW) and text[j].isspace():
                    j += 1
                if j < size and text[j] in CLOSES[state]:
                    continue  # the close decides
                if _ends(text, start, stop, shouting):
                    waiting.append(i + shift)
            elif _ends(text, start, stop, shouting):
                ends.append(i + shift)
        elif c.isspace():
            # Only matched beside Thai letters, where a space ends a sentence.
            (waiting if state else ends).append(start + shift)
        elif state and c in CLOSES[state]:
            at = _skip_closers(text, stop)
            # A mark behind the quotation is an event of its own.
            stands = not (at < size and text[at] in TERMINALS) and not _goes_on(text, at, _after_mark(text, start))
            if entered and verdict is None:
                verdict = stands
            if stands:
                ends.extend(waiting)
                ends.append(at + shift)
            waiting = []
            state = 0
        elif not state and c in QUOTES:
            state = QUOTES[c]
    return Fragment(state, tuple(ends), tuple(waiting), verdict if entered else None)


def compose(a: Fragment, b: tuple[Fragment, ...]) -> Fragment:
    """First ``a``, then the chunk with the functions ``b``; associative."""
    then = b[a.state]
    if a.state and then.verdict is None:
        return Fragment(then.state, a.ends + then.ends, a.waiting + then.waiting, a.verdict)
    kept = a.waiting if a.state and then.verdict else ()
    return Fragment(then.state, a.ends + kept + then.ends, then.waiting, a.verdict if a.verdict is not None else (then.verdict if a.state else None))


def chunk_functions(piece: str, shift: int, lo: int, hi: int, shouting: bool) -> tuple[Fragment, ...]:
    """Transition function, for every start state, of the events that begin in [lo, hi) of the whole text; ``piece`` begins at ``shift``."""
    events = [(m.start(), m.end(), m[0]) for m in EVENT.finditer(piece) if lo <= m.start() + shift < hi]
    return tuple(run_chunk(piece, events, s, shouting, shift) for s in range(N_STATES))


def finish(whole: Fragment, last: int) -> list[int]:
    """End offsets of all sentences of a text whose last visible character ends at ``last``; an open quotation closes there."""
    return [*sorted({e for e in (*whole.ends, *whole.waiting) if e < last}), last]


def sentence_ends(text: str | None, listed: bool = False) -> list[int]:
    """Number of characters from the start of ``text`` to the end of each of its sentences."""
    if text is None or not (last := len(text.rstrip())):
        return []
    if listed:
        return [last]
    return finish(run_chunk(text, [(m.start(), m.end(), m[0]) for m in EVENT.finditer(text)], 0, text.isupper()), last)


def sentence_ends_chunked(text: str, chunk: int = CHUNK) -> list[int]:
    """The same by transition functions of chunks and their composition, as the long path computes it."""
    if not (last := len(text.rstrip())):
        return []
    whole = Fragment(0, (), (), None)
    for lo in range(0, len(text), chunk):
        shift = max(0, lo - WINDOW)
        whole = compose(whole, chunk_functions(text[shift : lo + chunk + WINDOW], shift, lo, lo + chunk, text.isupper()))
    return finish(whole, last)


_FRAGMENTS = "array<struct<state:int,ends:array<int>,waiting:array<int>,verdict:boolean>>"
#: Functions that one step of the scan composes.
FAN = 64


def entering_states(maps: DataFrame) -> DataFrame:
    """``(id, field, at, entered)`` for each chunk, of its state map ``(id, field, at, map)``: a parallel prefix scan.

    Going up, FAN neighbouring maps become one; going down, every block gives each of its parts the state it is entered
    in.  Both take log steps, and no row is longer than FAN maps.
    """
    key = ["id", "field", "at"]
    blocks = []
    top = maps.agg(F.max("at")).first()[0] or 0
    level = maps
    while top > 0:
        kids = F.array_sort(F.collect_list(F.struct("at", "map")))
        grouped = level.groupBy("id", "field", F.floor(F.col("at") / FAN).cast("int").alias("block")).agg(kids.alias("kids")).withColumnRenamed("block", "at")
        whole = F.aggregate("kids", F.array(*map(F.lit, range(N_STATES))), lambda m, k: F.transform(m, lambda s: F.get(k["map"], s)))
        level = staged(grouped.select(*key, whole.alias("map"), "kids"), "scan")
        blocks.append(level)
        top //= FAN
    entered = level.select(*key, F.lit(0).alias("entered"))
    for block in reversed(blocks):
        start = F.struct(F.col("entered").alias("s"), F.array().cast("array<struct<at:int,entered:int>>").alias("out"))
        told = F.aggregate("kids", start, lambda a, k: F.struct(F.get(k["map"], a["s"]).alias("s"), F.array_append(a["out"], F.struct(k["at"].alias("at"), a["s"].alias("entered"))).alias("out")))
        entered = block.join(entered, key).select("id", "field", F.explode(told["out"]).alias("x")).select("id", "field", "x.at", "x.entered")
    return entered


def _long_ends(texts: DataFrame, chunk: int) -> DataFrame:
    """``(id, field, sent_end)`` of long texts: functions of chunks in parallel, a prefix scan over them, then each chunk's own ends."""
    size = F.length("text")
    last = F.length(F.regexp_replace("text", r"(?U)\s+$", ""))
    shouting = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    at = texts.select("id", "field", "text", last.alias("last"), shouting.alias("shouting"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("lo"))
    shift = F.greatest(F.lit(0), F.col("lo") - WINDOW)
    pieces = at.select("id", "field", "last", "shouting", "lo", shift.alias("shift"), F.substring("text", shift + 1, F.col("lo") - shift + chunk + WINDOW).alias("piece"))
    pieces = pieces.repartition("id", "field", "lo")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [[f._asdict() for f in chunk_functions(r["piece"], r["shift"], r["lo"], r["lo"] + chunk, r["shouting"])] for r in rows]
            kept = batch.select(["id", "field", "last", "lo"])
            kind = pa.list_(pa.struct([("state", pa.int32()), ("ends", pa.list_(pa.int32())), ("waiting", pa.list_(pa.int32())), ("verdict", pa.bool_())]))
            yield kept.append_column("functions", pa.array(out, kind))

    read_pieces = map_batches(pieces, read, f"id string, field string, last int, lo int, functions {_FRAGMENTS}")
    chunks = staged(read_pieces.select("id", "field", (F.col("lo") / chunk).cast("int").alias("at"), "last", "functions"), "chunks")
    known = chunks.join(entering_states(chunks.select("id", "field", "at", F.col("functions.state").alias("map"))), ["id", "field", "at"])
    known = known.select("id", "field", "at", "last", F.get("functions", "entered").alias("f"), "entered")
    # Marks in a quotation that is still open wait for the chunk that closes it; one that never closes ends with the text.
    verdicts = known.select("id", "field", "at", F.when(F.col("entered") > 0, F.col("f.verdict")).alias("verdict"))
    later = F.first("verdict", ignorenulls=True).over(Window.partitionBy("id", "field").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    stands = verdicts.select("id", "field", "at", F.coalesce(later, F.lit(True)).alias("stands"))
    ends = F.concat("f.ends", F.when(F.col("stands"), F.col("f.waiting")).otherwise(F.array().cast("array<int>")))
    own = known.join(stands, ["id", "field", "at"]).select("id", "field", "last", F.explode(ends).alias("sent_end")).where("sent_end < last")
    return own.select("id", "field", "sent_end").unionByName(chunks.where("at = 0").select("id", "field", F.col("last").alias("sent_end")))


def boundaries(nodes: DataFrame, fields: tuple[str, ...] = ("claim", "context"), chunk: int = CHUNK) -> DataFrame:
    """``(id, field, sent_end)``: every sentence of every text field, once for each node."""
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), field_form(F.col(f)).isNotNull().alias("listed")) for f in fields]
    rows = nodes.select(norm_id(F.col("id")).alias("id"), F.explode(F.array(*one)).alias("x")).select("id", "x.*")
    rows = rows.where(r"id is not null and text rlike '(?U)\\S'")
    is_long = (F.length("text") > chunk) & ~F.col("listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("listed").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("field"), pa.array([sentence_ends(t, x) for t, x in pairs], pa.list_(pa.int32()))], names=["id", "field", "ends"])

    short = map_batches(rows.where(~is_long), run, "id string, field string, ends array<int>")
    long_rows = rows.where(is_long).select("id", "field", "text").distinct()
    return short.select("id", "field", F.explode("ends").alias("sent_end")).unionByName(_long_ends(long_rows, chunk)).distinct()


def sentences(nodes: DataFrame, fields: tuple[str, ...] = ("claim", "context"), chunk: int = CHUNK) -> DataFrame:
    """``(id, field, sent_no, sent_end, sentence)``: the sentences themselves, without the white space round them."""
    ends = boundaries(nodes, fields, chunk).groupBy("id", "field").agg(F.array_sort(F.collect_list("sent_end")).alias("ends"))
    first = nodes.select(norm_id(F.col("id")).alias("id"), "seq", *fields).where("id is not null").groupBy("id").agg(F.min_by(F.struct(*fields), "seq").alias("t"))
    texts = first.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("text")) for f in fields])).alias("x")).select("id", "x.*")
    parts = ends.join(texts, ["id", "field"]).select("id", "field", "text", F.posexplode("ends").alias("sent_no", "sent_end"), "ends")
    begin = F.when(F.col("sent_no") > 0, F.get("ends", F.col("sent_no") - 1)).otherwise(0)
    sentence = F.regexp_replace(F.substring("text", begin + 1, F.col("sent_end") - begin), r"(?U)^\s+", "")
    return parts.select("id", "field", "sent_no", "sent_end", sentence.alias("sentence"))
