"""Visually identical text with different characters (problem 5).

The one form of a text is made in three steps: compatibility characters that look the
same (full width, ligatures, spaces and hyphens of other widths) become ordinary ones
and ignorable characters go; composed and combined accents become composed; then every
token runs through a lattice of look-alike letters, in which Viterbi finds the best
path under character bigrams that keep to one script.

All tokens that look the same share one lattice, so they get the same form whatever
their letters were.  A token with a letter of its own in just one script takes that
script, as the search would.  A token of look-alikes alone takes the script of the
tokens round it that have one: of its own chunk between blanks, then of the words on both
sides; a chunk with digits is a code, Latin if nothing in it says otherwise.  Only where neighbours differ or
are missing does the search decide.  Copies agree in these tokens, so they get the same
form.  Raised and lowered digits, fractions and circled characters look different
and stay; so do letter case and accents.

Null text stays null and has no group; empty and blank texts have the form "".
Long texts are handled whole.  Copies by ordinary white space alone are no cases.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.statements import hash128
from claimloom.runtime import map_batches, norm_id, staged

# Letters that look the same as a Latin letter, by script.
LATIN_LOWER = {"cyrillic": "аеорсухіјѕһӏԁԛԝѵ", "latin": "aeopcyxijshldqwv"}
LATIN_UPPER = {"cyrillic": "АВЕЅІЈКМНОРСТУХԌԚԜ", "latin": "ABESIJKMHOPCTYXGQW"}
GREEK = {"greek": "αιονρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "latin": "aiovpucjABEZHIKMNOPTYXC"}
ARMENIAN = {"armenian": "օսհցզոՕՍ", "latin": "ouhgqnOU"}
OTHER_LATIN = {"variant": "ɡɑ", "latin": "ga"}
SCRIPTS = ("latin", "cyrillic", "greek", "armenian")

#: compatibility decompositions that change the look
DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<noBreak> 0F0B")
#: letters with a compatibility decomposition that look like another letter than its result
KEPT = frozenset("ſϲϹ")
TOKEN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ʯ̀-ͯͰ-֏Ḁ-῿]+")
CHUNK = re.compile(r"\S+")
BREAK = re.compile(r"[\r\n]+")
SWITCH = -12.0
#: letters of the four scripts, two at a time, bound the table of bigrams
MAX_BIGRAMS = 1 << 20


@lru_cache(maxsize=1)
def compat_table() -> dict[int, str | None]:
    """Character map by rule from the Unicode database: None deletes."""
    table: dict[int, str | None] = {}
    for cp in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[cp] = None
        elif kind in ("Zs", "Zl", "Zp"):
            table[cp] = " "
        elif cp in (0x2010, 0x2011):
            table[cp] = "-"
        elif (d := unicodedata.decomposition(ch)).startswith("<") and not d.startswith(DIFFERENT) and ch not in KEPT:
            plain = unicodedata.normalize("NFKC", ch)
            if plain[:1] != " ":
                table[cp] = plain
    return table


@lru_cache(maxsize=1)
def lattice() -> dict[str, dict[str, str]]:
    """For each letter with look-alikes: script -> letter."""
    by_latin: dict[str, dict[str, str]] = {}
    for group in (LATIN_LOWER, LATIN_UPPER, GREEK, ARMENIAN):
        (script, theirs), (_, latin) = group.items()
        for a, b in zip(theirs, latin, strict=True):
            by_latin.setdefault(b, {"latin": b})[script] = a
    out = {}
    for options in by_latin.values():
        for letter in options.values():
            out[letter] = options
    for a, b in zip(OTHER_LATIN["variant"], OTHER_LATIN["latin"], strict=True):
        out[a] = out.get(b, {"latin": b})
    return out


@lru_cache(maxsize=None)
def script_of(letter: str) -> str:
    cp = ord(letter)
    if cp < 0x370:
        return "latin"
    if cp < 0x400:
        return "greek"
    if cp < 0x530:
        return "cyrillic"
    if cp < 0x590:
        return "armenian"
    return "greek" if 0x1F00 <= cp < 0x2000 else "latin"


def bigrams_of(words: Counter[str]) -> Counter[str]:
    """Bigrams of base letters, with the ends of words, over words of a single script."""
    out: Counter[str] = Counter()
    for word, n in words.items():
        base = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        if base and len({script_of(c) for c in base}) == 1:
            padded = f" {base} "
            for i in range(len(padded) - 1):
                out[padded[i : i + 2]] += n
    return out


class Normaliser:
    """Brings texts to their one form with a table of bigram counts."""

    def __init__(self, bigrams: dict[str, int]):
        self.counts, self.after = bigrams, Counter()
        for pair, n in bigrams.items():
            self.after[pair[0]] += n
        self.options = lattice()
        self.cache: dict[str, str] = {}
        self.kinds: dict[str, str | None] = {}
        # One letter that only Latin has makes all tokens of an ASCII text Latin.
        self.own_ascii = re.compile("[" + "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in self.options) + "]")

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + 0.1) / (self.after.get(a, 0) + 50.0))

    def token(self, token: str) -> str:
        known = self.cache.get(token)
        if known is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            known = self.cache[token] = self.search(token)
        return known

    def search(self, token: str) -> str:
        parts = unicodedata.normalize("NFD", token)
        own = {script_of(c) for c in parts if not unicodedata.combining(c) and c not in self.options}
        if len(own) == 1 and all(unicodedata.combining(c) or c not in self.options or own & self.options[c].keys() for c in parts):
            (script,) = own
            if all(c not in self.options or self.options[c].get(script) == c for c in parts):
                return token
            return unicodedata.normalize("NFC", "".join(self.options[c][script] if c in self.options else c for c in parts))
        # Viterbi over (script, letter) states; marks stay with their letters.
        paths: dict[tuple[str, str], tuple[float, str]] = {("", " "): (0.0, "")}
        for c in parts:
            if unicodedata.combining(c):
                paths = {k: (s, p + c) for k, (s, p) in paths.items()}
                continue
            states = self.options.get(c) or {script_of(c): c}
            nxt = {}
            for script in SCRIPTS:
                if script in states:
                    letter = states[script]
                    nxt[(script, letter)] = max((s + self.score(b, letter) + (SWITCH if a and a != script else 0.0), p + letter) for (a, b), (s, p) in paths.items())
            paths = nxt
        return unicodedata.normalize("NFC", max((s + self.score(b, " "), p) for (_, b), (s, p) in paths.items())[1])

    def kind(self, token: str) -> str | None:
        """The one script of the token's own letters, "" if all are look-alikes, None if it mixes scripts."""
        known = self.kinds.get(token, self)
        if known is self:
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            own = {script_of(c) for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c) and c not in self.options}
            known = self.kinds[token] = "" if not own else own.pop() if len(own) == 1 else None
        return known

    def in_script(self, token: str, script: str) -> str | None:
        """The token in the letters of a script, if it has them all."""
        parts = unicodedata.normalize("NFD", token)
        if all(unicodedata.combining(c) or script in self.options[c] for c in parts):
            return unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else self.options[c][script] for c in parts))
        return None

    def tokens(self, text: str) -> str:
        """Every token in its one form; one pass each way, however long the text."""
        spans = list(TOKEN.finditer(text))
        kinds = [self.kind(m[0]) for m in spans]
        scripts = self.round_scripts(text, spans, kinds) if "" in kinds else kinds
        out, at = [], 0
        for m, kind, script in zip(spans, kinds, scripts, strict=True):
            form = self.in_script(m[0], script) if kind == "" and script else None
            out += text[at : m.start()], form or self.token(m[0])
            at = m.end()
        return "".join([*out, text[at:]])

    def round_scripts(self, text: str, spans: list[re.Match[str]], kinds: list[str | None]) -> list[str | None]:
        """For each token the script that its chunk between blanks has, else the one that the words round it agree on.

        Chunks with digits are codes: they don't count as words round others.
        """
        chunks, i = [], 0
        for chunk in CHUNK.finditer(text):
            j = i
            while j < len(spans) and spans[j].start() < chunk.end():
                j += 1
            if j > i:
                alone = j == i + 1 and len(spans[i][0]) == len(chunk[0])
                chunks.append((i, j, alone, any(c.isdigit() for c in chunk[0]), next((k for k in kinds[i:j] if k), None)))
            i = j
        before: list[str | None] = []
        after: list[str | None] = []
        for found, order in ((before, chunks), (after, reversed(chunks))):
            last = None
            for _, _, _, code, script in order:
                found.append(last)
                last = last if code else script or last
        out: list[str | None] = []
        for (i, j, alone, code, script), a, b in zip(chunks, before, reversed(after), strict=True):
            own = None if alone else script or ("latin" if code else None)
            out += [own or (a if a == b or not b else b if not a else None)] * (j - i)
        return out

    def lines(self, text: str | None) -> str | None:
        """The one form of a text with its line breaks: a list of labelled fields may be parted by them."""
        if text is None:
            return None
        if not text.isascii():
            text = self.tokens(unicodedata.normalize("NFC", text.translate(compat_table())))
        elif not self.own_ascii.search(text):
            text = self.tokens(text)
        return "\n".join(x for line in BREAK.split(text) if (x := " ".join(line.split())))

    def text(self, text: str | None) -> str | None:
        form = self.lines(text)
        return form and form.replace("\n", " ")


def corpus_bigrams(texts: DataFrame, column: str) -> dict[str, int]:
    """Bigram counts over all texts, combined in each task first; the alphabet bounds the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            words: Counter[str] = Counter()
            for t in batch.column(column).to_pylist():
                if t is not None:
                    words.update(TOKEN.findall(t))
            total.update(bigrams_of(words))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = map_batches(texts.select(column), count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = {r.pair: r.n for r in rows.toLocalIterator()}
    if len(table) > MAX_BIGRAMS:
        raise ValueError("more letter pairs than the scripts allow")
    return table


def normaliser(spark: SparkSession, texts: DataFrame, column: str):
    """A broadcast, bounded table of bigrams and the function that makes a worker's normaliser from it."""
    table = spark.sparkContext.broadcast(corpus_bigrams(texts, column))

    def make() -> Normaliser:
        return Normaliser(table.value)

    return make


def one_form(nodes: DataFrame, id_col: str = "id", text_col: str = "claim") -> DataFrame:
    """``(id, text, form)``: the one consistent form of each text."""
    make = normaliser(nodes.sparkSession, nodes.select(text_col), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = make()
        for batch in batches:
            yield batch.append_column("form", pa.array([n.text(t) for t in batch.column("text").to_pylist()], pa.string()))

    rows = nodes.select(norm_id(F.col(id_col)).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return map_batches(rows, run, "id string, text string, form string")


def lookalike_copies(nodes: DataFrame) -> DataFrame:
    """``(first_id, copy_id)``: ids whose claims look like that of the smallest id of the group, but have other characters."""
    forms = one_form(nodes).where("text is not null and form <> ''")
    raw = F.xxhash64(F.btrim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    keys = staged(forms.select("id", hash128(F.col("form")).alias("form"), raw.alias("raw")), "forms")
    groups = keys.groupBy("form").agg(F.min(F.struct("id", "raw")).alias("first"), F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b")
    pairs = keys.join(groups.select("form", "first"), "form").where("id > first.id and raw <> first.raw")
    return pairs.select(F.col("first.id").alias("first_id"), F.col("id").alias("copy_id")).distinct()
