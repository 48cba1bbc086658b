"""Named queries of the training-data operators tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm.leakage import leak_spans, leaks, without_leaks
from claimloom.llm.lookalike import lookalike_copies, one_form
from claimloom.llm.mixing import mixture, mixture_report, token_sizes
from claimloom.llm.near_dupes import near_duplicate_groups, near_duplicates
from claimloom.llm.residue import residue
from claimloom.llm.sentences import boundaries, sentences
from claimloom.llm.statements import statement_copies, statements
from claimloom.plans.registry import Registry
from claimloom.runtime import table

llm = Registry()

# SQL twin of statements.plain_form: marks between digits are set aside in private-use characters, twice for digits that stand alone.
_MARKED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\\p{{N}})\\.(\\p{{N}})', '\\1\ue010\\2', 'g'), '(\\p{{N}})\\.(\\p{{N}})', '\\1\ue010\\2', 'g'), '(\\p{{N}}),(\\p{{N}})', '\\1\ue011\\2', 'g'), '(\\p{{N}}),(\\p{{N}})', '\\1\ue011\\2', 'g')"
# ligatures unfold as ß does
_UNFOLDED = "replace(replace(replace(replace(replace({0}, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_PLAIN = f"replace(lower(upper(regexp_replace({_MARKED.replace('{0}', _UNFOLDED)}, '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}\ue010\ue011]', '', 'g'))), 'ß', 'ss')"
_LIST = "(?s)^[^\\p{L}\\p{N}]*\\p{L}[\\p{L}\\p{M}\\p{N}_ .-]*?\\s*(?::|=|->|→)\\s*.*[\\p{L}\\p{N}].*$"
_FIELD = "(?s)^[^\\p{L}\\p{N}]*(\\p{L}[\\p{L}\\p{M}\\p{N}_ .-]*?)\\s*(?::|=|->|→)\\s*(.*[\\p{L}\\p{N}].*)$"


def _fields(separator: str, rank: int) -> str:
    parts = f"list_filter(string_split_regex(marked, '{separator}'), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"
    label, value = (_PLAIN.format(f"regexp_extract(s, '{_FIELD}', {g})") for g in (1, 2))
    return f"""CASE WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda s: NOT regexp_matches(s, '{_LIST}'))) = 0
        THEN struct_pack(n := len({parts}), r := {rank}, k := array_to_string(list_sort(list_distinct(list_transform({parts}, lambda s: {label} || chr(31) || {value}))), chr(30))) END"""


_STATEMENTS = f"""
marked AS (SELECT nullif(trim(lower(id)), '') AS id, claim, {_MARKED.format('claim')} AS marked FROM nodes WHERE claim IS NOT NULL),
forms AS (SELECT id, claim, {_PLAIN.format('marked')} AS plain, list_max(list_filter([{_fields('[;|\\r\\n]+', 3)}, {_fields('[;|]+', 2)}, {_fields(',', 1)}], lambda x: x IS NOT NULL)).k AS fields FROM marked),
plains AS (SELECT plain, min(fields) AS fields FROM forms WHERE id IS NOT NULL AND plain <> '' GROUP BY 1),
keyed AS (SELECT f.id, f.claim, coalesce(chr(29) || p.fields, f.plain) AS key FROM forms f JOIN plains p USING (plain)),
firsts AS (SELECT key, min(id) AS first_id FROM keyed GROUP BY 1)
"""


@llm.query("p1_found", f"WITH {_STATEMENTS} SELECT DISTINCT first_id, id AS copy_id FROM keyed JOIN firsts USING (key) WHERE id > first_id")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_copies(table(spark, sf_dir, "nodes"))


@llm.query(
    "p1_statements",
    f"""WITH {_STATEMENTS}, per_id AS (SELECT key, id, min(claim) AS claim FROM keyed GROUP BY ALL)
SELECT min(id) AS first_id, count(*) AS n_ids, count(DISTINCT claim) AS n_forms FROM per_id GROUP BY key""",
)
def p1_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(table(spark, sf_dir, "nodes"))


@llm.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_copies(table(spark, sf_dir, "nodes"))


@llm.query("p5_forms")
def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_form(table(spark, sf_dir, "nodes"))


@llm.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(table(spark, sf_dir, "nodes"))


@llm.query("p3_sentences")
def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "nodes"))


@llm.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "nodes"))


@llm.query("p4_groups")
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "nodes"))


@llm.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


@llm.query("p9_residue")
def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"))


_GRAMS = """
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(12, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(12, len(w)) + 2), lambda i: array_to_string(w[i:i + least(12, len(w)) - 1], ' '))) AS gram FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\\p{L}\\p{N}]+') AS w FROM documents),
windows AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM dw, (SELECT DISTINCT k FROM grams))
"""


@llm.query("p7_found", f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM windows JOIN grams USING (k, gram)")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm.query("p7_spans")
def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm.query("p7_clean")
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm.query("p8_mixes")
def p8_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


@llm.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
