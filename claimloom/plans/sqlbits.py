"""Pieces of SQL that the oracle queries share."""

from claimloom.functions import scalars as S

NOW = 1782864000  # 2026-07-01T00:00:00Z
_T = "[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,6})?)?)"
ISO_RE = "^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:" + _T + "(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def nid(c: str) -> str:
    return f"nullif(trim(lower({c})), '')"


def iso(c: str) -> str:
    x = f"trim({c})"
    e = lambda g: f"regexp_extract({x}, '{ISO_RE}', {g})"
    return (
        f"(CASE WHEN regexp_matches({x}, '{ISO_RE}') THEN epoch(try_cast({e(1)} || ' ' || coalesce(nullif({e(2)}, ''), '00:00:00') AS TIMESTAMP)) - "
        f"CASE WHEN length({e(3)}) = 6 THEN (CASE WHEN {e(3)}[1] = '-' THEN -1 ELSE 1 END) * (CAST({e(3)}[2:3] AS INTEGER) * 3600 + CAST({e(3)}[5:6] AS INTEGER) * 60) ELSE 0 END END)"
    )


SNAP = "n AS (SELECT * REPLACE (trim(lower(id)) AS id) FROM nodes WHERE trim(id) <> '' QUALIFY row_number() OVER (PARTITION BY trim(lower(id)) ORDER BY seq) = 1)"
LINKS = f"l AS (SELECT id AS src, dst, min(pos) AS pos FROM (SELECT id, {nid('links[i]')} AS dst, i - 1 AS pos FROM (SELECT id, links, unnest(range(1, len(links) + 1)) AS i FROM n)) WHERE dst IS NOT NULL GROUP BY ALL)"
EDGES = f"e AS (SELECT DISTINCT edge_id, {nid('src')} AS src, {nid('dst')} AS dst, coalesce(rel, 'related_to') AS rel, coalesce(author, 'unknown') AS author FROM edges WHERE trim(src) <> '' AND trim(dst) <> '')"
LOG = "g AS (SELECT * FROM ground_log QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY arrived_at) = 1)"
BUS = "b AS (SELECT * FROM bus_messages QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY ts) = 1)"
HITS = f"h AS (SELECT {nid('t')} AS id, epoch(ts) AS tm FROM (SELECT unnest(node_ids) AS t, ts FROM g) WHERE trim(t) <> '')"


def weight(default: float) -> str:
    return f"CASE WHEN weight IS NULL OR weight = 0 THEN {default} ELSE weight END"


def decayed(w: str, ref: str, kind: str = "kind") -> str:
    return f"CASE WHEN {ref} IS NULL OR {NOW} <= {ref} THEN {w} ELSE greatest(CASE WHEN {kind} IN ('rule', 'hub') THEN 0.5 ELSE 0.05 END, ({w}) * pow(0.5, ({NOW} - {ref}) / 3600.0 / 168.0)) END"


ACTIVE = f"(kind NOT IN ('refuted', 'outdated') AND ({iso('valid_until')} IS NULL OR {NOW} < {iso('valid_until')}))"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOPS = sorted({w.replace("ё", "е")[:6] for w in S.STOP_WORDS.split()} | {w[:6] for w in S.STOP_WORDS.split()})


def tokens(c: str, min_len: int = 3) -> str:
    """Budget tokens (TX-2)."""
    return (
        f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[a-zа-я0-9_./-]{{2,}}'), lambda w: trim(w, './-')), "
        f"lambda w: length(w) >= {min_len} AND NOT regexp_matches(w, '^mn_[0-9a-f]{{12}}($|[^a-zа-я0-9_])')), lambda w: CASE WHEN regexp_full_match(w, '[а-яa-z]+') THEN w[1:6] ELSE w END), lambda s: s NOT IN ({quoted(_STOPS)}))"
    )


_GSTOPS = sorted(set(S.GATE_STOP_WORDS.split()))


def gate_tokens(c: str) -> str:
    return (
        f"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s$%]', ' ', 'g'), '\\s+'), "
        f"lambda w: (length(w) >= 3 OR (length(w) >= 2 AND regexp_full_match(w, '\\p{{Nd}}+'))) AND w NOT IN ({quoted(_GSTOPS)}))"
    )


_DATES = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"


def content_tokens(c: str) -> str:
    return gate_tokens(f"regexp_replace({c}, '{_DATES}', ' ', 'g')")


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def tier(c: str) -> str:
    s = f"trim(lower(coalesce({c}, '')))"
    return f"CASE WHEN {s} = '' THEN 'C' WHEN {any_of(s, S.TIER_A)} THEN 'A' WHEN {any_of(s, S.TIER_C)} THEN 'C' ELSE 'B' END"


def first_sentence(c: str, limit: int) -> str:
    """TX-26."""
    one = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    head = f"coalesce(nullif(regexp_extract({one}, '^(.*?[.!?…])(?: |$)', 1), ''), {one})"
    return f"CASE WHEN length({head}) <= {limit} THEN {head} ELSE coalesce(nullif(regexp_extract(({head})[1:{limit - 1}], '^(.*) ', 1), ''), ({head})[1:{limit}]) || '…' END"
