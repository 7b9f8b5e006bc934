"""Builders of the SQL that gives the same rows as the queries, in DuckDB's dialect."""

from __future__ import annotations

import re

from tracewell.functions import rules
from tracewell.functions.text import JS_SPACE, _STRIPPED, _TAGS, _ZERO_WIDTH
from tracewell.operators import corpus, variants


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), {q(_ZERO_WIDTH)}, '', 'g'), {q(JS_SPACE)}, ' ', 'g'))"


def matching_text(x: str) -> str:
    y = f"regexp_replace(regexp_replace(coalesce({x}, ''), {q(_TAGS)}, ' ', 'g'), {q(_STRIPPED)}, '', 'g')"
    y = f"translate({y}, {q(rules.LOOKALIKES)}, {q(rules.LATIN)})"
    return f"regexp_replace(trim(regexp_replace({y}, {q(JS_SPACE)}, ' ', 'g')), '(?i)ignoreallpreviousinstructions', 'ignore all previous instructions', 'g')"


def any_of(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(rules.re2(p))})" for p in patterns) + ")"


QUOTED = "[\"'“”‘’]"


def outside(x: str, patterns) -> str:
    one = lambda p: (
        f"(len(regexp_extract_all(regexp_replace({x}, {q('(' + rules.re2(p) + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))) > "
        f"len(regexp_extract_all(regexp_replace({x}, {q('(' + rules.re2(p) + ')')}, chr(1) || '\\1' || chr(2), 'g'), "
        f"{q(QUOTED)} || '\\s{{0,2}}' || chr(1) || '[^' || chr(2) || ']*' || chr(2) || '|' || chr(1) || '[^' || chr(2) || ']*' || chr(2) || '\\s{{0,2}}' || {q(QUOTED)})))"
    )
    return "(" + " OR ".join(one(p) for p in patterns) + ")"


LINES = f"""lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents),
body AS (SELECT doc_id, source, text, {matching_text('text')} AS b FROM lines WHERE {norm_key('text')} <> '')"""


def col(intent: str) -> str:
    return intent.replace("-", "_")


def facts() -> str:
    """CTEs up to facts: one row for each line, i_* and u_* for each intent and the gates' facts."""
    i = ",\n  ".join(f"{any_of('b', p)} AS i_{col(n)}" for n, p in rules.PATTERNS.items())
    u = ",\n  ".join(f"i_{col(n)} AND (NOT regexp_matches(b, {q(QUOTED)}) OR {outside('b', p)}) AS u_{col(n)}" for n, p in rules.PATTERNS.items())
    untagged = f"regexp_replace(text, {q(_TAGS)}, ' ', 'g')"
    hidden = f"(regexp_matches({untagged}, {q(_STRIPPED)}) OR translate({untagged}, {q(rules.LOOKALIKES)}, {q(rules.LATIN)}) <> {untagged} OR regexp_matches(text, {q('[' + chr(0xE0020) + '-' + chr(0xE007E) + ']{8,}')}))"
    return f"""{LINES},
hits AS (SELECT *,
  {i} FROM body),
facts AS (SELECT *,
  {u},
  {any_of('b', [p for _, p in rules.ADDRESSING])} OR {any_of('b', rules.OVERRIDES)} AS addressed,
  {any_of('b', [rules.SECRECY])} AS secrecy, {any_of('b', rules.OVERRIDES)} AS over, {any_of('b', rules.IMPERATIVE)} AS imperative, {hidden} AS hidden
  FROM hits)"""


def levels(delivery: str = "visible") -> str:
    """CTEs up to levels: a row for each line and capability. delivery: visible text outside code, the same in code, or hidden text."""
    names = list(rules.INTENTS)
    gate = {} if delivery == "hidden" else {"exfil-url": "(i_exfil_data OR addressed OR secrecy OR over)"} | dict.fromkeys(("transaction", "browser-action"), "(addressed OR imperative OR secrecy OR over)")
    kept = ", ".join(f"i_{col(n)} AND {gate.get(n, 'TRUE')} AS k_{col(n)}" for n in names)
    any_u = "(" + " OR ".join(f"u_{col(n)}" for n in names) + ")"
    any_k = "(" + " OR ".join(f"k_{col(n)}" for n in names) + ")"
    best = lambda a: "greatest(" + ", ".join(f"CASE WHEN {a}_{col(n)} THEN {rules.INTENTS[n][0]} ELSE 0 END" for n in names) + ")"
    caps = ", ".join(f"({q(c)}, {'[' + ', '.join(map(q, a)) + ']' if a else '[]::VARCHAR[]'})" for c, a in rules.CAPABILITIES.items())
    lost = " OR ".join(f"(k_{col(n)} AND NOT list_has_any(abilities, [{', '.join(map(q, needs))}]))" for n, (_, needs) in rules.INTENTS.items() if needs)
    capable = " OR ".join(f"k_{col(n)}" for n in rules.CRITICAL_CAPABLE)
    only = "k_exfil_url AND NOT (" + " OR ".join(f"k_{col(n)}" for n in names if n != "exfil-url") + ")"
    strong, discounted = {"hidden": ("(addressed OR base >= 6)", "FALSE"), "code": ("base >= 6", "TRUE"), "visible": ("base >= 6", f"NOT {any_u}")}[delivery]
    strong = f"{strong} AND (addressed OR NOT ({only}))" if delivery == "hidden" else f"{strong} AND NOT ({only})"
    notice = "k_content_protection AND NOT (" + " OR ".join(f"k_{col(n)}" for n in names if n != "content-protection") + ")"
    capped = notice if delivery != "hidden" else "FALSE"
    return f"""{facts()},
kept AS (SELECT *, {kept} FROM facts),
based AS (SELECT *, {any_k} AS has, (CASE WHEN {any_u} THEN {best('u')} ELSE {best('k')} END) + addressed::INT + {"1" if delivery == "hidden" else "hidden::INT"} AS raw, {discounted} AS discounted FROM kept),
caps(capability, abilities) AS (VALUES {caps}),
crossed AS (SELECT *, CASE WHEN discounted THEN least(raw, 2) ELSE raw END AS base FROM based, caps),
scored AS (SELECT *, CASE WHEN {lost} THEN least(base, 4) WHEN ({capable}) AND {strong} THEN greatest(base, 6) ELSE least(base, 4) END AS s FROM crossed),
levels AS (SELECT *, CASE WHEN NOT has THEN 'info' ELSE ['info', 'low', 'medium', 'high', 'critical'][greatest(1, least(5, CASE WHEN {capped} THEN least(s, 2) ELSE s END))] END AS level FROM scored)"""


OBSERVATIONS = """obs AS (
  SELECT doc_id, [""" + ", ".join(map(q, variants.TRANSFORMS)) + """][(doc_id % 8 + 1)::INT] AS transform_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id END AS record_uid, source,
         ['OK', 'OK', 'OK', 'OK', 'FAILED', 'PENDING', 'OK', 'SKIPPED', 'OK', 'NOT_RUN', 'OK'][(doc_id % 11 + 1)::INT] AS state,
         CASE WHEN doc_id % 11 IN (4, 5, 7, 9) THEN NULL ELSE [NULL, 'info', 'low', 'medium', 'high', 'critical'][((doc_id * 7) % 6 + 1)::INT] END AS level,
         [""" + ", ".join(map(q, variants.PLACEMENTS)) + """][(doc_id % 6 + 1)::INT] AS placement_id,
         CASE WHEN doc_id % 11 IN (4, 5, 7, 9) THEN []::VARCHAR[] WHEN doc_id % 4 = 0 THEN ['http-source', 'rendered-dom'] WHEN doc_id % 4 = 1 THEN ['http-source'] WHEN doc_id % 4 = 2 THEN ['rendered-dom', 'reader-markdown', 'accessibility-tree'] ELSE []::VARCHAR[] END AS pipelines
  FROM documents)"""
RANK = "CASE level WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 0 END"


def heatmap() -> str:
    """CTEs up to heat: every matrix, placement and pipeline with k, n, rate and state."""
    seen, carried = "list_contains(pipelines, p)", f"{RANK} >= 3 AND pipelines[1] = p"
    valid = "record_uid IS NOT NULL AND state = 'OK'"
    worst = "['FAILED', 'PENDING', 'NOT_RUN', 'SKIPPED'][min(CASE state WHEN 'FAILED' THEN 1 WHEN 'PENDING' THEN 2 WHEN 'NOT_RUN' THEN 3 WHEN 'SKIPPED' THEN 4 END)::INT]"
    return f"""{OBSERVATIONS}, cells AS (SELECT placement_id AS row, p AS "column", count(*) FILTER ({valid}) AS v, count(*) FILTER ({valid} AND {seen}) AS s, count(*) FILTER ({valid} AND {seen} AND {carried}) AS dd, count(*) FILTER ({valid} AND {carried}) AS da,
  CASE WHEN count(*) FILTER ({valid}) > 0 THEN 'OK' ELSE {worst} END AS row_state FROM obs, (VALUES {', '.join(f'({q(x)})' for x in rules.PIPELINES)}) t(p) GROUP BY 1, 2 HAVING count(record_uid) > 0),
long AS (SELECT 'coverage' AS matrix, row, "column", 'all_valid' AS denominator_kind, s AS k, v AS n, row_state FROM cells UNION ALL SELECT 'detection', row, "column", 'observed', dd, s, row_state FROM cells UNION ALL SELECT 'detection', row, "column", 'all_valid', da, v, row_state FROM cells),
heat AS (SELECT matrix, row, "column", denominator_kind, 'medium' AS min_level, k, n, CASE WHEN row_state = 'OK' AND n = 0 THEN 'N/A' ELSE row_state END AS state, CASE WHEN row_state = 'OK' AND n > 0 THEN k / n END AS rate FROM long)"""


def licence_name(x: str) -> str:
    y = f"lower(trim(coalesce({x}, '')))"
    for pattern, by in ((r"^the[\s-]+", ""), (r"[\s_]+", "-"), (r"-?licen[cs]e$", ""), (r"^creativecommons\.org/licen[cs]es/", ""), (r"/$", "")):
        y = f"regexp_replace({y}, {q(pattern)}, {q(by)}, 'g')"
    return y


def spdx(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({licence_name(x)}, {q(p)}) THEN {q(n)}" for n, p, *_ in rules.LICENCES) + " END"


def reserved(h: str) -> str:
    h = f"regexp_replace(lower({h}), '\\.$', '')"
    return f"({h} IN ({', '.join(map(q, rules.RESERVED_NAMES))}) OR " + " OR ".join(f"{h} = {q(s)} OR ends_with({h}, {q('.' + s)})" for s in rules.RESERVED_SUFFIXES) + ")"


def targets() -> str:
    """CTE targets: doc_id, kind, m of distinct real destinations in documents."""
    two = "\\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\\b"
    wallet = "\\b(?:0x[0-9a-fA-F]{40}|bc1[02-9ac-hj-np-z]{11,71})\\b"
    found = lambda name, p, g=0: f"{name} AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(p)}, {g})) AS m FROM documents)"
    url_host = "regexp_extract(m, '(?i)^https?://(?:[^@/?#]*@)?([^/:?#]*)', 1)"
    return f"""{found('e', corpus.EMAIL_HOST)}, {found('i', two)}, {found('u', corpus.URL)}, {found('r', re.sub(r'[\\]u([0-9A-F]{4})', lambda m: chr(int(m[1], 16)), corpus.PROTOCOL_RELATIVE), 1)}, {found('w', wallet)},
targets AS (SELECT DISTINCT doc_id, 'email' AS kind, m FROM e WHERE NOT {reserved("regexp_extract(m, '@([^@]*)$', 1)")} UNION ALL SELECT DISTINCT doc_id, 'ipv4', m FROM i WHERE m NOT IN ('127.0.0.1', '0.0.0.0')
  UNION ALL SELECT DISTINCT doc_id, 'url', m FROM u WHERE NOT {reserved(url_host)} UNION ALL SELECT DISTINCT doc_id, 'protocol-relative', '//' || m FROM r WHERE NOT {reserved('m')} UNION ALL SELECT DISTINCT doc_id, 'wallet', m FROM w)"""


def relevance(x: str) -> str:
    """Why a text is irrelevant, null if it isn't."""
    trimmed = f"regexp_replace(coalesce({x}, ''), {q('^' + JS_SPACE + '|' + JS_SPACE + '$')}, '', 'g')"
    units = f"length({trimmed}) + len(regexp_extract_all({trimmed}, {q('[' + chr(0x10000) + '-' + chr(0x10FFFF) + ']')}))"
    return f"CASE WHEN {units} < {corpus.MIN_CHARS} THEN 'EX-IRRELEVANT-EMPTY' WHEN " + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in corpus.PLACEHOLDERS) + " THEN 'EX-IRRELEVANT-PLACEHOLDER' END"
