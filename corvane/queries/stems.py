"""The stemmer as SQL: common table expressions that give the stem of every distinct token, for engines without it."""

from __future__ import annotations

from ..functions.stemmer import STEP2, STEP3, STEP4
from ..functions.words import SYNONYMS


def _shape(x: str) -> str:
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN contains('aeiou', {x}[i]) OR ({x}[i] = 'y' AND i > 1 AND NOT contains('aeiou', {x}[i - 1])) THEN 'v' ELSE 'c' END), '')"


def _measure(x: str) -> str:
    return f"length(replace(trim({_shape(x)}, 'c'), 'v', ''))"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '[^aeiou][aeiou][^aeiouwxy]$')"


def _but(x: str, n: int | str) -> str:
    return f"left({x}, length({x}) - {n})"


def _replaced(name: str, source: str, rules: dict[str, str], above: int) -> str:
    ends = " ".join(f"WHEN suffix(w, '{s}') THEN '{s}'" for s in rules)
    by = " ".join(f"WHEN '{s}' THEN '{b}'" for s, b in rules.items())
    return f"""{name}a AS MATERIALIZED (SELECT token, w, CASE {ends} END AS e FROM {source}), {name}b AS MATERIALIZED (SELECT token, w, e, {_but('w', "length(e)")} AS r FROM {name}a),
        {name} AS MATERIALIZED (SELECT token, CASE WHEN e IS NOT NULL AND {_measure('r')} > {above} THEN r || CASE e {by} END ELSE w END AS w FROM {name}b)"""


#: From tok(id, token): stems(token, stem), and cnt(id, token, n) with synonyms at 0.49, own(id, token, n) without, df(token, df).
COUNTS = f"""
    st0 AS MATERIALIZED (SELECT DISTINCT token FROM tok),
    st1 AS MATERIALIZED (SELECT token, CASE WHEN suffix(token, 'sses') OR suffix(token, 'ies') THEN {_but('token', 2)} WHEN suffix(token, 'ss') THEN token WHEN suffix(token, 's') THEN {_but('token', 1)} ELSE token END AS w FROM st0),
    st2 AS MATERIALIZED (SELECT token, w, CASE WHEN suffix(w, 'eed') THEN NULL WHEN suffix(w, 'ed') THEN {_but('w', 2)} WHEN suffix(w, 'ing') THEN {_but('w', 3)} END AS r FROM st1),
    st3 AS MATERIALIZED (SELECT token, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(_but('w', 3))} > 0 THEN {_but('w', 1)} ELSE w END WHEN r IS NULL OR NOT contains({_shape('r')}, 'v') THEN w
        WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN length(r) > 1 AND r[-1] = r[-2] AND NOT contains('aeioulsz', r[-1]) THEN {_but('r', 1)} WHEN {_measure('r')} = 1 AND {_short('r')} THEN r || 'e' ELSE r END AS w FROM st2),
    st4 AS MATERIALIZED (SELECT token, CASE WHEN suffix(w, 'y') AND contains({_shape(_but('w', 1))}, 'v') THEN {_but('w', 1)} || 'i' ELSE w END AS w FROM st3),
    {_replaced('st5', 'st4', STEP2, 0)}, {_replaced('st6', 'st5', STEP3, 0)}, {_replaced('st7', 'st6', STEP4, 1)},
    st8 AS MATERIALIZED (SELECT token, w, {_measure(_but('w', 1))} AS m FROM st7),
    stems AS MATERIALIZED (SELECT token, CASE WHEN length(token) <= 2 THEN token WHEN suffix(w, 'e') AND (m > 1 OR (m = 1 AND NOT {_short(_but('w', 1))})) THEN {_but('w', 1)} WHEN suffix(w, 'll') AND m > 1 THEN {_but('w', 1)} ELSE w END AS stem FROM st8),
    own AS MATERIALIZED (SELECT id, stem AS token, count(*)::DOUBLE AS n FROM tok JOIN stems USING (token) GROUP BY 1, 2),
    syn(t, s) AS (VALUES {", ".join(f"('{t}', '{s}')" for g in SYNONYMS for t in g for s in g if s != t)}),
    cnt AS MATERIALIZED (SELECT id, token, n FROM own UNION ALL SELECT id, s, 0.49 FROM (SELECT DISTINCT id, s FROM own JOIN syn ON t = token) x WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.id = x.id AND o.token = x.s)),
    df AS MATERIALIZED (SELECT token, count(*) AS df FROM own GROUP BY 1)"""
TOKENS = "regexp_extract_all(replace(lower({0}), '_', ' '), '[a-z0-9]+')"
#: The same from all documents.
DOC_COUNTS = f"tok AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS token FROM documents), {COUNTS}"
