"""DuckDB SQL that recomputes the engine's results in another way, for checking.

Detection follows the same rules but works on rows: spans come from unnested
match lists and a running sum, overlaps are resolved rule by rule with anti
joins, and masked texts are put together with ``string_agg``.
"""

from __future__ import annotations

from collections.abc import Sequence

from hushframe.functions.catalog import DOUBLED_SCHEMES, SECRET_DETECTORS, Rule
from hushframe.functions.spans import TOKEN_PATTERN


def q(value: str) -> str:
    """A DuckDB string literal."""
    return "'" + value.replace("'", "''") + "'"


def accepted(rules: Sequence[Rule], source: str = "src", exclusions: Sequence[str] = ()) -> str:
    """CTEs ending in ``acc(id, s, e, et, rid, v)`` over ``source(id, text)``."""
    parts = []
    for i, rule in enumerate(rules):
        rx = q(rule.pattern)
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT id, regexp_extract_all(text, {rx}) AS m,"
            f" string_split_regex(text, {rx}) AS g FROM {source} WHERE regexp_matches(text, {rx})),\n"
            f"u{i} AS (SELECT id, unnest(m) AS v, unnest(g[1:len(m)]) AS gap,"
            f" unnest(range(1, len(m) + 1)) AS i FROM m{i}),\n"
            f"s{i} AS (SELECT id, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY id ORDER BY i)"
            f" - length(v) AS BIGINT) AS s, v FROM u{i})"
        )
    drop = f" WHERE v NOT IN ({', '.join(q(x) for x in exclusions)})" if exclusions else ""
    union = " UNION ALL ".join(
        f"SELECT id, s, s + length(v) AS e, {i} AS rank, {q(r.entity_type)} AS et, {q(r.rule_id)} AS rid, v"
        f" FROM s{i}{drop}"
        for i, r in enumerate(rules)
    )
    parts.append(f"spans AS MATERIALIZED ({union})")
    parts.append("acc0 AS MATERIALIZED (SELECT * FROM spans WHERE rank = 0)")
    for i in range(1, len(rules)):
        parts.append(
            f"acc{i} AS MATERIALIZED (SELECT * FROM acc{i - 1} UNION ALL SELECT x.* FROM spans x WHERE x.rank = {i}"
            f" AND NOT EXISTS (SELECT 1 FROM acc{i - 1} a WHERE a.id = x.id AND a.s < x.e AND x.s < a.e))"
        )
    parts.append(f"acc AS MATERIALIZED (SELECT id, s, e, et, rid, v FROM acc{len(rules) - 1})")
    return ",\n".join(parts)


def row_tokens(source: str = "src") -> str:
    """CTE ``tok(id, et, v, token)``: numbering that restarts in every row."""
    return (
        f"res AS (SELECT id, regexp_extract(t, '^\\[(.+)_\\d+\\]$', 1) AS et,"
        f" max(TRY_CAST(regexp_extract(t, '_(\\d+)\\]$', 1) AS INTEGER)) AS top FROM"
        f" (SELECT id, unnest(regexp_extract_all(text, {q(TOKEN_PATTERN)})) AS t FROM {source}) GROUP BY ALL),\n"
        "tok AS MATERIALIZED (SELECT k.id, k.et, k.v, '[' || k.et || '_' ||"
        " (row_number() OVER (PARTITION BY k.id, k.et ORDER BY k.f) + coalesce(r.top, 0)) || ']' AS token"
        " FROM (SELECT id, et, v, min(s) AS f FROM acc GROUP BY ALL) k"
        " LEFT JOIN res r ON r.id = k.id AND r.et = k.et)"
    )


def masked(source: str = "src", token: str = "t.token", join: str = "JOIN tok t ON t.id = a.id AND t.et = a.et AND t.v = a.v") -> str:
    """CTE ``masked(id, masked_text)`` from ``acc`` and its tokens."""
    return (
        f"pieces AS (SELECT a.id, a.s, a.e, {token} AS token,"
        f" lag(a.e, 1, 0) OVER (PARTITION BY a.id ORDER BY a.s) AS pe FROM acc a {join}),\n"
        "built AS (SELECT p.id, string_agg(substring(d.text, CAST(p.pe + 1 AS BIGINT), CAST(p.s - p.pe AS BIGINT))"
        f" || p.token, '' ORDER BY p.s) AS head, max(p.e) AS last FROM pieces p JOIN {source} d ON d.id = p.id GROUP BY p.id),\n"
        "masked AS MATERIALIZED (SELECT d.id, CASE WHEN b.id IS NULL THEN d.text ELSE"
        f" b.head || substring(d.text, CAST(b.last + 1 AS BIGINT)) END AS masked_text FROM {source} d LEFT JOIN built b ON b.id = d.id)"
    )


def mask_rows(source_sql: str, rules: Sequence[Rule], select: str, exclusions: Sequence[str] = ()) -> str:
    """Row-scope masking of ``source_sql`` (id, text), then ``select``."""
    return (
        f"WITH src AS MATERIALIZED ({source_sql}),\n{accepted(rules, exclusions=exclusions)},\n"
        f"{row_tokens()},\n{masked()}\n{select}"
    )


def redacted(source_sql: str, rules: Sequence[Rule], select: str) -> str:
    """One-way masking."""
    return (
        f"WITH src AS MATERIALIZED ({source_sql}),\n{accepted(rules)},\n"
        f"{masked(token=repr('[') + ' || a.et || ' + repr(']'), join='')}\n{select}"
    )


def found(source_sql: str, rules: Sequence[Rule], select: str) -> str:
    """Findings only."""
    return f"WITH src AS MATERIALIZED ({source_sql}),\n{accepted(rules)}\n{select}"


def scope_tokens(session: str | None, order: str) -> str:
    """CTE ``tok(id.., token)`` with numbering over a session or the whole table; ``src`` has the columns."""
    by = f"d.{session}, " if session else ""
    part = f"{session}, et" if session else "et"
    return (
        f"firsts AS (SELECT {by}a.et, a.v, min((d.{order}, a.s)) AS f FROM acc a JOIN src d ON d.id = a.id GROUP BY ALL),\n"
        f"tok AS MATERIALIZED (SELECT *, '[' || et || '_' || row_number() OVER (PARTITION BY {part} ORDER BY f) || ']'"
        " AS token FROM firsts)"
    )


def secret_names(text: str) -> str:
    """Comma-joined detector names."""
    items = ", ".join(
        f"CASE WHEN regexp_matches({text}, {q(rx)}) THEN {q(name)} END" for name, rx in SECRET_DETECTORS
    )
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


def has_secret(text: str) -> str:
    """True when a detector fires."""
    return "(" + " OR ".join(f"regexp_matches({text}, {q(rx)})" for _, rx in SECRET_DETECTORS) + ")"


def dedupe_scheme(text: str) -> str:
    """Nested replaces, one per scheme (RE2 has no back-references)."""
    out = text
    for scheme in DOUBLED_SCHEMES:
        out = f"regexp_replace({out}, '(?i)\\b{scheme}://{scheme}://', '{scheme}://', 'g')"
    return out


def luhn(digits: str) -> str:
    """Checksum arithmetic over a string of digits."""
    d = f"CAST(substring({digits}, length({digits}) - CAST(i AS BIGINT), 1) AS INTEGER)"
    return (
        f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {d}"
        f" WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END)) % 10 = 0"
    )
