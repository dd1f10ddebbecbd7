"""Row-local detection and masking as Spark SQL expressions.

Each function returns SQL expression text over a string column, so the same
expression serves ``F.expr``, ``selectExpr`` and ``CREATE TEMPORARY FUNCTION``.
Nothing here shuffles and nothing leaves the JVM.

A finding is ``struct<start,end,priority,entity_type,rule_id,value>`` with
0-based, end-exclusive code-point offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from hushframe.functions.catalog import SECRET_DETECTORS, Rule

FINDINGS_TYPE = (
    "array<struct<start:int,end:int,priority:int,entity_type:string,rule_id:string,value:string>>"
)
TOKEN_PATTERN = r"\[[^\[\] \t\r\n]+_\d+\]"
NO_FINDINGS = f"cast(array() AS {FINDINGS_TYPE})"
# Long arrays are built in blocks of this size.
_BLOCK = 128


def quote(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Quoted runs, classes without nested ones, escapes: only a bare word boundary is left to be told apart.
_REGEX_PIECE = re.compile(r"\\Q.*?(?:\\E|\Z)|\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|[^\\\[]+|.", re.DOTALL)
_BOUNDARIES = {r"\b": r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))", r"\B": r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"}


def regex(pattern: str) -> str:
    """A Spark SQL literal of ``pattern`` with word boundaries as in JavaScript and RE2: between ``\\w`` and anything else.

    Java 17 takes every letter and digit of Unicode for part of a word there, so a
    value right after ``\u00e9`` would not be found.
    """
    return quote("".join(_BOUNDARIES.get(piece, piece) for piece in _REGEX_PIECE.findall(pattern)))


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def gate(text: str, rule: Rule) -> str:
    """A cheap test that every text matching ``rule`` passes."""
    tests = []
    if rule.hints:
        tests.append("(" + " OR ".join(f"contains({text}, {quote(h)})" for h in rule.hints) + ")")
    if rule.gate:
        tests.append(f"rlike({text}, {quote(rule.gate)})")
    return " AND ".join(tests) or f"{text} IS NOT NULL"


def _running(items: str, emit: str, advance: str) -> str:
    """A running int over ``items``: ``emit`` before and ``advance`` after each ``_x``, from ``_c.at``.

    Built block by block: appending to one long array would copy it every time.
    """
    within = (
        f"aggregate(slice({items}, _b * {_BLOCK} + 1, {_BLOCK}),"
        " named_struct('at', _a.at, 'out', cast(array() AS array<int>)),"
        f" (_c, _x) -> named_struct('at', {advance}, 'out', array_append(_c.out, {emit})))"
    )
    carried = "named_struct('at', _w.at, 'blocks', array_append(_a.blocks, _w.out))"
    return (
        f"aggregate(sequence(0, (size({items}) - 1) div {_BLOCK}),"
        " named_struct('at', 0, 'blocks', cast(array() AS array<array<int>>)),"
        f" (_a, _b) -> {bind(within, '_w', carried)},"
        " _a -> flatten(_a.blocks))"
    )


def _groups(items: str, is_first: str, group: str) -> str:
    """Cut ``items`` before every index ``_i`` where ``is_first`` holds and map each slice ``_sl`` to ``group``."""
    stop = f"CASE WHEN _j + 1 < size(_cuts) THEN _cuts[_j + 1] ELSE size({items}) END"
    each = bind(f"slice({items}, _at + 1, {stop} - _at)", "_sl", group)
    cuts = f"filter(sequence(0, size({items}) - 1), _i -> _i = 0 OR {is_first})"
    return bind(cuts, "_cuts", f"transform(_cuts, (_at, _j) -> {each})")


def _rule_hits(text: str, rule: Rule) -> str:
    """The matches of one rule and the gaps between them, or null without a match."""
    pattern = regex(rule.pattern)
    hits = (
        f"named_struct('priority', {rule.priority}, 'entity_type', {quote(rule.entity_type)},"
        f" 'rule_id', {quote(rule.rule_id)}, 'm', _m, 'g', split({text}, {pattern}, -1))"
    )
    found = bind(f"regexp_extract_all({text}, {pattern}, 0)", "_m", f"CASE WHEN size(_m) > 0 THEN {hits} END")
    return f"CASE WHEN {gate(text, rule)} THEN {found} END"


def all_findings(text: str, rules: Sequence[Rule]) -> str:
    """Every finding of every rule, overlaps included.

    Matches are placed by the lengths of the gaps between them.
    """
    if not rules:
        return NO_FINDINGS
    families: dict[str | None, list[str]] = {}
    for rule in rules:
        families.setdefault(rule.family, []).append(_rule_hits(text, rule))
    hits_type = "array<struct<priority:int,entity_type:string,rule_id:string,m:array<string>,g:array<string>>>"
    plain = families.pop(None, [])
    parts = [f"array({', '.join(plain)})"] if plain else []
    for needed, members in families.items():
        parts.append(
            f"CASE WHEN rlike({text}, {quote(needed)}) THEN array({', '.join(members)})"
            f" ELSE cast(array() AS {hits_type}) END"
        )
    pieces = (
        "zip_with(slice(_r.g, 1, size(_r.m)), _r.m,"
        " (_g, _v) -> named_struct('gap', length(_g), 'len', length(_v)))"
    )
    starts = bind(pieces, "_z", _running("_z", "_c.at + _x.gap", "_c.at + _x.gap + _x.len"))
    finding = (
        "named_struct('start', _s, 'end', _s + length(_v), 'priority', _r.priority,"
        " 'entity_type', _r.entity_type, 'rule_id', _r.rule_id, 'value', _v)"
    )
    placed = f"zip_with({starts}, _r.m, (_s, _v) -> {finding})"
    return f"flatten(transform(array_compact(concat({', '.join(parts)})), _r -> {placed}))"


def any_match(text: str, rules: Sequence[Rule]) -> str:
    """True when some rule matches; stops at the first one that does."""
    families: dict[str | None, list[str]] = {}
    for rule in rules:
        families.setdefault(rule.family, []).append(
            f"({gate(text, rule)} AND rlike({text}, {regex(rule.pattern)}))"
        )
    tests = families.pop(None, [])
    for needed, members in families.items():
        tests.append(f"(rlike({text}, {quote(needed)}) AND ({' OR '.join(members)}))")
    return f"coalesce({' OR '.join(tests)}, false)" if tests else "false"


def without_values(findings: str, values: Iterable[str]) -> str:
    """Drop findings whose value is on the allow list."""
    values = list(values)
    if not values:
        return findings
    listed = ", ".join(quote(v) for v in values)
    return f"filter({findings}, _f -> NOT array_contains(array({listed}), _f.value))"


def _best_of(cluster: str) -> str:
    """Greedy choice among findings that touch: best priority, then leftmost, then longest."""
    ranked = (
        f"sort_array(transform({cluster}, _f -> named_struct("
        "'priority', _f.priority, 'start', _f.start, 'shorter', _f.start - _f.end, 'finding', _f)))"
    )
    greedy = (
        f"sort_array(aggregate({ranked}, {NO_FINDINGS}, (_kept, _r) -> CASE"
        " WHEN exists(_kept, _k -> _k.start < _r.finding.end AND _r.finding.start < _k.end) THEN _kept"
        " ELSE array_append(_kept, _r.finding) END))"
    )
    return f"CASE WHEN size({cluster}) < 2 THEN {cluster} ELSE {greedy} END"


def resolve_overlaps(findings: str) -> str:
    """Keep disjoint findings: best priority first, then leftmost, then longest.

    Most texts have no overlap at all and are left as they are.  In the others
    the findings fall into clusters that touch nothing else, and the choice is
    made within each cluster.
    """
    reach = _running("_o", "_c.at", "greatest(_c.at, _x.end)")
    chosen_each = _groups("_o", "_o[_i].start >= _reach[_i]", _best_of("_sl"))
    clustered = bind(reach, "_reach", f"flatten({chosen_each})")
    touching = "exists(sequence(1, size(_o) - 1), _i -> _o[_i].start < _o[_i - 1].end)"
    chosen = f"CASE WHEN size(_o) < 2 THEN _o WHEN {touching} THEN {clustered} ELSE _o END"
    return bind(f"sort_array({findings})", "_o", chosen)


def resolved_findings(
    text: str, rules: Sequence[Rule], exclusions: Iterable[str] = (), extra: str | None = None
) -> str:
    """Disjoint findings of ``text`` in reading order; ``extra`` names a column of findings made elsewhere."""
    found = all_findings(text, rules)
    if extra is not None:
        found = f"concat({found}, coalesce(cast({extra} AS {FINDINGS_TYPE}), {NO_FINDINGS}))"
    return resolve_overlaps(without_values(found, exclusions))


def _key(row: str) -> str:
    """Label and value as one string: strings are compared and hashed faster than structs."""
    return f"concat(lpad(length({row}.entity_type), 3, '0'), {row}.entity_type, {row}.value)"


def _label_of(key: str) -> str:
    return f"substring({key}, 4, cast(substring({key}, 1, 3) AS int))"


def _value_of(key: str) -> str:
    return f"substring({key}, 4 + cast(substring({key}, 1, 3) AS int))"


def value_spans(findings: str) -> str:
    """Each distinct value once, with all its spans; ``place`` is where it first stands."""
    sorted_hits = (
        f"sort_array(transform({findings}, _f -> named_struct('k', {_key('_f')},"
        " 's', named_struct('start', _f.start, 'end', _f.end))))"
    )
    row = (
        f"named_struct('entity_type', {_label_of('_sl[0].k')}, 'value', {_value_of('_sl[0].k')},"
        " 'place', _sl[0].s.start, 'taken', cast(null AS bigint), 'spans', transform(_sl, _x -> _x.s))"
    )
    grouped = _groups("_h", "_h[_i].k <> _h[_i - 1].k", row)
    empty = (
        "cast(array() AS array<struct<entity_type:string,value:string,place:int,taken:bigint,"
        "spans:array<struct<start:int,end:int>>>>)"
    )
    return bind(sorted_hits, "_h", f"CASE WHEN size(_h) = 0 THEN {empty} ELSE {grouped} END")


def type_counts(findings: str) -> str:
    """Per entity type and rule, the number of findings in this text."""
    hits = "size(filter(_tf, _f -> _f.entity_type = _k.entity_type AND _f.rule_id = _k.rule_id))"
    kinds = (
        "array_distinct(transform(_tf, _f ->"
        " named_struct('entity_type', _f.entity_type, 'rule_id', _f.rule_id)))"
    )
    return bind(
        findings, "_tf",
        f"transform({kinds}, _k -> named_struct('entity_type', _k.entity_type, 'rule_id', _k.rule_id, 'hits', {hits}))",
    )


def reserved_tokens(text: str) -> str:
    """Placeholders already written in the text; their numbers are not given out again."""
    return (
        f"CASE WHEN contains({text}, '[') THEN regexp_extract_all({text}, {quote(TOKEN_PATTERN)}, 0)"
        " ELSE cast(array() AS array<string>) END"
    )


def reserved_number(digits: str) -> str:
    """The number of a placeholder; what no long can hold counts as 0, its token is stepped over instead."""
    return f"CASE WHEN length({digits}) <= 18 THEN coalesce(try_cast({digits} AS bigint), 0L) ELSE 0L END"


def highest_reserved(tokens: str, entity_type: str) -> str:
    """The highest number a placeholder of ``entity_type`` already carries, else 0."""
    number = reserved_number(
        f"substring(_t, length({entity_type}) + 3, length(_t) - length({entity_type}) - 3)"
    )
    return (
        f"CASE WHEN size({tokens}) = 0 THEN 0L ELSE coalesce(array_max(transform(filter({tokens},"
        f" _t -> startswith(_t, concat('[', {entity_type}, '_'))), _t -> {number})), 0L) END"
    )


def free_tokens(reserved: str, entity_type: str, count: str) -> str:
    """The next ``count`` tokens of a label that do not stand in the text yet, compared as strings."""
    numbers = f"transform(sequence(1, {count} + size({reserved})), _n -> concat('[', {entity_type}, '_', _top + _n, ']'))"
    return bind(highest_reserved(reserved, entity_type), "_top", f"slice(array_except({numbers}, {reserved}), 1, {count})")


def rewrite(text: str, edits: str) -> str:
    """Replace spans of ``text``; ``edits`` is ``array<struct<start,end,token>>`` in reading order.

    Finding a character offset means walking the text from its start, so the
    text is cut into blocks of edits first and each block is rewritten by itself.
    """
    block = f"slice(_e, _b * {_BLOCK} + 1, {_BLOCK})"
    base = f"CASE WHEN _b = 0 THEN 0 ELSE _e[_b * {_BLOCK} - 1].end END"
    before = (
        "substring(_t, CASE WHEN _i = 0 THEN 1 ELSE _k[_i - 1].end - _from + 1 END,"
        " _x.start - CASE WHEN _i = 0 THEN _from ELSE _k[_i - 1].end END)"
    )
    pieces = f"array_join(transform(_k, (_x, _i) -> concat({before}, _x.token)), '')"
    rewritten = bind(
        block, "_k",
        bind(base, "_from", bind(f"substring({text}, _from + 1, _k[size(_k) - 1].end - _from)", "_t", pieces)),
    )
    blocks = f"transform(sequence(0, (size(_e) - 1) div {_BLOCK}), _b -> {rewritten})"
    tail = f"substring({text}, _e[size(_e) - 1].end + 1)"
    return bind(
        edits, "_e",
        f"CASE WHEN size(_e) = 0 THEN {text} ELSE concat(array_join({blocks}, ''), {tail}) END",
    )


def edits_within(numbered: str, base: str, length: str) -> str:
    """The edits of one part of a text, ``length`` characters from ``base`` on, out of its ``numbered_values``."""
    own = "filter(_n.spans, _s -> _s.start >= _base AND _s.end <= _base + _length)"
    moved = "named_struct('start', _s.start - _base, 'end', _s.end - _base, 'token', _n.token)"
    edits = f"sort_array(flatten(transform({numbered}, _n -> transform({own}, _s -> {moved}))))"
    return bind(base, "_base", bind(length, "_length", edits))


def numbered_values(findings: str, reserved: str) -> str:
    """Distinct values of one text with their tokens and spans, numbered per label from 1.

    Numbering starts above any number the text already uses for that label.
    """
    first_seen = (
        f"sort_array(transform({value_spans(findings)}, _v -> named_struct("
        "'place', _v.place, 'entity_type', _v.entity_type, 'value', _v.value, 'spans', _v.spans)))"
    )
    row = "named_struct('token', _free[_i], 'entity_type', _lab, 'value', _x.value, 'spans', _x.spans)"
    own = "filter(_d, _x -> _x.entity_type = _lab)"
    numbered = bind(own, "_own", bind(free_tokens("_rt", "_lab", "size(_own)"), "_free", f"transform(_own, (_x, _i) -> {row})"))
    labels = "array_distinct(transform(_d, _x -> _x.entity_type))"
    return bind(first_seen, "_d", bind(reserved, "_rt", f"flatten(transform({labels}, _lab -> {numbered}))"))


def protected(text: str, findings: str) -> str:
    """``struct<masked_text, tokens>`` for one text numbered by itself."""
    edits = (
        "sort_array(flatten(transform(_tab, _n -> transform(_n.spans, _s ->"
        " named_struct('start', _s.start, 'end', _s.end, 'token', _n.token)))))"
    )
    tokens = (
        "transform(_tab, _n -> named_struct('token', _n.token, 'entity_type', _n.entity_type, 'value', _n.value))"
    )
    body = bind(
        numbered_values("_pf", reserved_tokens(text)), "_tab",
        f"named_struct('masked_text', {rewrite(text, edits)}, 'tokens', {tokens})",
    )
    empty_table = "cast(array() AS array<struct<token:string,entity_type:string,value:string>>)"
    plain = f"named_struct('masked_text', {text}, 'tokens', {empty_table})"
    return bind(findings, "_pf", f"CASE WHEN size(_pf) = 0 THEN {plain} ELSE {body} END")


def labelled(text: str, findings: str) -> str:
    """One-way masking: every finding becomes its bare label, such as ``[EMAIL]``."""
    edits = (
        f"transform({findings}, _f -> named_struct('start', _f.start, 'end', _f.end,"
        " 'token', concat('[', _f.entity_type, ']')))"
    )
    return rewrite(text, edits)


# A test each text with that secret also passes; keeps the slow expressions off clean text.
_DETECTOR_GATES = {
    "AWS Credentials": "rlike({t}, 'A(?:KI|SI|GP|ID|RO|IP)A')",
    "JSON Web Token (JWT)": "contains({t}, 'eyJ')",
    "API Token/Key (GitHub/Slack/NPM)": "rlike({t}, '[-_][A-Za-z0-9_]{{10}}')",
    "Stripe API Key": "(contains({t}, 'k_test_') OR contains({t}, 'k_live_'))",
    "Database/API Secret": "(contains({t}, '=') OR contains({t}, ':')) AND rlike({t}, '[:=]\\\\s*[^ \\\\t\\\\r\\\\n\"\\']{{8}}')",
}


def has_secret(text: str) -> str:
    """True when any of the five detectors fires."""
    return "(" + " OR ".join(
        f"({_DETECTOR_GATES[name].format(t=text)} AND rlike({text}, {regex(rx)}))"
        for name, rx in SECRET_DETECTORS
    ) + ")"


def secret_names(text: str) -> str:
    """Names of the detectors that fire, in reporting order."""
    checks = ", ".join(
        f"CASE WHEN {_DETECTOR_GATES[name].format(t=text)} AND rlike({text}, {regex(rx)})"
        f" THEN {quote(name)} END"
        for name, rx in SECRET_DETECTORS
    )
    return f"array_compact(array({checks}))"
