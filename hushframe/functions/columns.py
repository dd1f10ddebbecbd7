"""Column functions over a text column, and the same as SQL functions.

``text`` and ``profile`` are column names (or SQL expressions); the result is a
``Column`` for ``select``/``withColumn`` in batch and streaming alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import spans
from hushframe.functions.catalog import (
    DOUBLED_SCHEMES,
    MAX_TEXT_CHARS,
    PROFILES,
    Rule,
    base_rules,
    chosen_rules,
    pack_rules,
)


def detect(
    text: str, rules: Sequence[Rule] | None = None, exclusions: Iterable[str] = (), extra: str | None = None
) -> Column:
    """Disjoint findings in reading order; ``extra`` names a column of findings made elsewhere."""
    return F.expr(spans.resolved_findings(text, chosen_rules(rules), exclusions, extra))


def protect(
    text: str, rules: Sequence[Rule] | None = None, exclusions: Iterable[str] = (), extra: str | None = None
) -> Column:
    """``struct<masked_text, tokens>``: the masked text and the tokens that restore it."""
    return F.expr(spans.protected(text, spans.resolved_findings(text, chosen_rules(rules), exclusions, extra)))


def mask(text: str, rules: Sequence[Rule] | None = None, exclusions: Iterable[str] = ()) -> Column:
    """The text with numbered placeholders; numbers restart in every row."""
    return protect(text, rules, exclusions)["masked_text"]


def redact(text: str, rules: Sequence[Rule] | None = None, exclusions: Iterable[str] = ()) -> Column:
    """The text with bare labels such as ``[EMAIL]``; cannot be undone."""
    return F.expr(spans.labelled(text, spans.resolved_findings(text, chosen_rules(rules), exclusions)))


def detect_by_profile(text: str, profile: str) -> Column:
    """Like ``detect`` with the profile named per row."""
    return F.expr(findings_by_profile(text, profile))


def findings_by_profile(text: str, profile: str) -> str:
    """Base rules for every row plus the pack its profile names; an unknown name is an error."""
    name = f"coalesce(lower(trim({profile})), 'general')"
    packs = [p for p in PROFILES if pack_rules(p)]
    branches = " ".join(
        f"WHEN {spans.quote(p)} THEN {spans.all_findings(text, pack_rules(p))}" for p in packs
    )
    unpacked = ", ".join(spans.quote(p) for p in PROFILES if p not in packs)
    extra = (
        f"CASE {name} {branches} ELSE CASE WHEN {name} IN ({unpacked}) THEN {spans.NO_FINDINGS}"
        f" ELSE raise_error(concat('unknown profile ', {name})) END END"
    )
    return spans.resolve_overlaps(f"concat({spans.all_findings(text, base_rules())}, {extra})")


def detect_secrets(text: str) -> Column:
    """Names of the secret detectors that fire, in reporting order."""
    return F.expr(spans.secret_names(text))


def has_secret(text: str) -> Column:
    """True when any secret detector fires."""
    return F.expr(spans.has_secret(text))


def reveal_from(text: str, tokens: str) -> Column:
    """Restore a text from a token array held in the same row (document scope)."""
    return F.expr(restored(text, f"map_from_entries(transform({tokens}, _t -> struct(_t.token, _t.value)))"))


def restored(text: str, lookup: str) -> str:
    """Replace each known token once; what a value itself looks like does not matter."""
    pattern = spans.quote(spans.TOKEN_PATTERN)
    body = (
        f"array_join(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0),"
        " (_gap, _tok) -> concat(_gap, coalesce(try_element_at(_lk, _tok), _tok, ''))), '')"
    )
    return f"CASE WHEN contains({text}, '[') THEN {spans.bind(lookup, '_lk', body)} ELSE {text} END"


def dedupe_scheme(text: Column | str) -> Column:
    """``mysql://mysql://host`` becomes ``mysql://host``."""
    column = F.col(text) if isinstance(text, str) else text
    doubled = spans.regex(rf"(?i)\b({'|'.join(DOUBLED_SCHEMES)})://\1://")
    return F.when(
        column.contains("://"), F.regexp_replace(column, F.expr(doubled), F.lit("$1://"))
    ).otherwise(column)


def truncated(text: str, limit: int = MAX_TEXT_CHARS) -> Column:
    """The first ``limit`` characters."""
    return F.substring(F.col(text), 1, limit)


def was_truncated(text: str, limit: int = MAX_TEXT_CHARS) -> Column:
    """True when the text is longer than ``limit``."""
    return F.length(text) > limit


def normalised_profile(profile: str) -> Column:
    """Trimmed, lower-case profile name; null means ``general``."""
    return F.coalesce(F.lower(F.trim(F.col(profile))), F.lit("general"))


def luhn_confidence(card: str) -> Column:
    """True when the digits of a card number pass the checksum.  Never decides masking."""
    return F.expr(f"luhn_check(regexp_replace({card}, '[- ]', ''))")


def register_sql_functions(spark: SparkSession) -> None:
    """Make the engine callable from SQL.

    ``pii_mask(text, profile)``, ``pii_redact(text, profile)``, ``pii_reveal(text, map)``,
    ``pii_secrets(text)`` and the table function ``pii_findings(text, profile)``.
    """
    found = findings_by_profile("text", "profile")
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(
        f"{create} pii_mask(text STRING, profile STRING) RETURNS STRING"
        f" RETURN {spans.protected('text', found)}.masked_text"
    )
    spark.sql(
        f"{create} pii_redact(text STRING, profile STRING) RETURNS STRING"
        f" RETURN {spans.labelled('text', found)}"
    )
    spark.sql(
        f"{create} pii_reveal(text STRING, tokens MAP<STRING, STRING>) RETURNS STRING"
        f" RETURN {restored('text', 'tokens')}"
    )
    spark.sql(
        f"{create} pii_secrets(text STRING) RETURNS ARRAY<STRING> RETURN {spans.secret_names('text')}"
    )
    spark.sql(
        f"{create} pii_findings(text STRING, profile STRING)"
        " RETURNS TABLE(start INT, `end` INT, priority INT, entity_type STRING, rule_id STRING, value STRING)"
        f" RETURN SELECT inline({found})"
    )
