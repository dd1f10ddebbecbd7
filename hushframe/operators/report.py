"""Counts, summaries and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import columns, spans
from hushframe.functions.catalog import Rule, chosen_rules
from hushframe.operators.literals import find_literals
from hushframe.operators.skew import join_null_safe

# Entity types named first in a summary, with their display names.
SUMMARY_NAMES = {"NAME": "Name", "EMAIL": "Email", "PHONE": "Phone", "ID": "ID", "CUSTOM": "Custom"}


def entity_counts(vault: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct tokens per label.  Labels other than capitals and underscores are not counted."""
    labelled = vault.select(
        *by,
        "token",
        F.regexp_extract("token", r"^\[([A-Z_]+)_\d+\]$", 1).alias("entity_type"),
    ).filter(F.col("entity_type") != "")
    return labelled.distinct().groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def metrics_summary(vault: DataFrame, by: Sequence[str] = (), first_seen: str | None = None) -> DataFrame:
    """One line per group, such as ``2 Names, 1 Email, 3 CVEs``.

    Names, emails, phones, IDs and custom hits come first; other labels follow in
    order of ``first_seen`` when the vault has such a column, else by name.
    """
    counts = entity_counts(vault, by)
    if first_seen is not None:
        seen = vault.withColumn(
            "entity_type", F.regexp_extract("token", r"^\[([A-Z_]+)_\d+\]$", 1)
        ).groupBy(*by, "entity_type").agg(F.min(first_seen).alias("_seen"))
        counts = counts.join(seen, [*by, "entity_type"])
    else:
        counts = counts.withColumn("_seen", F.col("entity_type"))
    rank = F.lit(len(SUMMARY_NAMES))
    shown = F.col("entity_type")
    for i, (label, display) in enumerate(SUMMARY_NAMES.items()):
        rank = F.when(F.col("entity_type") == label, i).otherwise(rank)
        shown = F.when(F.col("entity_type") == label, display).otherwise(shown)
    part = F.concat(F.col("n").cast("string"), F.lit(" "), shown, F.when(F.col("n") > 1, "s").otherwise(""))
    # One entry per label, so the list is as short as the rule table.
    parts = F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("_seen").alias("s"), part.alias("p"))))
    line = F.array_join(F.transform(parts, lambda x: x["p"]), ", ")
    return counts.groupBy(*by).agg(
        F.when(F.size(parts) == 0, "0 entities masked").otherwise(line).alias("summary")
    )


def request_counts(df: DataFrame, session_cols: Sequence[str] = ()) -> DataFrame:
    """Number of texts handled, per session or in all."""
    return df.groupBy(*session_cols).agg(F.count(F.lit(1)).alias("requests"))


def entity_totals(
    df: DataFrame, by: Sequence[str], text_col: str = "text", rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Findings and texts with findings, per group, entity type and rule.

    Each text is counted by itself first, so the shuffle carries partial sums only.
    """
    counts = spans.type_counts(spans.resolved_findings(text_col, chosen_rules(rules)))
    return (
        df.select(*by, F.expr(f"inline({counts})"))
        .groupBy(*by, "entity_type", "rule_id")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"))
    )


def entity_profile(
    df: DataFrame, by: Sequence[str], text_col: str = "text", rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Findings and distinct values per entity type and source column, with subtotals.

    Subtotal rows have nulls in the rolled-up columns.
    """
    found = df.select(*by, F.inline(columns.detect(text_col, rules)))
    return found.rollup("entity_type", *by).agg(
        F.count(F.lit(1)).alias("findings"),
        F.approx_count_distinct("value").alias("approx_values"),
    )


def entity_sketches(
    df: DataFrame, by: Sequence[str], text_col: str = "text", rules: Sequence[Rule] | None = None, lg_k: int = 14
) -> DataFrame:
    """Per group and entity type the findings and an HLL sketch of their values, to be kept and merged later.

    A sketch holds at most 2 ** ``lg_k`` bytes, whatever the number of values.
    """
    found = df.select(*by, F.inline(columns.detect(text_col, rules)))
    return found.groupBy(*by, "entity_type").agg(
        F.count(F.lit(1)).alias("findings"), F.hll_sketch_agg("value", lg_k).alias("sketch")
    )


def merged_profile(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings and estimated distinct values per entity type for any coarser grouping; no text is read again."""
    return sketches.groupBy(*by, "entity_type").agg(
        F.sum("findings").alias("findings"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_values")
    )


def leak_audit(
    masked: DataFrame, by: Sequence[str] = (), masked_col: str = "masked_text", tokens_col: str = "tokens"
) -> DataFrame:
    """Per group and label, how many masked values were looked for in their own masked text, and how many still stand there.

    The tokens lie in the same row as the text, so each row is looked at by itself
    and only partial sums are shuffled.
    """
    checked = F.transform(
        tokens_col, lambda t: F.struct(t["entity_type"].alias("entity_type"), F.col(masked_col).contains(t["value"]).alias("left"))
    )
    return (
        masked.select(*by, F.inline(checked))
        .groupBy(*by, "entity_type")
        .agg(F.count(F.lit(1)).alias("checked"), F.sum(F.col("left").cast("long")).alias("leaked"))
    )


def row_leaks(masked: DataFrame, masked_col: str = "masked_text", tokens_col: str = "tokens") -> DataFrame:
    """Rows whose masked text still holds one of their own values.  Narrow."""
    return masked.filter(F.exists(tokens_col, lambda t: F.col(masked_col).contains(t["value"])))


def redetect_audit(
    masked: DataFrame, by: Sequence[str] = (), masked_col: str = "masked_text", rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Per group, how many masked texts were searched again, and in how many something was found.  Any scope."""
    left = F.size(columns.detect(masked_col, rules))
    return masked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"), F.sum(F.when(left > 0, 1).otherwise(0)).cast("long").alias("leaked")
    )


def vault_leaks(
    masked: DataFrame,
    vault: DataFrame,
    session_col: str,
    masked_col: str = "masked_text",
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Vault values that detection still finds in a masked text of their session.

    For vaults shared by many texts: what is left over (normally nothing) is
    found first and then looked up, so texts are never paired with values.
    """
    left_over = masked.select(
        F.col(session_col).cast("string").alias("session_id"), F.inline(columns.detect(masked_col, rules))
    ).select("session_id", "entity_type", "value").distinct()
    return vault.join(left_over, ["session_id", "entity_type", "value"], "left_semi")


def vault_value_leaks(
    masked: DataFrame,
    vault: DataFrame,
    keep: Sequence[str],
    session_col: str | None = None,
    masked_col: str = "masked_text",
) -> DataFrame:
    """``keep``, ``start``, ``end``, ``entity_type``, ``value``: every place of a vault value in a masked text of its session.

    Values are looked for literally, whether or not a rule would find them again; what
    placeholders are made of does not count.  Without ``session_col`` all values are
    looked for in all texts (corpus scope).  See ``literals`` for how: values and texts
    are never paired.
    """
    placeholder = spans.TOKEN_PATTERN
    values = vault.filter(F.col("value").isNotNull()).select(
        *([F.col("session_id").cast("string").alias("session_id")] if session_col else []), "entity_type", "value"
    )
    # A placeholder becomes as many characters that no value holds, so that offsets stay.
    blanks = F.expr(
        f"array_join(zip_with(split({masked_col}, {spans.quote(placeholder)}, -1),"
        f" regexp_extract_all({masked_col}, {spans.quote(placeholder)}, 0),"
        " (_gap, _t) -> concat(_gap, coalesce(repeat('\\u0000', length(_t)), ''))), '')"
    )
    text = F.when(F.col(masked_col).contains("["), blanks).otherwise(F.col(masked_col))
    rows = masked.select(*keep, *([F.col(session_col).cast("string").alias("session_id")] if session_col else []), text.alias("_text"))
    on = ["session_id"] if session_col else []
    return find_literals(rows, [*keep, *on], values, "_text", "value", on).drop(*on)


def vault_leak_audit(
    masked: DataFrame, vault: DataFrame, session_col: str | None = None, masked_col: str = "masked_text"
) -> DataFrame:
    """Per label, how many vault values were looked for and how many still stand in a masked text of their session."""
    on = [session_col] if session_col else []
    keys = [*(["session_id"] if session_col else []), "entity_type", "value"]
    found = vault_value_leaks(masked, vault, on, session_col, masked_col)
    if session_col:
        found = found.withColumn("session_id", F.col(session_col).cast("string"))
    left = found.select(*keys).distinct().withColumn("_left", F.lit(1))
    looked_for = vault.filter(F.col("value").isNotNull() & (F.col("value") != "")).select(*keys).distinct()
    return join_null_safe(looked_for, left, keys, "left").groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("checked"), F.count("_left").alias("leaked")
    )


def roundtrip_audit(
    revealed: DataFrame, by: Sequence[str] = (), text_col: str = "text", revealed_col: str = "revealed_text"
) -> DataFrame:
    """Per group, how many texts were restored and how many of them differ from the original, in rows that hold both."""
    differs = ~F.col(text_col).eqNullSafe(F.col(revealed_col))
    return revealed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"), F.sum(differs.cast("long")).alias("changed")
    )
