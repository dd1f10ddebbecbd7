"""Detection operators: findings per row, findings as rows, secrets, places."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import columns, spans
from hushframe.functions.catalog import MAX_LABEL_CHARS, Rule, chosen_rules
from hushframe.operators.literals import find_literals
from hushframe.operators.skew import join_null_safe


def with_findings(
    df: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    name: str = "findings",
    extra: str | None = None,
) -> DataFrame:
    """Add the resolved findings of every row; ``extra`` names a column of findings made elsewhere."""
    return df.withColumn(name, columns.detect(text_col, rules, exclusions, extra))


def findings(
    df: DataFrame,
    keep: Sequence[str],
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    extra: str | None = None,
) -> DataFrame:
    """One row per finding with the ``keep`` columns; the text itself is not carried along."""
    return df.select(*keep, F.inline(columns.detect(text_col, rules, exclusions, extra)))


# Phrases of a dictionary come after the built-in rules for names and places.
DICTIONARY_PRIORITY = 4_000


def with_dictionary(
    df: DataFrame,
    id_cols: Sequence[str],
    dictionary: DataFrame,
    text_col: str = "text",
    phrase_col: str = "phrase",
    label_col: str = "label",
    name: str = "dictionary_findings",
    priority: int = DICTIONARY_PRIORITY,
) -> DataFrame:
    """Add the findings of a table of phrases, of any size, as an array column for ``extra`` parameters.

    ``dictionary`` has a phrase and the label of its placeholders.  A phrase is found
    where it stands letter for letter and no letter, digit, underscore or non-ASCII
    character goes on at either end.  ``id_cols`` identify a row.  All places are
    listed; overlaps are resolved with those of the rules, the longer of two that start
    together winning.  Only the places found are shuffled, and the rows that have some.
    """
    label = F.col(label_col)
    entries = dictionary.select(F.col(phrase_col).alias("value"), label.alias("entity_type"))
    usable = F.length("entity_type").between(1, MAX_LABEL_CHARS) & F.col("entity_type").rlike(r"^[^\[\] \t\r\n]+$")
    entries = entries.withColumn(
        "entity_type", F.when(usable, F.col("entity_type")).otherwise(F.raise_error(F.lit("a placeholder cannot carry this label")))
    )
    places = find_literals(df, id_cols, entries, text_col, "value", word_bounded=True)
    finding = F.struct(
        "start", "end", F.lit(priority).alias("priority"), "entity_type", F.lit("dictionary").alias("rule_id"), "value"
    )
    found = places.groupBy(*id_cols).agg(F.sort_array(F.collect_list(finding)).alias(name))
    return join_null_safe(df, found, id_cols, "left")


def allowed_values(
    df: DataFrame,
    id_cols: Sequence[str],
    allow_list: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    value_col: str = "value",
) -> DataFrame:
    """``df`` with ``allowed``: the row's own candidate values that stand in an allow-list table (null: none).

    Candidates are taken before overlaps are resolved, so an allowed value never
    hides another finding.  Only candidate values are shuffled, not texts, and
    Spark picks the joins from the real sizes.
    """
    candidates = f"array_distinct(transform({spans.all_findings(text_col, chosen_rules(rules))}, _f -> _f.value))"
    seen = df.select(*id_cols, F.explode(F.expr(candidates)).alias("_value"))
    listed = allow_list.select(F.col(value_col).alias("_value")).distinct()
    hits = seen.join(listed, "_value", "left_semi").groupBy(*id_cols).agg(F.collect_set("_value").alias("allowed"))
    return join_null_safe(df, hits, id_cols, "left")


def not_allowed(text_col: str, rules: Sequence[Rule] | None = None, allowed: str = "allowed") -> str:
    """Resolved findings of a text without the values that the ``allowed`` column lists."""
    found = spans.all_findings(text_col, chosen_rules(rules))
    return spans.resolve_overlaps(
        f"CASE WHEN {allowed} IS NULL THEN {found} ELSE"
        f" filter({found}, _f -> NOT array_contains({allowed}, _f.value)) END"
    )


def findings_excluding(
    df: DataFrame,
    id_cols: Sequence[str],
    allow_list: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    value_col: str = "value",
) -> DataFrame:
    """One row per finding whose value is not in an allow-list table."""
    rows = allowed_values(df.select(*id_cols, text_col), id_cols, allow_list, text_col, rules, value_col)
    return rows.select(*id_cols, F.inline(F.expr(not_allowed(text_col, rules))))


def detect_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secrets``: the names of the detectors that fire."""
    return df.withColumn("secrets", columns.detect_secrets(text_col))


def detect_places(df: DataFrame, gazetteer: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Find places from a gazetteer table of any size (column ``place``), of any number of words.

    Words end at white space; marks around a phrase do not count, those inside do,
    so ``St. Louis`` and ``Winston-Salem`` are found.  A phrase starts with a
    capital.  Each text gives up its distinct phrases of the lengths that the
    gazetteer has, which are joined with the table.  Spark picks the join from the
    real sizes; no side is forced to broadcast.
    """
    space, marks = spans.quote(r"\s+"), spans.quote(r"^\p{P}+|\p{P}+$")

    def trimmed(phrase: str) -> str:
        return f"regexp_replace({phrase}, {marks}, '')"

    places = gazetteer.select(F.expr(trimmed(f"array_join(split(trim(place), {space}), ' ')")).alias("place"))
    places = places.filter("place <> ''").distinct()
    # The different lengths: a few small numbers, however long the table is.
    lengths = sorted(row["n"] for row in places.select(F.size(F.split("place", " ")).alias("n")).distinct().collect())
    if not lengths:
        return df.select(*keep, F.lit("LOCATION").alias("entity_type"), F.lit("").alias("value")).limit(0)
    phrase = f"{trimmed("array_join(slice(_w, _i + 1, _n), ' ')")}"
    # A word opens a phrase if it starts with a capital once the marks before it are gone.
    openers = f"filter(sequence(0, size(_w) - 1), _i -> rlike(_w[_i], {spans.quote(r'^\p{P}*\p{Lu}')}))"
    fitting = f"filter(array({', '.join(map(str, lengths))}), _n -> _i + _n <= size(_w))"
    phrases = f"flatten(transform({openers}, _i -> transform({fitting}, _n -> {phrase})))"
    candidates = f"explode(array_distinct({spans.bind(f'split({text_col}, {space})', '_w', phrases)}))"
    seen = df.select(*keep, F.expr(candidates).alias("place"))
    return seen.join(places, "place", "inner").select(
        *keep, F.lit("LOCATION").alias("entity_type"), F.col("place").alias("value")
    )
