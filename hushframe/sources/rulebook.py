"""Rule files: reading, checking and writing the template.

A rule file is one JSON object:
``{"customRules": [{"pattern" | "regex": ..., "label" | "category": ...}], "exclusions": [...]}``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.ambiguity import bounded_groups, too_ambiguous
from hushframe.functions.catalog import TEMPLATE_EXCLUSIONS, TEMPLATE_RULE, Rule, valid_label

RULE_FILE_SCHEMA = T.StructType([
    T.StructField("customRules", T.ArrayType(T.StructType([
        T.StructField("pattern", T.StringType()),
        T.StructField("regex", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("category", T.StringType()),
    ]))),
    T.StructField("exclusions", T.ArrayType(T.StringType())),
])
RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("profile", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
])
# Texts on which a usable rule must not match the empty string.
_EMPTY_PROBES = ("", "a", "aA0 _-.", "one two\n3,4")
# Parts of an expression that take up no text.
_ZERO_WIDTH = re.compile(r"\(\?<?[=!](?:[^()\\]|\\.)*\)|\\[bBAzZG]|\^|\$")
# Custom rules come before all built-in ones, however many there are.
_FIRST_PRIORITY = -1_000_000_000
# What cannot match a line end: plain characters, escapes of one character class or mark, classes that list what they take.
_LINE_LOCAL = re.compile(
    r"(?:\(\?i\)|\(\?:|\\[dwbB]|\\[^A-Za-z0-9\n\r]|\[(?!\^)(?:\\[dw]|\\[^A-Za-z0-9\n\r]|[^\\\]\[\n\r&])+\]|(?!\(\?)[^\\\[\]^$\n\r])*"
)


def normalise_rules(raw: DataFrame) -> DataFrame:
    """``pattern`` else ``regex``; upper-case ``label`` else ``category`` else ``CUSTOM``.

    Empty strings count as absent; rules without a pattern are dropped.
    """
    absent = F.lit("")
    pattern = F.coalesce(F.nullif("pattern", absent), F.nullif("regex", absent))
    label = F.coalesce(F.nullif("label", absent), F.nullif("category", absent), F.lit("CUSTOM"))
    others = [c for c in raw.columns if c not in ("pattern", "regex", "label", "category")]
    named = raw.select(*others, pattern.alias("pattern"), F.upper(label).alias("label"))
    return named.filter(F.length("pattern") > 0)


def read_rule_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Normalised rules (in file order) and exclusions of a rule file; a broken file has none of either."""
    config = spark.read.schema(RULE_FILE_SCHEMA).option("multiLine", True).json(path)
    raw = config.select(F.posexplode("customRules").alias("position", "_rule")).select("position", "_rule.*")
    return normalise_rules(raw), config.select(F.explode("exclusions").alias("value")).distinct()


def rejection(spark: SparkSession, pattern: str) -> str | None:
    """Why a custom pattern cannot be used, or None."""
    ambiguous = too_ambiguous(pattern)
    if ambiguous:
        return "ambiguous_repeat"
    if bounded_groups(pattern) is None:
        return "deep_repeat"
    try:
        if _matches_empty(spark, pattern):
            return "matches_empty"
    except PySparkException:
        return "invalid_regex"
    if ambiguous is None:
        # Java can read it, but nothing is known about the time it takes.
        return "unreadable_regex"
    try:
        return "matches_empty" if _matches_empty(spark, _ZERO_WIDTH.sub("", pattern)) else None
    except PySparkException:
        return None  # what is left without the zero-width parts need not be an expression


def _matches_empty(spark: SparkSession, pattern: str) -> bool:
    probes = F.array(*[F.lit(p) for p in _EMPTY_PROBES])
    empties = F.exists(
        probes, lambda p: F.array_contains(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)), F.lit(""))
    )
    return spark.range(1).select(empties.alias("e")).first()["e"]


def check_rules(
    spark: SparkSession, rules: Iterable[Mapping[str, str]]
) -> tuple[list[Rule], list[dict[str, str]]]:
    """Turn ``{"pattern", "label"}`` entries into rules, in order; unusable ones come back with a reason.

    A bad rule never fails the job: what could take too long is rejected, and endless
    repeats of groups are limited (see ``ambiguity``).  Rule lists are configuration, so they live on the driver.
    """
    accepted: list[Rule] = []
    rejected: list[dict[str, str]] = []
    for i, entry in enumerate(rules):
        pattern = entry.get("pattern") or entry.get("regex") or ""
        label = (entry.get("label") or entry.get("category") or "CUSTOM").upper()
        if not pattern:
            continue
        reason = rejection(spark, pattern) if valid_label(label) else "invalid_label"
        if reason:
            rejected.append({"pattern": pattern, "label": label, "reason": reason})
            continue
        local = _LINE_LOCAL.fullmatch(pattern) is not None
        accepted.append(Rule(f"custom_{i}", label, bounded_groups(pattern) or pattern, _FIRST_PRIORITY + i, profile="custom", line_local=local))
    return accepted, rejected


def load_rules(spark: SparkSession, path: str) -> tuple[list[Rule], list[dict[str, str]], list[str]]:
    """Accepted rules, rejected rules and exclusions of a rule file."""
    rules, exclusions = read_rule_file(spark, path)
    entries = [r.asDict() for r in rules.orderBy("position").select("pattern", "label").toLocalIterator()]
    accepted, rejected = check_rules(spark, entries)
    return accepted, rejected, [r["value"] for r in exclusions.orderBy("value").toLocalIterator()]


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table, for joins and inspection."""
    rows = [(r.rule_id, r.entity_type, r.pattern, r.priority, r.profile, r.enabled) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_table(spark: SparkSession, table: DataFrame) -> tuple[list[Rule], list[dict[str, str]]]:
    """Custom rules given as a DataFrame with ``pattern`` and ``label``."""
    entries = [r.asDict() for r in table.select("pattern", "label").toLocalIterator()]
    return check_rules(spark, entries)


def write_default_rules(spark: SparkSession, path: str) -> bool:
    """Write the template once.  False, and nothing changed, when ``path`` already exists."""
    try:
        spark.read.text(path).schema
        return False
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    rule = (TEMPLATE_RULE["pattern"], None, TEMPLATE_RULE["label"], None)
    template = spark.createDataFrame([([rule], list(TEMPLATE_EXCLUSIONS))], RULE_FILE_SCHEMA)
    template.coalesce(1).write.mode("ignore").json(path)
    return True
