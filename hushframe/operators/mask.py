"""Masking operators: per row, per record, per session, per corpus, and for very long texts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import columns, spans
from hushframe.functions.catalog import Rule, chosen_rules
from hushframe.operators import detect
from hushframe.operators.guards import valid_text_columns
from hushframe.operators.vault import session_key
from hushframe.operators.skew import (
    ROWS_PER_SALT,
    cut_lineage,
    heavy_keys,
    join_null_safe,
    number_within,
    salted_lookup,
)
# Room one edit (two offsets and a token) takes in a broadcast table, generously.
EDIT_BYTES = 128
# Edit tables up to this size are broadcast.
BROADCAST_BYTES = 64 << 20


def sanitize(
    df: DataFrame,
    text_col: str = "text",
    profile: str | None = "general",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    extra: str | None = None,
) -> DataFrame:
    """Mask every row by itself: adds ``masked_text`` and ``tokens``.

    One narrow stage: no shuffle, no Python worker.  Works on streams too.
    ``extra`` names a column of findings from a dictionary or a detector of the
    user's, which join those of the rules before exclusions and overlaps.
    """
    valid_text_columns(df, [text_col])
    protected = columns.protect(text_col, chosen_rules(rules, profile), exclusions, extra)
    return df.withColumn("_protected", protected).select(*df.columns, "_protected.*")


def sanitize_excluding(
    df: DataFrame,
    id_cols: Sequence[str],
    allow_list: DataFrame,
    text_col: str = "text",
    profile: str | None = "general",
    rules: Sequence[Rule] | None = None,
    value_col: str = "value",
) -> DataFrame:
    """``sanitize`` with the exclusions in a table: the same masked texts as with the same values in a list."""
    valid_text_columns(df, [text_col])
    rules = chosen_rules(rules, profile)
    rows = detect.allowed_values(df, id_cols, allow_list, text_col, rules, value_col)
    protected = F.expr(spans.protected(text_col, detect.not_allowed(text_col, rules)))
    return rows.withColumn("_protected", protected).select(*df.columns, "_protected.*")


def sanitize_by_profile(df: DataFrame, text_col: str = "text", profile_col: str = "profile") -> DataFrame:
    """Like ``sanitize`` with the profile named per row (see ``guards.require_profile``)."""
    found = columns.findings_by_profile(text_col, profile_col)
    protected = F.expr(spans.protected(text_col, found))
    return df.withColumn("_protected", protected).select(*df.columns, "_protected.*")


def redact(
    df: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    name: str = "redacted_text",
) -> DataFrame:
    """One-way masking with bare labels."""
    return df.withColumn(name, columns.redact(text_col, rules, exclusions))


def mask_columns(
    df: DataFrame,
    text_cols: Sequence[str],
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
) -> DataFrame:
    """Mask several string columns of each record; one record shares one numbering.

    Numbers follow column order.  Adds ``tokens``.
    """
    valid_text_columns(df, text_cols)
    rules = chosen_rules(rules)
    found = [f"_found_{i}" for i in range(len(text_cols))]
    staged = df.select(
        "*",
        *[columns.detect(c, rules, exclusions).alias(f) for c, f in zip(text_cols, found)],
    )
    reserved = "concat(" + ", ".join(
        f"coalesce({spans.reserved_tokens(c)}, cast(array() AS array<string>))" for c in text_cols
    ) + ")"
    # The columns count as one text: each starts one character after the end of the one before.
    bases = ["0", *(" + ".join(f"coalesce(length({c}), 0) + 1" for c in text_cols[:i]) for i in range(1, len(text_cols)))]
    shifted = (
        "named_struct('start', _f.start + _base, 'end', _f.end + _base, 'priority', _f.priority,"
        " 'entity_type', _f.entity_type, 'rule_id', _f.rule_id, 'value', _f.value)"
    )
    moved = ", ".join(
        spans.bind(base, "_base", f"transform({f}, _f -> {shifted})") for f, base in zip(found, bases)
    )
    staged = staged.withColumn("_numbered", F.expr(spans.numbered_values(f"concat({moved})", reserved)))
    masked = {
        c: F.expr(spans.rewrite(c, spans.edits_within("_numbered", base, f"coalesce(length({c}), 0)")))
        for c, base in zip(text_cols, bases)
    }
    tokens = F.expr(
        "transform(_numbered, _n -> named_struct('token', _n.token, 'entity_type', _n.entity_type, 'value', _n.value))"
    )
    return staged.select(*[masked.get(c, F.col(c)).alias(c) for c in df.columns], tokens.alias("tokens"))


def value_mentions(
    df: DataFrame,
    id_cols: Sequence[str],
    session_cols: Sequence[str],
    order_cols: Sequence[str],
    found: str,
    text_col: str,
) -> DataFrame:
    """One row per row and distinct value (never one per hit), plus reserved placeholders.

    ``found`` is a findings expression.  ``place`` orders values inside a row and
    ``spans`` says where they stand.  The text is not carried along.
    """
    kept = [*dict.fromkeys([*id_cols, *session_cols, *order_cols])]
    digits = "regexp_extract(_t, '_([0-9]+)\\\\]$', 1)"
    taken = (
        f"transform(array_distinct({spans.reserved_tokens(text_col)}), _t -> named_struct("
        "'entity_type', regexp_extract(_t, '^\\\\[(.+)_[0-9]+\\\\]$', 1), 'value', _t, 'place', 0,"
        f" 'taken', {spans.reserved_number(digits)},"
        " 'spans', cast(array() AS array<struct<start:int,end:int>>)))"
    )
    return df.select(*kept, F.expr(f"inline(concat({spans.value_spans(found)}, {taken}))"))


def number_values(
    mentions: DataFrame, session_cols: Sequence[str], order_cols: Sequence[str]
) -> DataFrame:
    """Give each distinct value of a session (or, without sessions, of the corpus) its token.

    Columns: session columns, entity_type, value, mentions, token.  Only distinct
    values are shuffled, after a map-side combine, so a value or session that
    fills a third of the table costs no more than any other.
    """
    groups = [*session_cols, "entity_type"]
    first = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], "place")
    firsts = (
        mentions.filter(F.col("taken").isNull())
        .groupBy(*groups, "value")
        .agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("mentions"))
    )
    highest = (
        mentions.filter(F.col("taken").isNotNull()).groupBy(*groups).agg(F.max("taken").alias("_start"))
    )
    numbered = number_within(firsts, groups, ["_first", "value"], "_n", highest)
    standing = mentions.filter(F.col("taken").isNotNull()).select(*groups, F.col("value").alias("token"))
    return step_over(numbered, groups, "_n", standing).select(
        *session_cols,
        "entity_type",
        "value",
        "mentions",
        F.expr("concat('[', entity_type, '_', _n, ']')").alias("token"),
    )


# Numbers below this count when the next one is looked for; what follows them is stepped over one by one.
EDGE = 10**18
FAR_TOKEN = r"_([1-9][0-9]{18})\]$"


def step_over(numbered: DataFrame, groups: Sequence[str], name: str, standing: DataFrame) -> DataFrame:
    """``numbered`` without the numbers from ``EDGE`` on that ``standing`` tokens (group columns, token) already carry.

    Numbers get there only where a text holds a placeholder with one of 18 digits.
    A number so far on moves up by the standing ones at or below it.
    """
    digits = F.regexp_extract("token", FAR_TOKEN, 1)
    carried = standing.select(*groups, digits.try_cast("bigint").alias("_r")).filter("_r IS NOT NULL").distinct()
    if carried.isEmpty():
        return numbered
    in_order = Window.partitionBy(*groups).orderBy("_r")
    # How many free numbers come before each standing one.
    free = carried.select(*groups, (F.col("_r") - EDGE - F.row_number().over(in_order) + 1).alias("_k"), F.lit(0).alias("_kind"))
    far = numbered.filter(F.col(name) >= EDGE).withColumns({"_k": F.col(name) - EDGE, "_kind": F.lit(1)})
    up_to = Window.partitionBy(*groups).orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = (
        far.unionByName(free, allowMissingColumns=True)
        .withColumn(name, F.col(name) + F.sum(1 - F.col("_kind")).over(up_to))
        .filter("_kind = 1").drop("_k", "_kind")
    )
    return numbered.filter(F.col(name) < EDGE).unionByName(moved)


TOKEN_NUMBER = r"_(\d{1,18})\]$"


def number_against(
    mentions: DataFrame, session_cols: Sequence[str], order_cols: Sequence[str], known: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Number what ``known`` (session_id, token, entity_type, value) does not hold yet.

    A value that is known in its session keeps its token; new ones go on from the
    highest number of their session and label, in ``known`` or in the texts.  Known
    rows with a null value only keep their number taken.  Returns the tokens of
    all values that the texts mention (as ``number_values`` does), and the new
    vault rows (session_id, token, entity_type, value).  Values are combined per
    session before any join, so a frequent one is a single row there.
    """
    keys = ["_session", "entity_type"]
    named = mentions.withColumn("_session", session_key(session_cols))
    first = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], "place")
    firsts = (
        named.filter(F.col("taken").isNull())
        .groupBy(*session_cols, *keys, "value")
        .agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("mentions"))
    )
    known = known.withColumnRenamed("session_id", "_session")
    held = known.filter(F.col("value").isNotNull()).select(*keys, "value", "token")
    old = join_null_safe(firsts, held, [*keys, "value"], "inner")
    unseen = join_null_safe(firsts, held.select(*keys, "value"), [*keys, "value"], "left_anti")
    reserved = (
        named.filter(F.col("taken").isNotNull()).groupBy(*keys).agg(F.max(F.col("taken").cast("long")).alias("n"))
    )
    numbers = F.expr(f"try_cast(regexp_extract(token, {spans.quote(TOKEN_NUMBER)}, 1) AS bigint)")
    highest = (
        known.select(*keys, F.coalesce(numbers, F.lit(0)).alias("n")).unionByName(reserved)
        .groupBy(*keys).agg(F.max("n").alias("_start"))
    )
    token = F.expr("concat('[', entity_type, '_', n, ']')")
    standing = named.filter(F.col("taken").isNotNull()).select(*keys, F.col("value").alias("token"))
    numbered = number_within(unseen, keys, ["_first", "value"], "n", highest)
    numbered = step_over(numbered, keys, "n", standing.unionByName(known.select(*keys, "token")))
    fresh = cut_lineage(numbered.withColumn("token", token))
    columns_out = [*session_cols, "entity_type", "value", "mentions", "token"]
    entries = fresh.select(F.col("_session").alias("session_id"), "token", "entity_type", "value")
    # A placeholder that stood in a text is kept without a value, so its number stays taken.
    taken = reserved.filter("n > 0").select(
        F.col("_session").alias("session_id"), token.alias("token"), "entity_type", F.lit(None).cast("string").alias("value")
    )
    # So are the ones too long for that, one by one.
    far = standing.filter(F.col("token").rlike(FAR_TOKEN)).distinct().select(
        F.col("_session").alias("session_id"), "token", "entity_type", F.lit(None).cast("string").alias("value")
    )
    return fresh.select(*columns_out).unionByName(old.select(*columns_out)), entries.unionByName(taken).unionByName(far)


def apply_numbers(
    df: DataFrame,
    mentions: DataFrame,
    numbers: DataFrame,
    id_cols: Sequence[str],
    session_cols: Sequence[str],
    text_col: str,
    rules: Sequence[Rule],
    name: str = "masked_text",
    rows_per_salt: int = ROWS_PER_SALT,
    broadcast_bytes: int = BROADCAST_BYTES,
    extra: str | None = None,
) -> DataFrame:
    """Write the tokens into the texts.

    Tokens reach each row through a salted join on (session, type, value), which
    gives a table of edits per row.  Its size is measured: a small one is
    broadcast and the texts stay where they are; else the texts that some rule
    matches are shuffled to it, and all others pass straight through.
    """
    keys = [*session_cols, "entity_type", "value"]
    heavy = heavy_keys(numbers, keys, "mentions", rows_per_salt)
    kept = [*dict.fromkeys([*id_cols, *session_cols])]
    placed = salted_lookup(
        mentions.filter("taken IS NULL").select(*kept, "entity_type", "value", "spans"),
        numbers.select(*keys, "token"),
        keys,
        heavy,
        keys,
        id_cols,
    )
    token_spans = F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.col("token").alias("token")))
    edits = cut_lineage(
        placed.groupBy(*id_cols).agg(F.sort_array(F.flatten(F.collect_list(token_spans))).alias("_edits"))
    )
    edited = F.when(F.col("_edits").isNull(), F.col(text_col)).otherwise(
        F.expr(spans.rewrite(text_col, "_edits"))
    )
    size = edits.agg(F.sum(F.size("_edits") * EDIT_BYTES + EDIT_BYTES).alias("bytes")).first()["bytes"] or 0
    if size <= broadcast_bytes:
        joined = join_null_safe(df, F.broadcast(edits), id_cols, "left")
        return joined.withColumn(name, edited).drop("_edits")
    matched = F.expr(spans.any_match(text_col, rules))
    if extra is not None:
        matched = matched | F.coalesce(F.size(extra) > 0, F.lit(False))
    clean = df.filter(~matched).withColumn(name, F.col(text_col))
    touched = join_null_safe(df.filter(matched), edits, id_cols, "left").withColumn(name, edited).drop("_edits")
    return clean.unionByName(touched)


def sanitize_scope(
    df: DataFrame,
    id_cols: Sequence[str],
    order_cols: Sequence[str],
    session_cols: Sequence[str] = (),
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    rows_per_salt: int = ROWS_PER_SALT,
    broadcast_bytes: int = BROADCAST_BYTES,
    vault: DataFrame | None = None,
    extra: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mask with one numbering per session, or one for the whole table without ``session_cols``.

    ``id_cols`` must identify a row; ``order_cols`` decide which value comes
    first.  Returns the masked rows (``masked_text``) and the numbered values
    (session columns, token, entity_type, value).

    With a ``vault`` of earlier runs the numbering goes on from it: known values
    keep their tokens and no token is given out twice.  The second result is then
    the vault rows to add (session_id, token, entity_type, value).

    Detection runs once, into a small table of mentions (checkpointed).  The texts
    are then read again to be rewritten, with no more than a match test per text.
    ``extra`` names a column of findings made elsewhere, as in ``sanitize``.
    """
    valid_text_columns(df, [text_col])
    rules = chosen_rules(rules)
    found = spans.resolved_findings(text_col, rules, exclusions, extra)
    mentions = cut_lineage(value_mentions(df, id_cols, session_cols, order_cols, found, text_col))
    added = None
    if vault is None:
        numbers = cut_lineage(number_values(mentions, session_cols, order_cols))
    else:
        numbers, added = number_against(mentions, session_cols, order_cols, vault)
    masked = apply_numbers(
        df, mentions, numbers, id_cols, session_cols, text_col, rules,
        rows_per_salt=rows_per_salt, broadcast_bytes=broadcast_bytes, extra=extra,
    )
    return masked, numbers.select(*session_cols, "token", "entity_type", "value") if added is None else added


def sanitize_long(
    df: DataFrame,
    id_cols: Sequence[str],
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    lines_per_part: int = 500,
) -> tuple[DataFrame, DataFrame]:
    """``sanitize`` for texts of many megabytes, with the same result.

    Texts are cut at line ends into parts that are masked in parallel with one
    numbering per text, then put together again, so that one very long text is
    not the work of one task.  Null texts stay null.  Needs rules that never match
    across lines, as all built-in ones.
    """
    rules = chosen_rules(rules)
    crossing = [r.rule_id for r in rules if not r.line_local]
    if crossing:
        raise ValueError(f"rules that may match across lines cannot be used here: {crossing}")
    cut = (
        f"transform(sequence(0, (size(_l) - 1) div {lines_per_part}), _i ->"
        f" array_join(slice(_l, _i * {lines_per_part} + 1, {lines_per_part}), '\\n'))"
    )
    parts = df.select(
        *id_cols,
        F.posexplode_outer(F.expr(spans.bind(f"split({text_col}, '\\n', -1)", "_l", cut))).alias("_part", text_col),
    )
    masked, numbers = sanitize_scope(
        parts, [*id_cols, "_part"], ["_part"], id_cols, text_col, rules, exclusions
    )
    parts_in_order = F.sort_array(F.collect_list(F.struct("_part", "masked_text")))
    # A null text has one part, which is null.
    joined = masked.groupBy(*id_cols).agg(
        F.when(
            F.max("_part").isNotNull(), F.array_join(F.transform(parts_in_order, lambda p: p["masked_text"]), "\n")
        ).alias("masked_text")
    )
    rest = df.drop(text_col)
    if list(rest.columns) != list(id_cols):
        joined = join_null_safe(rest, joined, id_cols, "inner")
    return joined, numbers
