"""Re-identification: put originals back in place of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import columns, spans
from hushframe.operators.skew import ROWS_PER_SALT, heavy_keys, join_null_safe, salted_lookup


def reveal_rows(df: DataFrame, text_col: str = "masked_text", tokens_col: str = "tokens") -> DataFrame:
    """Restore rows that carry their own token array; adds ``revealed_text``.  Narrow."""
    restored = columns.reveal_from(text_col, tokens_col)
    return df.withColumn("_restored", restored).withColumn(
        "revealed_text", columns.dedupe_scheme("_restored")
    ).drop("_restored")


def reveal(
    df: DataFrame,
    vault: DataFrame,
    id_cols: Sequence[str],
    text_col: str = "text",
    session_col: str = "session_id",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Restore texts from a vault table; adds ``revealed_text`` and ``status``.

    ``status`` is ``unchanged`` (no tokens in the text), ``restored``, ``partial``
    (some tokens unknown, left as they are), ``unknown_tokens`` (none known) or
    ``empty_vault`` (the session has no vault entry at all), or ``conflicting_tokens``
    (the vault has two values for some token, which is left as it is).

    Only texts with tokens are shuffled.  Sessions with very many tokens are
    spread over several tasks.  ``df`` is read three times, so a caller whose
    texts are costly to make (masked on the way, say) writes or checkpoints them first.
    """
    pattern = spans.quote(spans.TOKEN_PATTERN)
    has_token = F.expr(f"coalesce(contains({text_col}, '[') AND rlike({text_col}, {pattern}), false)")
    session = F.col(session_col).cast("string").alias("session_id")
    # The empty token asks whether the session has a vault at all.
    tokens = f"array_union(array(''), regexp_extract_all({text_col}, {pattern}, 0))"
    wanted = df.filter(has_token).select(*id_cols, session, F.explode(F.expr(tokens)).alias("token"))
    entries = vault.select(F.col("session_id").cast("string").alias("session_id"), "token", "value")
    present = entries.select("session_id", F.lit("").alias("token"), F.lit("").alias("value")).distinct()
    entries = entries.unionByName(present)
    if list(id_cols) == [session_col]:
        placed = join_null_safe(wanted, entries, ["session_id", "token"], "left")
    else:
        sizes = wanted.groupBy("session_id").agg(F.count(F.lit(1)).alias("_rows"))
        heavy = heavy_keys(sizes, ["session_id"], "_rows", rows_per_salt)
        placed = salted_lookup(wanted, entries, ["session_id", "token"], heavy, ["session_id"], id_cols)
    is_token = F.col("token") != ""
    found = is_token & F.col("value").isNotNull()
    tables = placed.groupBy(*id_cols).agg(
        F.collect_set(F.when(found, F.struct("token", "value"))).alias("_all"),
        F.count_distinct(F.when(is_token, F.col("token"))).alias("_wanted"),
        F.bool_or(F.col("value").isNotNull()).alias("_has_vault"),
    )
    # A token with two values is not guessed at: it stays, and the status says so.
    alone = "filter(_all, _p -> size(filter(_all, _q -> _q.token = _p.token)) = 1)"
    tables = tables.withColumn("_pairs", F.expr(alone))
    restored = F.expr(columns.restored(text_col, "map_from_entries(_pairs)"))
    status = (
        F.when(F.size("_pairs") < F.size("_all"), "conflicting_tokens")
        .when(F.size("_pairs") == F.col("_wanted"), "restored")
        .when(F.size("_pairs") > 0, "partial")
        .when(F.col("_has_vault"), "unknown_tokens")
        .otherwise("empty_vault")
    )
    plain = df.filter(~has_token).select(
        *df.columns,
        columns.dedupe_scheme(text_col).alias("revealed_text"),
        F.lit("unchanged").alias("status"),
    )
    touched = join_null_safe(df.filter(has_token), tables, id_cols, "inner").withColumn("_restored", restored)
    return plain.unionByName(
        touched.select(
            *df.columns, columns.dedupe_scheme("_restored").alias("revealed_text"), status.alias("status")
        )
    )
