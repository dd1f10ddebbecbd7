"""Checks that split rows into good ones and a quarantine with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.catalog import BINARY_SNIFF_BYTES, MAX_FILE_BYTES, MAX_TEXT_CHARS, PROFILES
from hushframe.functions.columns import normalised_profile, truncated, was_truncated


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one."""
    return df.filter(reason.isNull()), df.filter(reason.isNotNull()).withColumn("reason", reason)


def require_text(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Null text goes to quarantine; the empty string is fine; another type is an error."""
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        raise TypeError(f"column {text_col!r} must be a string, got {df.schema[text_col].dataType.simpleString()}")
    return _split(df, F.when(F.col(text_col).isNull(), F.lit("missing_text")))


def require_profile(df: DataFrame, profile_col: str = "profile") -> tuple[DataFrame, DataFrame]:
    """Normalise a per-row profile; unknown names go to quarantine."""
    named = df.withColumn(profile_col, normalised_profile(profile_col))
    return _split(named, F.when(~F.col(profile_col).isin(*PROFILES), F.lit("unknown_profile")))


def truncate_text(df: DataFrame, text_col: str = "text", limit: int = MAX_TEXT_CHARS) -> DataFrame:
    """Opt-in length limit with a ``was_truncated`` flag; nothing else in the engine cuts text."""
    return df.withColumn("was_truncated", was_truncated(text_col, limit)).withColumn(
        text_col, truncated(text_col, limit)
    )


def max_file_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files above ``limit`` bytes go to quarantine.  The test is on ``length`` alone, so the
    file source skips reading the content of the files it drops."""
    reason = F.when(F.col("length") > limit, F.lit("file_too_large"))
    good = files.filter(F.col("length") <= limit)
    bad = files.filter(F.col("length") > limit).withColumn("reason", reason)
    return good, bad


def is_binary(content: str = "content", sniff: int = BINARY_SNIFF_BYTES) -> Column:
    """True when a NUL byte is among the first bytes."""
    return F.expr(f"position(X'00' IN substring({content}, 1, {sniff})) > 0")


def reject_binary(files: DataFrame, content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Binary files go to quarantine."""
    return _split(files, F.when(is_binary(content_col), F.lit("binary_file")))


def file_format(path: str = "path") -> Column:
    """``docx``, ``pdf``, ``xlsx``, ``xls`` or ``text``, by suffix."""
    name = F.lower(F.col(path))
    routed = F.when(name.endswith(".docx"), "docx")
    for suffix in ("pdf", "xlsx", "xls"):
        routed = routed.when(name.endswith(f".{suffix}"), suffix)
    return routed.otherwise("text")


def route_by_format(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add the ``format`` column that decides which reader a file goes to."""
    return files.withColumn("format", file_format(path_col))


def missing_path_report(requested: DataFrame, found: DataFrame, path_col: str = "path") -> DataFrame:
    """Requested paths that the listing does not contain."""
    plain = F.regexp_replace(F.col(path_col), r"^file:/+", "/")
    wanted = requested.withColumn("_plain", plain)
    listed = found.select(plain.alias("_plain"))
    return (
        wanted.join(listed, "_plain", "left_anti").drop("_plain").withColumn("reason", F.lit("missing_file"))
    )


def valid_text_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise unless every named column is a string column."""
    for name in columns:
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise TypeError(f"column {name!r} is not a string column")
