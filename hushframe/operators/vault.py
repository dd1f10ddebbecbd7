"""The vault: which token stands for which value.

A vault is a DataFrame ``(session_id, token, entity_type, value)``.  It holds the
raw data, so it stays a plain DataFrame or temp view unless the caller asks for
a durable one, and then values may be encrypted with the caller's key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.columns import detect_secrets, has_secret
from hushframe.operators.skew import join_null_safe

VAULT_COLUMNS = ("session_id", "token", "entity_type", "value")
BUCKETS = 64


def session_key(session_cols: Sequence[str]) -> Column:
    """One string for the session columns; a single column is just cast."""
    if not session_cols:
        return F.lit("corpus")
    if len(session_cols) == 1:
        return F.col(session_cols[0]).cast("string")
    return F.to_json(F.struct(*session_cols))


def token_map(masked: DataFrame, session_cols: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """Vault of rows masked one by one.

    Each row's token array is already distinct, so when ``session_cols`` identify
    a row this is a narrow ``explode``.
    """
    # The outer form: the plain one makes Spark infer filters that run detection again.
    entries = masked.select(session_key(session_cols).alias("session_id"), F.inline_outer(tokens_col))
    return entries.filter("token IS NOT NULL")


def as_vault(numbers: DataFrame, session_cols: Sequence[str] = ()) -> DataFrame:
    """Vault of session or corpus numbers."""
    return numbers.select(session_key(session_cols).alias("session_id"), "token", "entity_type", "value")


class VaultConflict(ValueError):
    """A token that would stand for two values of one session."""


def refuse_conflicts(pairs: DataFrame) -> None:
    """An error if some (session, token) has more than one value; reveal could not tell which one to put back."""
    twice = (
        pairs.filter(F.col("value").isNotNull())
        .groupBy("session_id", "token").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .filter("low <> high").select("session_id", "token").head(3)
    )
    if twice:
        raise VaultConflict(f"tokens with two values, such as {[tuple(row) for row in twice]}; number against the vault")


def new_pairs(pairs: DataFrame, vault: DataFrame) -> DataFrame:
    """Pairs whose token the vault does not hold yet; a token held with another value is refused."""
    keys = ["session_id", "token"]
    held = join_null_safe(vault, pairs.select(*keys).distinct(), keys, "left_semi").select(*keys, "value")
    refuse_conflicts(pairs.select(*keys, "value").unionByName(held))
    one = pairs.groupBy(*keys).agg(F.max("entity_type").alias("entity_type"), F.max("value").alias("value"))
    return join_null_safe(one, vault.select(*keys), keys, "left_anti").select(*VAULT_COLUMNS)


def write_vault(pairs: DataFrame, path: str, key: bytes | None = None, buckets: int = BUCKETS) -> None:
    """Append new pairs to a durable vault, encrypted when a key is given.

    Partitioned by a hash bucket of the session, which prunes session look-ups
    without making one folder per session; ``buckets`` must stay the same for a
    vault.  Only buckets of the sessions at hand are read.
    """
    spark = pairs.sparkSession
    if vault_exists(spark, path):
        here = [r["b"] for r in pairs.select(session_bucket("session_id", buckets).alias("b")).distinct().collect()]
        earlier = _decrypted(spark.read.parquet(path).filter(F.col("bucket").isin(here)), key)
        fresh = new_pairs(pairs, earlier)
    else:
        fresh = new_pairs(pairs, pairs.limit(0))
    value = F.col("value")
    if key is not None:
        value = F.base64(F.aes_encrypt(value, F.lit(key)))
    (
        fresh.withColumn("value", value)
        .withColumn("bucket", session_bucket("session_id", buckets))
        # Few files per bucket; an oversized bucket is split again.
        .hint("rebalance", "bucket")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def session_bucket(session_col: str, buckets: int = BUCKETS) -> Column:
    """The vault partition of a session."""
    return F.pmod(F.xxhash64(session_col), F.lit(buckets)).cast("int")


def vault_exists(spark: SparkSession, path: str) -> bool:
    """True once the vault folder holds data."""
    try:
        spark.read.parquet(path).schema
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True


def _decrypted(stored: DataFrame, key: bytes | None) -> DataFrame:
    value = F.col("value")
    if key is not None:
        value = F.aes_decrypt(F.unbase64(value), F.lit(key)).cast("string")
    return stored.select("session_id", "token", "entity_type", value.alias("value"))


def read_vault(
    spark: SparkSession, path: str, key: bytes | None = None, sessions: Sequence[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Read a durable vault, decrypting values when a key is given.

    With ``sessions`` only those are read, and only the folders of their buckets.
    """
    stored = spark.read.parquet(path)
    if sessions is not None:
        wanted = [F.lit(name) for name in sessions]
        stored = stored.filter(F.col("session_id").isin(*sessions)) if wanted else stored.limit(0)
        if wanted:
            here = spark.range(1).select(F.array(*[session_bucket(name, buckets) for name in wanted])).first()[0]
            stored = stored.filter(F.col("bucket").isin(sorted(set(here))))
    return _decrypted(stored, key)


def rescan_vault(vault: DataFrame) -> DataFrame:
    """Flag vault values that are secrets, with the detectors that fire."""
    return vault.withColumn("secrets", detect_secrets("value")).withColumn("is_secret", has_secret("value"))


def without_secrets(vault: DataFrame) -> DataFrame:
    """The vault without values that are secrets."""
    return vault.filter(~has_secret("value"))
