"""Exact duplicates by skew-safe combining: in each task, then per salt, then over the salts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import ascii_lower, cut_lineage, query, table


def sha256_digest(text: Column) -> Column:
    """The 32 bytes that group equal texts; content is compared as well."""
    return F.unhex(F.sha2(text, 256))


def text_groups(rows: DataFrame, salts: int) -> DataFrame:
    """``(_digest, _text, keep_id, group_size)`` of rows ``(_id, _digest, _text)``.

    The full text is part of the key at every stage.  Rows of one task carry one
    salt, so the map side of the first aggregation leaves one row per text and
    task; the salted merge leaves at most ``salts`` rows per text, and the last
    stage combines these.  No stage sees more than that of a hot text.
    """
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    per_salt = salted.groupBy("_salt", "_digest", "_text").agg(
        F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return per_salt.groupBy("_digest", "_text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256_digest,
    salts: int = 16,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after ``normalise``; a null text is
    an empty one.  Of equal texts the largest id stays.  A row without an id
    stays only if no equal text has one; rows repeated with the same id cannot
    be told apart, so all of them carry the mark of that id.  An empty table
    gives an empty result.  Other columns of ``df``, whatever their names, are
    not touched.

    Ids go back to their group by digest, which is sure where one text has that
    digest.  Digests shared by different texts are joined by content instead.
    """
    rows = df.select(
        F.col(id_col).alias("_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))
    groups = text_groups(rows, salts)
    by_digest = cut_lineage(
        groups.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    ids = rows.select("_id", "_digest", F.sha2("_text", 256).alias("text_sha256"))
    found = ids.join(by_digest.filter(F.col("_texts") == 1), "_digest")
    shared = by_digest.filter(F.col("_texts") > 1).select("_digest")
    columns = ["_id", "keep_id", "group_size", "text_sha256"]
    result = found.select(*columns)
    if not shared.isEmpty():
        contested = rows.join(shared, "_digest", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        result = result.unionByName(contested.join(groups, ["_digest", "_text"]).select(*columns))
    return result.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


OP9_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), grouped AS (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM norm
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""


@query("op9_exact_dedup", OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"))
