"""Shared helpers of the training-data operators."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import llm
from hushframe.operators.skew import cut_lineage, shared_folder, shuffles_dropped

# Executors get the code of this subpackage with each task; they need no copy of it.
cloudpickle.register_pickle_by_value(llm)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its check."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# On UTF-8 bytes: all ASCII characters but digits and lower-case letters become spaces.
_WORD_BYTES = bytes(b if b >= 128 or chr(b) in string.digits + string.ascii_lowercase else 32 for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lower-cased, as UTF-8; a null text has none."""
    return (text or "").encode().lower().translate(_WORD_BYTES).split()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other characters take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def powers_of(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two lists whose products, at ``i >> 12`` of the first and ``i & 4095`` of the second, are ``factor ** i`` for i < ``n``."""
    low = np.full(4096, factor, np.uint64)
    high = np.full((n >> 12) + 1, pow(factor, 4096, 1 << 64), np.uint64)
    low[0] = high[0] = 1
    return np.multiply.accumulate(high), np.multiply.accumulate(low)


def text_key(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` and ``_row``, the id with a key of the text (null without an id): rows that share an id but not the text differ."""
    key = F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text"))
    return df.withColumn("_row", F.when(F.col(id_col).isNotNull(), key))


def without_rows(df: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the rows whose key stands in the column ``_row`` of ``dropped``."""
    gone = dropped.select(F.col("_row.id").alias("_gone_id"), F.col("_row.text").alias("_gone_text")).distinct()
    same = (F.col(f"`{id_col}`") == F.col("_gone_id")) & (text_key(F.col(f"`{text_col}`")) == F.col("_gone_text"))
    return df.join(gone, same, "left_anti")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there, compressed and with its size known."""
    path = fresh_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["ORACLES", "QUERIES", "ascii_lower", "cut_lineage", "fresh_folder", "powers_of", "query", "stored", "table", "text_key", "with_row_key", "without_rows", "word_bytes"]
