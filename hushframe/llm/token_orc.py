"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, fresh_folder, query, table
from hushframe.llm.tokens import public_path, worker_encoder

ROWS_AT_ONCE = 500


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    row_index_stride: int = 1_000,
    stripe_bytes: int = 16 << 20,
    false_positives: float = 0.01,
) -> None:
    """Write ``(id_col, row_id, n_tokens, tokens)`` in ascending ``id_col`` order over files and within each.

    ``row_id`` (block number in the high bits, place in the low 33) gives the order
    back; rows without an id come first, repeated rows stay side by side.  A null
    text is just the end id.  Each stripe has a row index every ``row_index_stride``
    rows and a Bloom filter of the ids, so a look-up by id skips files, stripes and
    row groups by metadata, and stripes are read in parallel.
    """
    ordered = (
        df.select(F.col(id_col), F.col(text_col).alias("_text"))
        .repartitionByRange(id_col)
        .sortWithinPartitions(id_col)
        .select(id_col, F.monotonically_increasing_id().alias("row_id"), "_text")
    )
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, word_ends=False, end_id=end_id)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                ids = [encoder.ids(text) for text in part.column(2).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=[id_col, "row_id", "n_tokens", "tokens"],
                )

    rows = ordered.mapInArrow(encode, f"`{id_col}` {id_type}, row_id long, n_tokens int, tokens array<int>")
    (
        rows.write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", str(false_positives))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "lz4")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_token_files`` wrote; filters on the id are pushed to the stripes."""
    return spark.read.orc(path)


def document_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` of rows read back: where each document's ids begin, how many, and their checksum.

    Starts are sums within a block plus the totals of the blocks before; only one
    row per block meets in one task.
    """
    id_type = tokens.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "row_id", "n_tokens", "ids_crc32"],
            )

    rows = cut_lineage(
        tokens.select(id_col, "row_id", "tokens")
        .mapInArrow(digest, f"`{id_col}` {id_type}, row_id long, n_tokens long, ids_crc32 long")
        .withColumn("_block", F.shiftright("row_id", 33))
    )
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("_block").agg(F.sum("n_tokens").alias("n"))
        .select("_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    )
    in_block = Window.partitionBy("_block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("_in_block", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0)))
    return sums.join(blocks, "_block").select(
        id_col, (F.col("_before") + F.col("_in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op6_token_orc")
def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = fresh_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return document_digests(read_token_files(spark, path))
