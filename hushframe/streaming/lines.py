"""Line streams: stateless masking, session numbering across batches, secret alerts, reveal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushframe.functions import columns, spans
from hushframe.functions.catalog import Rule, chosen_rules
from hushframe.operators import mask as mask_ops
from hushframe.operators.reveal import reveal
from hushframe.operators.skew import cut_lineage, join_null_safe
from hushframe.operators.vault import session_bucket, session_key, vault_exists

_VAULT_SCHEMA = "session_id string, token string, entity_type string, value string, bucket int, batch_id bigint"


def read_line_stream(spark: SparkSession, path: str, stream: str = "stdout", files_per_batch: int = 1_000) -> DataFrame:
    """Lines of text files as a stream ``(value, stream)``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.withColumn("stream", F.lit(stream))


def both_streams(stdout: DataFrame, stderr: DataFrame) -> DataFrame:
    """Two line streams as one; the ``stream`` column tells them apart."""
    return stdout.unionByName(stderr)


def mask_stream(lines: DataFrame, text_col: str = "value", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Mask each line by itself; numbers restart on every line.  No state."""
    return lines.withColumn("masked_text", columns.mask(text_col, rules))


def secret_alerts(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Lines that hold a secret, with the detectors that fired; the text itself is left out."""
    others = [c for c in lines.columns if c != text_col]
    return lines.filter(columns.has_secret(text_col)).select(
        *others, columns.detect_secrets(text_col).alias("secrets")
    )


def write_append(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Append a stream to files."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def mask_session_batch(
    batch: DataFrame,
    batch_id: int,
    out_path: str,
    vault_path: str,
    id_cols: Sequence[str],
    session_col: str,
    order_cols: Sequence[str],
    text_col: str,
    rules: Sequence[Rule] | None,
) -> None:
    """Mask one micro-batch against the vault of all earlier ones.

    A value seen before keeps its token; new values go on from the highest
    number of their session and label.  Output and new vault rows are written
    under the batch number and overwrite it, so a replayed batch changes nothing.
    Numbering is spread by (session, label, order), so one busy session is never
    the work of a single task.
    """
    spark = batch.sparkSession
    keys = ["_session", "entity_type"]
    rules = chosen_rules(rules)
    found = spans.resolved_findings(text_col, rules)
    mentions = cut_lineage(
        mask_ops.value_mentions(batch, id_cols, [session_col], order_cols, found, text_col)
    )
    if vault_exists(spark, vault_path):
        earlier = spark.read.schema(_VAULT_SCHEMA).parquet(vault_path).filter(F.col("batch_id") < batch_id)
    else:
        earlier = spark.createDataFrame([], _VAULT_SCHEMA)
    # Only the vault buckets of sessions in this batch are read: at most as many numbers as there are buckets.
    sessions = mentions.select(session_key([session_col]).alias("session_id")).distinct()
    buckets = [row["b"] for row in sessions.select(session_bucket("session_id").alias("b")).distinct().collect()]
    earlier = join_null_safe(earlier.filter(F.col("bucket").isin(buckets)), sessions, ["session_id"], "left_semi")
    numbers, added = mask_ops.number_against(
        mentions, [session_col], order_cols, earlier.select("session_id", "token", "entity_type", "value")
    )
    masked = mask_ops.apply_numbers(batch, mentions, numbers, id_cols, [session_col], text_col, rules)
    (
        added.withColumn("bucket", session_bucket("session_id"))
        .hint("rebalance", "bucket")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{vault_path}/batch_id={batch_id}")
    )
    masked.drop(text_col).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


def read_stream_vault(spark: SparkSession, vault_path: str) -> DataFrame:
    """The vault a session stream has built up so far."""
    entries = spark.read.schema(_VAULT_SCHEMA).parquet(vault_path)
    return entries.filter("value IS NOT NULL").select("session_id", "token", "entity_type", "value")


def mask_session_stream(
    lines: DataFrame,
    out_path: str,
    vault_path: str,
    checkpoint: str,
    id_cols: Sequence[str],
    session_col: str,
    order_cols: Sequence[str],
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Mask a stream with one numbering per session that goes on from batch to batch.

    The vault table is the state: it survives restarts and is what ``reveal`` reads.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        mask_session_batch(
            batch, batch_id, out_path, vault_path, id_cols, session_col, order_cols, text_col, rules
        )

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def reveal_stream(
    messages: DataFrame,
    vault: DataFrame,
    out_path: str,
    checkpoint: str,
    id_cols: Sequence[str],
    text_col: str = "text",
    session_col: str = "session_id",
    available_now: bool = True,
) -> StreamingQuery:
    """Restore each micro-batch of messages from a static vault."""

    def run(batch: DataFrame, batch_id: int) -> None:
        reveal(batch, vault, id_cols, text_col, session_col).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}"
        )

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
