"""Reveal of streams by a join with the vault inside the streaming plan, and counts of what a stream has handled."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from hushframe.functions import columns, spans

# A session with more tokens than this does not go into one map; ``lines.reveal_stream`` has no such bound.
MAX_SESSION_TOKENS = 100_000


def reveal_joined(
    messages: DataFrame,
    vault: DataFrame,
    text_col: str = "text",
    session_col: str = "session_id",
    max_session_tokens: int = MAX_SESSION_TOKENS,
) -> DataFrame:
    """``reveal`` as one streaming (or batch) plan: adds ``revealed_text`` and ``status``, with the same results.

    The vault becomes one map per session, which each message is joined with; there is
    one scan of either side and no micro-batch code.  A session whose map would be
    larger than ``max_session_tokens`` is an error, so a vault with one numbering for a
    whole corpus goes through ``lines.reveal_stream`` instead.
    """
    pairs = vault.filter(F.col("value").isNotNull()).groupBy(
        F.col("session_id").cast("string").alias("_session"), "token"
    ).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    entry = F.struct("token", F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"))
    maps = pairs.groupBy("_session").agg(F.collect_list(entry).alias("_entries"))
    too_many = F.concat(F.lit("too many tokens for one map in session "), F.coalesce("_session", F.lit("null")))
    maps = maps.select(
        "_session", F.when(F.size("_entries") > max_session_tokens, F.raise_error(too_many)).otherwise(F.col("_entries")).alias("_entries")
    )
    same = F.col(session_col).cast("string").eqNullSafe(F.col("_session"))
    pattern = spans.quote(spans.TOKEN_PATTERN)
    joined = messages.join(maps, same, "left")
    own = F.expr(f"array_distinct(regexp_extract_all({text_col}, {pattern}, 0))")
    has_token = F.coalesce(F.col(text_col).contains("["), F.lit(False))
    staged = joined.withColumn("_own", F.when(has_token, own).otherwise(F.array().cast("array<string>")))
    staged = staged.withColumn("_known", F.filter("_entries", lambda e: F.array_contains("_own", e["token"])))
    staged = staged.withColumn("_certain", F.filter("_known", lambda e: e["value"].isNotNull()))
    restored = F.when(F.size("_certain") > 0, F.expr(columns.restored(text_col, "map_from_entries(_certain)"))).otherwise(F.col(text_col))
    status = (
        F.when(F.size("_own") == 0, "unchanged")
        .when(F.col("_entries").isNull(), "empty_vault")
        .when(F.size("_certain") < F.size("_known"), "conflicting_tokens")
        .when(F.size("_certain") == F.size("_own"), "restored")
        .when(F.size("_certain") > 0, "partial")
        .otherwise("unknown_tokens")
    )
    done = staged.withColumn("_restored", restored)
    return done.select(*messages.columns, columns.dedupe_scheme("_restored").alias("revealed_text"), status.alias("status"))


METRIC = "hushframe_requests"


def count_requests(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The same stream, observed: how many texts (and how many with a value) each micro-batch handles."""
    return stream.observe(METRIC, F.count(F.lit(1)).alias("requests"), F.count(F.col(text_col)).alias("texts"))


class RequestCounts(StreamingQueryListener):
    """Collects the counts of observed streams; a batch that is replayed counts once.

    Add it with ``spark.streams.addListener``.  ``save`` keeps the counts of finished
    batches in a folder, where those of the runs before and after a restart add up.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple[str, int], tuple[int, int]] = {}
        self.ended: set[str] = set()
        self.done = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        row = progress.get("observedMetrics", {}).get(METRIC)
        if row and row["requests"]:
            self.seen[progress["id"], progress["batchId"]] = (row["requests"], row["texts"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.done:
            self.ended.add(str(event.runId))
            self.done.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60) -> None:
        """Wait until the events of a finished run have arrived."""
        with self.done:
            if not self.done.wait_for(lambda: run_id in self.ended, seconds):
                raise TimeoutError("the stream's last events have not arrived")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add what was collected: one row per query and batch."""
        rows = [(query, batch, *counts) for (query, batch), counts in self.seen.items()]
        spark.createDataFrame(rows, "query string, batch long, requests long, texts long").write.mode("append").parquet(path)


def read_request_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(query, batch, requests, texts)``, each batch once."""
    return spark.read.parquet(path).dropDuplicates(["query", "batch"])
