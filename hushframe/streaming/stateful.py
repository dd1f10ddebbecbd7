"""Session masking of streams with the numbers in Spark's state store."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hushframe.functions import spans
from hushframe.functions.catalog import Rule, chosen_rules
from hushframe.operators.guards import valid_text_columns
from hushframe.operators.vault import session_key

# Workers get the code of this module with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MASKED, VAULT = "masked", "vault"
# Numbers from here on are stepped over one by one where a text carries them, as in ``mask.step_over``.
EDGE = 10**18


class SessionNumbers(StatefulProcessor):
    """Gives the values of one session their tokens; the state holds values, counters and far-off placeholders.

    ``tokens`` maps (label, value) to its number and may expire; ``counters`` maps a
    label to the highest number given out or seen in a text and never expires, so a
    number is given out once only; ``standing`` lists placeholders beyond the counters' reach.
    """

    def __init__(self, order_size: int, ttl_ms: int | None):
        self.order_size = order_size
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "entity_type string, value string", "n long", self.ttl_ms)
        self.counters = handle.getMapState("counters", "entity_type string", "n long")
        self.standing = handle.getMapState("standing", "token string", "n long")

    def _number(self, label: str, top: dict[str, int]) -> int:
        n = top[label] + 1
        while n >= EDGE and self.standing.containsKey((f"[{label}_{n}]",)):
            n += 1
        top[label] = n
        return n

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # What one micro-batch holds of a session; the texts stay as they are.
        held = sorted(rows, key=lambda row: [(x is not None, x) for x in row.order.values()])
        top: dict[str, int] = {}
        before: dict[str, int] = {}
        for row in held:
            for found in row.found:
                label = found["entity_type"]
                if label not in top:
                    counter = self.counters.getValue((label,))
                    top[label] = before[label] = counter[0] if counter else 0
                if found["taken"] is not None:
                    top[label] = max(top[label], found["taken"])
                    digits = found["value"][len(label) + 2 : -1]
                    if len(digits) == 19 and digits[0] != "0" and not self.standing.containsKey((found["value"],)):
                        self.standing.updateValue((found["value"],), (1,))
        known: dict[tuple[str, str], int] = {}
        for row in held:
            edits, fresh = [], []
            for found in sorted((f for f in row.found if f["taken"] is None), key=lambda f: (f["place"], f["value"])):
                name = (found["entity_type"], found["value"])
                if name not in known:
                    old = self.tokens.getValue(name)
                    known[name] = old[0] if old else self._number(found["entity_type"], top)
                    if not old:
                        self.tokens.updateValue(name, (known[name],))
                        fresh.append(name)
                token = f"[{found["entity_type"]}_{known[name]}]"
                edits += [{"start": s["start"], "end": s["end"], "token": token} for s in found["spans"]]
            edits.sort(key=lambda e: e["start"])
            nothing = {"token": None, "entity_type": None, "value": None}
            yield Row(kind=MASKED, session_id=key[0], ids=row.ids, text=row.text, edits=edits, **nothing)
            for label, value in fresh:
                token = f"[{label}_{known[label, value]}]"
                yield Row(kind=VAULT, session_id=key[0], ids=None, text=None, edits=None, token=token, entity_type=label, value=value)
        for label, n in top.items():
            if n != before[label]:
                self.counters.updateValue((label,), (n,))

    def close(self) -> None:
        pass


def require_rocksdb(spark: SparkSession) -> None:
    """An error unless the session keeps state in RocksDB, which keyed state with several variables needs."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")


def mask_session_state(
    lines: DataFrame,
    id_cols: Sequence[str],
    session_cols: Sequence[str],
    order_cols: Sequence[str],
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    ttl_ms: int | None = None,
    extra: str | None = None,
) -> DataFrame:
    """A stream masked with one numbering per session, from keyed state: no vault is read and no batch is written twice.

    The result is a stream of two kinds of rows, told apart by ``kind``: ``masked`` rows
    (session_id, id columns, masked_text) and ``vault`` rows (session_id, token,
    entity_type, value) for values met for the first time.  Written with
    ``write_by_kind`` they lie in two folders.  The tokens are those of the batch
    operator run on each micro-batch with the vault of all earlier ones.

    Detection runs before and rewriting after the stateful step, both as SQL
    expressions.  A session's rows of one micro-batch meet in one task, sorted by
    ``order_cols``: the source's limit per batch bounds them.  With ``ttl_ms`` a value
    that was not met for so long is forgotten and gets a new number when it comes
    back; numbers are never given out twice.  Such a stream looks at the clock, so it runs
    until it is stopped and does not end when its input is used up.
    """
    valid_text_columns(lines, [text_col])
    require_rocksdb(lines.sparkSession)
    found = spans.value_spans(spans.resolved_findings(text_col, chosen_rules(rules), (), extra))
    digits = "regexp_extract(_t, '_([0-9]+)\\\\]$', 1)"
    taken = (
        f"transform(array_distinct({spans.reserved_tokens(text_col)}), _t -> named_struct("
        "'entity_type', regexp_extract(_t, '^\\\\[(.+)_[0-9]+\\\\]$', 1), 'value', _t, 'place', 0,"
        f" 'taken', {spans.reserved_number(digits)}, 'spans', cast(array() AS array<struct<start:int,end:int>>)))"
    )
    ids = F.struct(*id_cols)
    rows = lines.select(
        session_key(session_cols).alias("session_id"), ids.alias("ids"), F.struct(*order_cols).alias("order"),
        F.col(text_col).alias("text"), F.expr(f"coalesce(concat({found}, {taken}), {_NO_VALUES})").alias("found"),
    )
    id_type = lines.select(ids.alias("ids")).schema["ids"].dataType.simpleString()
    out = (
        f"kind string, session_id string, ids {id_type}, text string, edits array<struct<start:int,end:int,token:string>>,"
        " token string, entity_type string, value string"
    )
    numbered = rows.groupBy("session_id").transformWithState(
        SessionNumbers(len(order_cols), ttl_ms), out, "Append", "ProcessingTime" if ttl_ms else "None"
    )
    masked = F.expr(f"CASE WHEN text IS NOT NULL THEN {spans.rewrite('text', 'edits')} END")
    return numbered.select("kind", "session_id", "ids.*", masked.alias("masked_text"), "token", "entity_type", "value")


_NO_VALUES = (
    "cast(array() AS array<struct<entity_type:string,value:string,place:int,taken:bigint,spans:array<struct<start:int,end:int>>>>)"
)


def write_by_kind(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the rows of ``mask_session_state`` to ``path``, masked texts and vault in a folder each, exactly once."""
    writer = (
        stream.writeStream.format("parquet").partitionBy("kind").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """The masked texts that a stream has written."""
    return spark.read.parquet(path).filter(F.col("kind") == MASKED).drop("kind", "token", "entity_type", "value")


def read_new_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The vault rows that a stream has written."""
    return spark.read.parquet(path).filter(F.col("kind") == VAULT).select("session_id", "token", "entity_type", "value")
