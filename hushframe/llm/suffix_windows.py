"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digit first.

A window is a suffix cut at the threshold, and equal windows are exactly what is left
in one group when suffixes are sorted by their first ``threshold`` bytes.  The digits are
chosen so that most suffixes fall out of the sort early and in bulk:

1. The first digit of a window is the smallest hash of its 24-byte grams.  Consecutive
   windows with the same first digit are sorted together, as a run.  Runs whose digit
   occurs nowhere else are done: their windows are unique.
2. The second digit is the run's whole text.  Of equal runs all but the first are repeated
   in every window; a run that shares its digit with no other text has nothing more to lose.
3. What is left are first runs of different texts under one digit, and runs that may hold
   a window twice.  They are cut into blocks: windows in a row that begin up to ``BLOCK`` - 1
   places apart, counted from the place of their smallest gram.  Equal windows lie in blocks
   with the same core, the bytes that every window of such a block has.  The third digit is
   the core, the fourth the block's whole text, and blocks are settled as runs are.  No
   block holds a window twice.
4. First blocks of different texts under one core are left.  Their windows are sorted one
   by one, by all their bytes.

Digits stand for bytes by hashes: 64 bits for the first, 64 more for a run, as much for a
block, 128 for a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import powers_of, query, stored, table
from hushframe.operators.skew import number_within

GRAM = 24
BLOCK = 8
BYTES_AT_ONCE = 4 << 20
RUNS_AT_ONCE = 2_000
# Bytes of texts whose windows are hashed at once.
HASHED_AT_ONCE = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the ``GRAM`` bytes at each place, by doubling."""
    factor = 0x9E3779B97F4A7C15
    one = data.astype(np.uint64) + np.uint64(1)

    def widen(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        n = len(right) - by
        return left[:n] * np.uint64(pow(factor, by, 1 << 64)) + right[by:]

    two = widen(one, one, 1)
    four = widen(two, two, 2)
    eight = widen(four, four, 4)
    sixteen = widen(eight, eight, 8)
    n = len(sixteen) - 8
    out = sixteen[:n] * np.uint64(pow(factor, 8, 1 << 64)) + eight[16 : 16 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and first digit of each run, and whether its gram may stand in it twice.

    For one text of at least ``threshold`` bytes; every window is in exactly one run.
    """
    grams = gram_hashes(data)
    width = threshold - GRAM + 1
    least = sliding(grams, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, len(least)))
    digit = least[first]
    # Places whose gram is the least of some window: those that equal the largest of the minima around them.
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(sliding(around, width, np.maximum) == grams)
    low = np.searchsorted(places, first)
    high = np.searchsorted(places, first + size - 1 + width - 1, side="right")
    # Two such places with equal grams close together (in one run they are up to ``width`` apart): only there can a run hold
    # a window twice.
    order = np.lexsort((places, grams[places]))
    by_gram, by_place = grams[places][order], places[order]
    twin = np.zeros(len(places) + 1, np.int64)
    twin[order[:-1] + 1] = (by_gram[1:] == by_gram[:-1]) & (by_place[1:] - by_place[:-1] <= width)
    many = np.cumsum(twin)
    return first, size, digit.view(np.int64), many[high] > many[low]


def text_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of parts of a text."""
    from xxhash import xxh3_64_digest

    digests = [xxh3_64_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), "<i8")


def run_table(docs: DataFrame, threshold: int, with_text: bool) -> DataFrame:
    """``(digit[, text, doc, first, size, periodic])``: the runs of all texts (``_id, _text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < threshold:
                    continue
                first, size, digit, again = runs_of(np.frombuffer(raw, np.uint8), threshold)
                hashes = None
                if with_text:
                    hashes = text_hashes(raw, first, first + size - 1 + threshold)
                rows.append((doc, first, size, digit, hashes, again))
                held += len(raw)
                if held > BYTES_AT_ONCE:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        digit = pa.array(np.concatenate([row[3] for row in rows]))
        again = pa.array(np.concatenate([row[5] for row in rows]))
        if not with_text:
            return pa.RecordBatch.from_arrays([digit, again], names=["digit", "periodic"])
        at = np.repeat(np.arange(len(rows)), [len(row[1]) for row in rows])
        doc = pa.array([row[0].as_py() for row in rows], pa.int64()).take(pa.array(at))
        first, size = (pa.array(np.concatenate([row[i] for row in rows]), t) for i, t in ((1, pa.int64()), (2, pa.int64())))
        return pa.RecordBatch.from_arrays(
            [digit, pa.array(np.concatenate([row[4] for row in rows])), doc, first, size, again],
            names=["digit", "text", "doc", "first", "size", "periodic"],
        )

    schema = "digit long, text long, doc long, first long, size long, periodic boolean" if with_text else "digit long, periodic boolean"
    return docs.mapInArrow(cut, schema)


def with_parts(docs: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """``(_id, _text)`` and lists ``columns`` of the texts that have ``parts`` (doc and these columns)."""
    listed = parts.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("parts"))  # of one text
    return docs.join(listed, docs["_id"] == listed["doc"]).select("_id", "_text", *[f"parts.{c}" for c in columns])


def blocks_of(raw: bytes, grams: np.ndarray, first: np.ndarray, size: np.ndarray, digit: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and start of the core of each block of the given runs of a text."""

    def places(more: int) -> tuple[np.ndarray, np.ndarray]:
        """Run and place of all that begins in a run's first ``size + more`` places."""
        run = np.repeat(np.arange(len(first)), size + more)
        return run, np.arange(len(run)) - np.repeat(np.cumsum(size + more) - size - more - first, size + more)

    # The leftmost place of the smallest gram in each window depends on the window's bytes alone.
    run, at = places(threshold - GRAM)
    least = grams[at].view(np.int64) == digit[run]
    run, at = run[least], at[least]
    of, window = places(0)
    gram = at[np.searchsorted(run * len(raw) + at, of * len(raw) + window)]
    core = gram - (gram - window) // BLOCK * BLOCK
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1]) | (core[1:] != core[:-1])])
    begin = np.flatnonzero(new)
    return window[begin], np.diff(np.append(begin, len(window))), core[begin]


def block_table(docs: DataFrame, open_runs: DataFrame, threshold: int) -> DataFrame:
    """``(digit, text, doc, first, size)``: the blocks of the runs (doc, first, size, digit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, *runs in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                grams = gram_hashes(np.frombuffer(raw, np.uint8))
                all_runs = [run.values.to_numpy() for run in runs]
                for part in range(0, len(all_runs[0]), RUNS_AT_ONCE):
                    first, size, core = blocks_of(raw, grams, *[x[part : part + RUNS_AT_ONCE] for x in all_runs], threshold)
                    cores = text_hashes(raw, core, core + threshold - BLOCK + 1)
                    texts = text_hashes(raw, first, first + size - 1 + threshold)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cores), pa.array(texts), pa.array(np.full(len(first), doc.as_py())), pa.array(first), pa.array(size)],
                        names=["digit", "text", "doc", "first", "size"],
                    )

    joined = with_parts(docs, open_runs, "first", "size", "digit")
    return joined.mapInArrow(cut, "digit long, text long, doc long, first long, size long")


def window_hashes(data: np.ndarray, places: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Two mixed 64-bit hashes of the ``threshold`` bytes at each of the places.

    Each is a polynomial in the place within the window, from sums over all bytes: its odd
    factor has an inverse.
    """
    out = []
    for factor, seed in ((0x9E3779B97F4A7C15, 11), (0xD1342543DE82EF95, 12)):
        values = np.random.default_rng(seed).integers(1 << 64, size=256, dtype=np.uint64)
        high, low = powers_of(factor, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((high[:, None] * low).ravel()[: len(data)] * values[data], out=sums[1:])
        high, low = powers_of(pow(factor, -1, 1 << 64), len(data))
        found = (sums[places + threshold] - sums[places]) * high[places >> 12] * low[places & 4095]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(32)
        out.append(found.view(np.int64))
    return out


def open_windows(docs: DataFrame, open_blocks: DataFrame, threshold: int) -> DataFrame:
    """``(h1, h2, doc, first)``: every window of the blocks (doc, first, size), with 128 bits of its text."""

    def hashed(docs: list[int], raws: list[bytes], blocks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(raws), np.uint8)
        counts = [len(first) for first, _ in blocks]
        begins = np.repeat(np.cumsum([0, *map(len, raws[:-1])]), counts)
        of = np.repeat(np.array(docs, np.int64), counts)
        first, size = (np.concatenate(column) for column in zip(*blocks, strict=True))
        own = np.repeat(np.arange(len(first)), size)
        windows = np.arange(len(own)) - np.repeat(np.cumsum(size) - size - first, size)
        h1, h2 = window_hashes(data, windows + begins[own], threshold)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, of[own], windows)], names=["h1", "h2", "doc", "first"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, blocks, held = [], [], [], 0
            for doc, text, first, size in zip(*batch.columns, strict=True):
                ids.append(doc.as_py())
                raws.append(text.as_py().encode())
                blocks.append((first.values.to_numpy(), size.values.to_numpy()))
                held += len(raws[-1])
                if held > HASHED_AT_ONCE:
                    yield from hashed(ids, raws, blocks)
                    ids, raws, blocks, held = [], [], [], 0
            if ids:
                yield from hashed(ids, raws, blocks)

    return with_parts(docs, open_blocks, "first", "size").mapInArrow(cut, "h1 long, h2 long, doc long, first long")


def settled(parts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of runs or blocks (digit, text, doc, first, size, periodic): those (doc, first, size) that are equal to an earlier one,
    and those (doc, first, size, digit) that are still open."""
    place = F.struct("doc", "first")
    texts = stored(
        parts.groupBy("digit", "text").agg(
            F.min(F.struct("doc", "first", "size")).alias("head"), F.count(F.lit(1)).alias("n"), F.max("periodic").alias("periodic")
        ),
        name,
    )
    later = (
        parts.join(texts.filter(F.col("n") > 1).select("digit", "text", "head"), ["digit", "text"])
        .filter(place != F.struct("head.doc", "head.first")).select("doc", "first", "size")
    )
    undecided = texts.groupBy("digit").agg(F.count(F.lit(1)).alias("texts"), F.max("periodic").alias("any_periodic")).filter(
        (F.col("texts") > 1) | F.col("any_periodic")
    )
    return later, texts.join(undecided, "digit").select("head.doc", "head.first", "head.size", "digit")


def repeated_windows(docs: DataFrame, threshold: int) -> DataFrame:
    """``(doc, first, size)``: runs of window starts whose text also starts earlier, for documents (``_id`` long, ``_text``)."""
    digits = run_table(docs, threshold, with_text=False)
    repeated = (
        digits.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.max("periodic").alias("periodic"))
        .filter((F.col("n") > 1) | F.col("periodic")).select("digit")
    )
    runs = stored(run_table(docs, threshold, with_text=True).join(repeated, "digit", "left_semi"), "runs")
    later_runs, open_runs = settled(runs, "run-texts")
    blocks = stored(block_table(docs, open_runs, threshold), "blocks").withColumn("periodic", F.lit(False))
    later_blocks, open_blocks = settled(blocks, "block-texts")
    windows = stored(open_windows(docs, open_blocks, threshold), "windows")
    place = F.struct("doc", "first")
    heads = windows.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    again = (
        windows.join(heads, ["h1", "h2"]).filter(place != F.col("head"))
        .select("doc", "first", F.lit(1).cast("long").alias("size"))
    )
    return later_runs.union(later_blocks).union(again)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``_id``, a long in the order of the ids, one per document.

    Ids that are unique integers serve as they are.  Otherwise (nulls come first)
    documents are numbered by id and, for one id, by a hash of the text, so rows
    that repeat both are one document.
    """
    ids = df.select(id_col)
    if df.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        n, n_distinct = ids.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
        if n == n_distinct:
            return df.withColumn("_id", F.col(id_col).cast("long"))
    hashed = df.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    numbers = number_within(hashed.select(F.col(id_col).alias("_key"), "_hash").distinct(), [], ["_key", "_hash"], "_id")
    numbers = numbers.withColumnRenamed("_hash", "_number_hash")
    return hashed.join(
        numbers, hashed[id_col].eqNullSafe(numbers["_key"]) & (hashed["_hash"] == numbers["_number_hash"])
    ).drop("_key", "_hash", "_number_hash")


def covered(first: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under windows that start in the given runs."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((first + size - 1 + threshold)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(df: DataFrame, threshold: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) and ``spans`` (start, end).

    A byte goes if a string of ``threshold`` bytes that covers it also starts earlier:
    in a document with a smaller id, or further left in the same one.  Strings are
    judged on the input.  A null text is empty.
    """
    if threshold <= GRAM:
        raise ValueError(f"the threshold must be above {GRAM} bytes")
    rows = keyed(df, id_col, text_col).select(F.col(id_col).alias("_own"), "_id", F.col(text_col).alias("_text"))
    docs = rows.select("_id", "_text").filter(F.octet_length("_text") >= threshold)
    gone = repeated_windows(docs, threshold).groupBy("doc").agg(F.collect_list(F.struct("first", "size")).alias("gone"))  # of one text
    # Written first, so that what it shuffled is off the disks when the texts are shuffled.
    gone = stored(gone, "gone")
    joined = rows.join(gone, rows["_id"] == gone["doc"], "left").select("_own", "_text", "gone.first", "gone.size")
    own_type = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                n_bytes, n_removed, kept, spans = [], [], [], []
                for text, first, size in zip(*(part.column(i) for i in (1, 2, 3)), strict=True):
                    raw = (text.as_py() or "").encode()
                    found: list[tuple[int, int]] = []
                    if first.is_valid and len(first.values):
                        ends = covered(first.values.to_numpy(), size.values.to_numpy(), threshold)
                        found = list(zip(*(x.tolist() for x in ends), strict=True))
                    edges = [0, *(x for span in found for x in span), len(raw)]
                    n_bytes.append(len(raw))
                    n_removed.append(sum(b - a for a, b in found))
                    kept.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                    spans.append([{"start": a, "end": b} for a, b in found])
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n_bytes, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array([len(x) for x in spans], pa.int64()),
                        pa.array(kept, pa.binary()),
                        pa.array(spans, span_type),
                    ],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    return joined.mapInArrow(
        cut,
        f"`{id_col}` {own_type}, n_bytes long, n_removed long, n_spans long, kept binary,"
        " spans array<struct<start: bigint, end: bigint>>",
    )


@query("op7_suffix_windows")
def op7_suffix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its bytes under repeated 100-byte strings."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
