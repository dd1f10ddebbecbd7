"""Packing of documents into sequences: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so the whole instance is a histogram of at
most ``capacity`` counts, however many documents there are.  That histogram is all the
driver sees.  It is solved in bulk into patterns (so many sequences with these sizes),
and documents take their places in the patterns by their rank among those of their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, query, table
from hushframe.llm.tokens import public_path, worker_encoder
from hushframe.operators.skew import number_within

Pattern = tuple[tuple[tuple[int, int], ...], int]


def token_pieces(
    df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)``: every text's ids and end id, cut only where longer than ``capacity``.

    A null text is an empty one: a piece of just the end id.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, word_ends=True, end_id=end_id)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encoder.ids(text.as_py()))
                for number, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first : first + 4 * capacity]
                    at.append(row)
                    piece.append(number)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long"
    return df.select(id_col, text_col).mapInArrow(encode, schema)


def largest_at_most(counts: np.ndarray, size: int) -> int:
    """The largest size with a count, not above ``size``; 0 if none."""
    found = np.flatnonzero(counts[: max(size, 0) + 1])
    return int(found[-1]) if len(found) else 0


def smallest_two(counts: np.ndarray) -> tuple[int, int]:
    """The two smallest items' sizes; a missing one is past every capacity."""
    sizes = np.flatnonzero(counts)
    far = 2 * len(counts)
    if not len(sizes):
        return far, far
    first = int(sizes[0])
    return first, first if counts[first] > 1 else int(sizes[1]) if len(sizes) > 1 else far


def best_pair(counts: np.ndarray, room: int) -> tuple[int, int]:
    """The two items with the largest sum within ``room``, the larger first; zeros if none."""
    sizes = np.flatnonzero(counts[: room + 1])
    best, low, high = (0, 0), 0, len(sizes) - 1
    while low <= high:
        a, b = int(sizes[high]), int(sizes[low])
        if low == high and counts[a] < 2:
            break
        if a + b > room:
            high -= 1
        else:
            if a + b > sum(best):
                best = (a, b)
            low += 1
    return best


def dominating_set(counts: np.ndarray, size: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes of a set with an item of ``size`` that dominates every other set with that item, or None.

    The Martello-Toth cases of up to three items; ``counts`` is without the item itself.
    """
    room = capacity - size
    partner = largest_at_most(counts, room)
    if not partner:
        return (size,)
    first, second = smallest_two(counts)
    if partner == room or first + second > room:
        return (size, partner)
    sizes = np.flatnonzero(counts)
    smallest = np.repeat(sizes, np.minimum(counts[sizes], 3))[:3]
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    a, b = best_pair(counts, room)
    if partner >= a + b:
        return (size, partner)
    # Any other pair has to lie between the two, and needs two items there.
    if partner == a and counts[b + 1 : a].sum() <= 1:
        return (size, a, b)
    return None


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Fix dominating sets, all equal ones at a time, until none is left; the patterns and the rest of the histogram."""
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                counts[size] -= 1
                found = dominating_set(counts, size, capacity)
                counts[size] += 1
                if found is None:
                    break
                need: dict[int, int] = {}
                for x in found:
                    need[x] = need.get(x, 0) + 1
                times = min(int(counts[x]) // n for x, n in need.items())
                for x, n in need.items():
                    counts[x] -= n * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: each size goes to the fullest sequences that still take it."""
    by_room: dict[int, list[Pattern]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        rooms = sorted(room for room in by_room if room >= size)
        for room in rooms:
            while left and by_room.get(room):
                items, times = by_room[room].pop()
                each = min(room // size, left)
                whole = min(times, left // each)
                if times > whole:
                    by_room[room].append((items, times - whole))
                by_room.setdefault(room - each * size, []).append(((*items, (size, each)), whole))
                left -= each * whole
            if not left:
                break
        each = capacity // size
        for n, whole in ((each, left // each), (left % each, 1)):
            if n and whole:
                by_room.setdefault(capacity - n * size, []).append((((size, n),), whole))
    return [pattern for room in sorted(by_room) for pattern in by_room[room]]


def solve(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pack(df: DataFrame, capacity: int, keys: list[str], size_col: str = "length") -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    ``size_col`` must lie in 1..``capacity``; rows with a null or other size are an
    error.  ``keys`` order the rows of one size; rows equal in all of them may swap
    places.  An empty table stays empty.
    """
    spark = df.sparkSession
    histogram = df.groupBy(size_col).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        if row[size_col] is None or not 1 <= row[size_col] <= capacity:
            raise ValueError(f"size {row[size_col]} is not in 1..{capacity}")
        counts[row[size_col]] = row["n"]
    taken = np.zeros(capacity + 1, np.int64)
    places, base = [], 0
    for items, times in solve(counts, capacity):
        offset = 0
        for size, each in items:
            places.append((size, int(taken[size]), base, each, offset))
            taken[size] += each * times
            offset += size * each
        base += times
    table_ = np.array(sorted(places), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table_)  # bounded by the capacity, not by the rows
    ranked = number_within(df, [size_col], keys, "_nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of, first, base_of, each_of, offset_of = shared.value.T
        starts = np.searchsorted(size_of, np.arange(capacity + 2))
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(batch.schema.get_field_index("_nth")).to_numpy(zero_copy_only=False) - 1
            at = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                low, high = starts[size], starts[size + 1]
                of = sizes == size
                at[of] = low + np.searchsorted(first[low:high], ranks[of], side="right") - 1
            nth = ranks - first[at]
            sequence = base_of[at] + nth // each_of[at]
            offset = offset_of[at] + nth % each_of[at] * sizes
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_nth"]
            names = [name for name in batch.schema.names if name != "_nth"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"]
            )

    columns = ranked.drop("_nth").schema
    return ranked.mapInArrow(place, columns.add("sequence_id", "long").add("offset", "long"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with its sequence and place.

    Ids that are null are kept; repeated rows are packed each by itself.
    """
    pieces = cut_lineage(token_pieces(df, tokenizer, capacity, id_col, text_col))
    return pack(pieces, capacity, [id_col, "piece"])


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
