"""All places where the strings of a table stand in texts, for tables of any size.

Each string is known by the hash of its first bytes, as many as the largest power
of two that fits into it.  Such windows are hashed at every place of every text by
doubling, and only places whose hash is set in a bitmap of bounded size (one per
window width) leave the task, with the few bytes that decide.  A join on the hash and
a literal comparison do the rest, so neither texts nor strings are ever paired.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.skew import ROWS_PER_SALT, cut_lineage, heavy_keys, salted_lookup

# Workers get the code of this module with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits of each width's bitmap: 1 MiB, whatever the number of strings; more strings only mean more false candidates.
BITMAP_BITS = 23
# Rows of a bitmap as Spark builds it.
_ROW_BITS = 15
# Texts are searched together up to so many bytes; a longer one is searched in overlapping parts.
# The arrays of a search take some 60 times that, in every task.
BYTES_AT_ONCE = 1 << 18
# Rows held as Python strings, and candidates held as Python tuples, at a time.
ROWS_AT_ONCE = 200
CANDIDATES_AT_ONCE = 10_000

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def _byte_values() -> np.ndarray:
    """One 64-bit number per byte, from a mixing rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SPREAD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_VALUES = _byte_values()


def window_hashes(raw: np.ndarray, widths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width, a power of two, the hash of the window at every place that has one."""
    now, factor = _VALUES[raw], int(_SPREAD)
    width = 1
    for wanted in sorted(widths):
        while width < wanted and len(now) > width:
            now = now[:-width] * np.uint64(factor) + now[width:]
            factor = factor * factor % (1 << 64)
            width *= 2
        if width != wanted:
            return
        yield width, now


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def keyed_literals(literals: DataFrame, literal_col: str) -> DataFrame:
    """``literals`` (none null or empty) with ``_width``, ``_hash`` and ``_bit`` of each string."""
    names = [f"_c{n}" for n in range(len(literals.columns))]
    place = literals.columns.index(literal_col)
    kinds = ", ".join(f"{n} {literals.schema[c].dataType.simpleString()}" for n, c in zip(names, literals.columns, strict=True))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, hashes = [], []
            for literal in batch.column(place).to_pylist():
                raw = np.frombuffer(literal.encode(), np.uint8)
                width = 1 << (len(raw).bit_length() - 1)
                widths.append(width)
                hashes += [int(found[0]) for _, found in window_hashes(raw[:width], [width])]
            found = np.array(hashes, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(widths, pa.int32()), pa.array(found.astype(np.int64)), pa.array(_bits(found, BITMAP_BITS))],
                names=[*names, "_width", "_hash", "_bit"],
            )

    done = literals.toDF(*names).mapInArrow(key, f"{kinds}, _width int, _hash long, _bit long")
    return done.toDF(*literals.columns, "_width", "_hash", "_bit")


def hash_bitmaps(keyed: DataFrame) -> dict[int, np.ndarray]:
    """Per window width the set bits, put together by the executors: at most 2^23 bits for each of a few widths."""
    rows = (
        keyed.groupBy("_width", F.shiftright("_bit", _ROW_BITS).alias("row"))
        .agg(F.bitmap_construct_agg(F.col("_bit") % (1 << _ROW_BITS)).alias("bits"))
        .collect()
    )
    out: dict[int, np.ndarray] = {}
    for row in rows:
        bitmap = out.setdefault(row["_width"], np.zeros(1 << (BITMAP_BITS - 3), np.uint8))
        part = np.frombuffer(row["bits"], np.uint8)
        first = row["row"] << (_ROW_BITS - 3)
        bitmap[first : first + len(part)] = part
    return out


def _parts(texts: list[bytes], overlap: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of ``(text, first byte, characters before it, bytes to search)``, each of bounded size.

    The parts of a long text overlap, so that a string is whole in one of them.
    """
    group: list[tuple[int, int, int, bytes]] = []
    size = 0
    step = max(BYTES_AT_ONCE, overlap)
    for at, text in enumerate(texts):
        chars = 0
        for first in range(0, max(len(text), 1), step):
            part = text[first : first + step + overlap]
            if group and size + len(part) > step + overlap:
                yield group
                group, size = [], 0
            group.append((at, first, chars, part))
            size += len(part)
            if first + step < len(text):
                chars += sum(byte & 0xC0 != 0x80 for byte in text[first : first + step])
    if group:
        yield group


def _candidates(texts: list[bytes], bitmaps: dict[int, np.ndarray], word_bounded: bool) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``(text, first character, width, hash, bytes from there)`` of every place whose window may open a string."""
    longest = 2 * max(bitmaps) + 4
    step = max(BYTES_AT_ONCE, longest)
    for group in _parts(texts, longest):
        raw = np.frombuffer(b"".join(part for *_, part in group), np.uint8)
        ends = np.cumsum([len(part) for *_, part in group])
        starts = ends - [len(part) for *_, part in group]
        opens = (raw & 0xC0) != 0x80
        chars = np.cumsum(opens)
        if word_bounded and len(raw):
            word = _WORD[raw]
            inside = np.concatenate([[False], word[1:] & word[:-1]])
            for start, (at, first, _, _) in zip(starts, group, strict=True):
                if start < len(raw):
                    inside[start] = first > 0 and _WORD[texts[at][first - 1]] and word[start]
            opens = opens & ~inside
        for width, hashes in window_hashes(raw, list(bitmaps)):
            bits = _bits(hashes, BITMAP_BITS)
            hit = (bitmaps[width][bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
            places = np.flatnonzero(hit.astype(bool) & opens[: len(hashes)])
            owner = np.searchsorted(ends, places, side="right")
            for place, own in zip(places.tolist(), owner.tolist(), strict=True):
                at, first, before, part = group[own]
                local = place - int(starts[own])
                # Past this part's own bytes the next one finds it; a window may not run out of the text.
                if local + width > len(part) or (local >= step and len(part) > step):
                    continue
                shown = part[local : local + 2 * width + 3].decode(errors="ignore").encode()
                earlier = int(chars[starts[own] - 1]) if starts[own] else 0
                yield at, before + int(chars[place]) - 1 - earlier, width, int(hashes[place]), shown


def find_literals(
    df: DataFrame,
    keep: Sequence[str],
    literals: DataFrame,
    text_col: str = "text",
    literal_col: str = "value",
    on: Sequence[str] = (),
    word_bounded: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``keep``, ``start``, ``end`` (code points) and the columns of ``literals``: every place of every string.

    ``on`` (columns of both sides, among ``keep``) restricts strings to the texts
    with equal values there.  With ``word_bounded`` no letter, digit, underscore or
    non-ASCII character may touch a string's end where the string has one, too.
    Places may overlap.  Null texts, null and empty strings have none; equal rows of
    ``literals`` count once, repeated texts each have their own.  Keys with very many
    candidates are salted.
    """
    useful = literals.filter((F.col(literal_col) != "") & F.col(literal_col).isNotNull()).distinct()
    keyed = cut_lineage(keyed_literals(useful, literal_col))
    bitmaps = hash_bitmaps(keyed)
    names = [f"_k{n}" for n in range(len(keep))]
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    rows = df.filter(F.col(text_col).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col))
    shared = df.sparkSession.sparkContext.broadcast(bitmaps)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["_start", "_width", "_hash", "_shown"]
        for batch in batches:
            if not shared.value:
                return
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                found = _candidates([text.encode() for text in part.column(len(names)).to_pylist()], shared.value, word_bounded)
                while some := list(itertools.islice(found, CANDIDATES_AT_ONCE)):
                    at, start, width, hashes, shown = zip(*some, strict=True)
                    taken = [column.take(pa.array(at, pa.int64())) for column in part.columns[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *taken, pa.array(start, pa.int32()), pa.array(width, pa.int32()),
                            pa.array(np.array(hashes, np.uint64).astype(np.int64)), pa.array(shown, pa.binary()).cast(pa.string()),
                        ],
                        names=[*names, *schema],
                    )

    typed = ", ".join(f"{n} {kind}" for n, kind in zip(names, kinds, strict=True))
    places = rows.mapInArrow(search, f"{typed + ', ' if typed else ''}_start int, _width int, _hash long, _shown string")
    shared_names = {c: names[list(keep).index(c)] for c in on}
    strings = keyed.drop("_bit").select(
        *[F.col(c).alias(shared_names.get(c, f"_l{n}")) for n, c in enumerate(literals.columns)], "_width", "_hash"
    )
    keys = [*shared_names.values(), "_width", "_hash"]
    places = cut_lineage(places)
    counts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    paired = salted_lookup(places, strings, keys, heavy_keys(counts, keys, "_n", rows_per_salt), keys, ["_start", *names], "inner")
    literal = F.col(f"_l{literals.columns.index(literal_col)}")
    right = F.startswith("_shown", literal)
    if word_bounded:
        wordy = "[A-Za-z0-9_]|[^\\x00-\\x7F]"
        after = F.expr("substring(_shown, length({0}) + 1, 1)".format(f"_l{literals.columns.index(literal_col)}"))
        right = right & ~(after.rlike(wordy) & F.substring(literal, -1, 1).rlike(wordy))
    return paired.filter(right).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.col("_start").alias("start"),
        (F.col("_start") + F.length(literal)).alias("end"),
        *[F.col(f"_l{n}").alias(c) for n, c in enumerate(literals.columns) if c not in on],
    )
