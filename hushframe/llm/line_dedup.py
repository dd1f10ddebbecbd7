"""Fuzzy line dedup: candidates by shared word pairs or by SimHash, edit similarity, connected groups.

Equal normalised lines are one node, known by a digest; what follows works on one line of each node.

Without a limit on fingerprint bits (``k`` None) every pair of the asked similarity is
found.  Lines of n and m <= n words within d edits have n - 1 - 2d pairs of neighbouring
words in common, so in any order of all word pairs they share one of the first few
(prefix filter).  The order is rarest first by a sample; a poor sample costs time only.
Lines under a common key are compared by a few bits of their words first, which lie
apart only as far as the words do.

With ``k``, nodes whose fingerprints agree in all but ``k`` of ``k + 2`` blocks share a key.
Under each key all nodes are first compared with the key's smallest node; what that and
the other keys have joined need not be compared again, so a second pass compares only
nodes of different groups.  The links of both passes give the groups that all pairs would.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, powers_of, query, stored, table, text_key
from hushframe.llm.components import components, links_under_keys
from hushframe.llm.url_filter import MAX_LEVEL_BYTES, bloom
from hushframe.operators.skew import ROWS_PER_SALT, heavy_keys, salted_lookup, shuffles_dropped

LANE = 31
BITS = 2 * LANE
# Characters that are words by themselves; the range first, as looking up a script is slow.
SPACELESS = r"[\u0E00-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
# Documents looked at for the order of word pairs, and the pairs whose counts are sent to every task.
SAMPLE_DOCS = 8_000
KNOWN_GRAMS = 400_000
# Lines under one key that are compared with each other at once. Of more, only those that heads leave in different groups, if
# more than so many pairs a line may be similar, or if there are more lines than any task should compare.
PAIRWISE_KEY = 256
FEW_PAIRS = 8
MOST_ROWS = 1 << 14
# Pairs of rows under keys that are made at once.
PAIRED_AT_ONCE = 500_000
# Longs of bits that stand for the words of a line: with two, lines of 140 words and more set most of the bits, which told few of them apart.
BAG_WORDS = 4
# Bytes of a row under a key when it is shuffled. Keys are gone through in parts whose rows take no more than the lines themselves
# or these bytes.
ROW_BYTES = 50
LEAST_BYTES = 64 << 20
# Repeated keys of a part, for which a bitmap has some bits each, and its largest size in bits.
KEYS_AT_ONCE = 1 << 25
BITMAP_BITS = 1 << 28
# Pairs whose lines are shuffled at once, if there are no more lines than that.
PAIRS_AT_ONCE = 500_000


def normalised(line: Column) -> Column:
    """Lower case, and everything but letters turned into single spaces."""
    low = F.lower(line)

    def spaced(others: str) -> Column:
        # A single space between letters is not replaced by itself.
        return F.regexp_replace(low, f"{others}(?:{others}+|(?<! ))", " ")

    return F.trim(F.when(F.length(low) == F.octet_length(low), spaced("[^a-z]")).otherwise(spaced(r"[^\p{L}\p{M}]")))


def every_line(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, line, norm, digest)`` of every line that is not blank, in rows with an id; ``doc`` is (id, key of the text).

    Characters of scripts without spaces are words.  A line without letters has an
    empty ``norm`` and the digest of itself.
    """
    spaced = F.trim(F.regexp_replace(F.regexp_replace("norm", SPACELESS, " $0 "), " +", " "))
    lines = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
        lambda line: F.struct(normalised(line).alias("norm"), line.alias("raw")),
    )
    return (
        df.filter(F.col(id_col).isNotNull())
        .select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text")).alias("doc"), F.posexplode(lines).alias("line", "parts"))
        .select("doc", "line", "parts.norm", F.when(F.col("parts.norm") == "", F.col("parts.raw")).alias("raw"))
        .filter(F.col("raw").isNull() | F.col("raw").rlike(r"\S"))
        .withColumn("norm", F.when((F.length("norm") < F.octet_length("norm")) & F.col("norm").rlike(SPACELESS), spaced).otherwise(F.col("norm")))
        .withColumn("digest", F.substring(F.unhex(F.sha2(F.coalesce("raw", "norm"), 256)), 1, 16))
        .select("doc", "line", "norm", "digest")
    )


def with_simhash(nodes: DataFrame) -> DataFrame:
    """``(node, fp)`` of lines (node, norm): per bit, whether it is set in over half of the words' hashes (62 bits).

    Bits ``i`` and ``i + 31`` are counted in one long, in lanes of 31 bits, which hold
    any line of up to half a billion words.  A majority is read off both lanes at once:
    twice the count plus 2**30 - 1 - n reaches 2**30 exactly when the bit is set in
    more than half of the n words.
    """
    pair = (1 << LANE) | 1
    words = nodes.select("node", F.explode(F.split("norm", " ")).alias("word")).select("node", F.xxhash64("word").alias("h"))
    sums = words.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(f"shiftrightunsigned(h, {bit}) & {pair}L")).alias(f"s{bit}") for bit in range(LANE)],
    )
    top = LANE - 1
    offset = f"({(1 << top) - 1}L - n) * {pair}L"
    parts = [f"shiftleft(shiftrightunsigned(shiftleft(s{bit}, 1) + k, {top}) & {pair}L, {bit})" for bit in range(LANE)]
    return sums.withColumn("k", F.expr(offset)).select("node", F.expr(" | ".join(parts)).alias("fp"))


def block_keys(fp: Column, k: int) -> Column:
    """A key for each choice of two blocks out of ``k + 2``; fingerprints within ``k`` bits share one."""
    edges = [BITS * i // (k + 2) for i in range(k + 3)]
    masks = [sum(1 << b for b in range(low, high)) for low, high in itertools.pairwise(edges)]
    keys = []
    for at, (a, b) in enumerate(itertools.combinations(masks, 2)):
        mask = a | b
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask).cast("bigint")), F.lit(at)))
    return F.array(*keys)


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings start with in common, by halving steps."""
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= most) & (F.left(a, found + step) == F.left(b, found + step)), found + step
        ).otherwise(found),
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


# Strings from this length on are cut before they are compared; shorter ones cost less as they are.
LONG_LINE = 500


def within_edits(a: Column, b: Column, allowed: Column) -> Column:
    """Whether two strings are within ``allowed`` edits; what long ones start and end with in common is cut first."""

    def middle(t: Column) -> Column:
        start = t["p"] + 1
        return F.struct(F.substr(t["a"], start).alias("a"), F.substr(t["b"], start).alias("b"))

    def test(t: Column) -> Column:
        rest_a, rest_b = (F.left(t[c], F.length(t[c]) - t["s"]) for c in "ab")
        few = F.abs(F.length(t["a"]) - F.length(t["b"])) <= allowed
        return few & (F.call_function("levenshtein", rest_a, rest_b, allowed) >= 0)

    def ends(t: Column) -> Column:
        turned = F.struct(t["a"].alias("a"), t["b"].alias("b"), F.reverse(t["a"]).alias("x"), F.reverse(t["b"]).alias("y"))
        return bound(turned, lambda r: bound(F.struct(r["a"].alias("a"), r["b"].alias("b"), common_prefix(r["x"], r["y"]).alias("s")), test))

    both = F.struct(a.alias("a"), b.alias("b"), common_prefix(a, b).alias("p"))
    plain = (F.abs(F.length(a) - F.length(b)) <= allowed) & (F.call_function("levenshtein", a, b, allowed) >= 0)
    return F.when(F.greatest(F.length(a), F.length(b)) < LONG_LINE, plain).otherwise(bound(both, lambda t: bound(middle(t), ends)))


def prefiltered(rows: DataFrame, asked: DataFrame, key: str, plain: bool = True) -> DataFrame:
    """``rows`` without most of those whose key is not among ``asked``, by a Bloom filter; a join has to follow.

    It saves shuffling what the join would drop.  Where the filter would be too large
    to send around, the join alone does it.
    """
    n = asked.count()
    if n * 10 // 8 > MAX_LEVEL_BYTES:
        return rows
    level = bloom(asked.select(F.col(key).alias("key")), n, 0.01, 0)
    return rows.filter(level.might_contain(F.col(key), plain))


def bitmap(asked: DataFrame, key: Column) -> np.ndarray | None:
    """Bits that let every asked key (a long) through and few others; None where they would be too large to send around."""
    n = asked.count()
    bits = min(1 << max(10, (16 * n).bit_length()), BITMAP_BITS)
    if n > bits // 2:
        return None
    bit = key.bitwiseAND(F.lit(bits - 1).cast("long"))
    with shuffles_dropped(asked.sparkSession):
        words = (
            asked.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("value")).toArrow()
        )
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy().view(np.uint64)
    return out


def let_through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64) the bitmap lets through."""
    at = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def line_codes(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, codes)`` of the nodes asked for; only their texts (node, norm) are shuffled."""
    bits = bitmap(asked, F.xxhash64("node"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch
            if bits is not None:
                kept = batch.filter(pa.array(let_through(bits, batch.column(2).to_numpy(zero_copy_only=False))))
            codes = _word_codes(*word_hashes(kept.column(1))) if kept.num_rows else []
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(codes, pa.string())], names=["node", "codes"])

    coded = texts.select("node", "norm", F.xxhash64("node").alias("key")).mapInArrow(code, "node long, codes string")
    return coded.join(asked, "node", "left_semi")


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of nodes whose lines are similar enough: 1 - edited words / words of the longer line.

    No more pairs than lines (or ``PAIRS_AT_ONCE``) are joined with the lines at once,
    so that what is shuffled at a time grows with the lines and not with their pairs.
    """
    texts = stored(texts, "line-codes", "zstd")
    left, right = (texts.select(F.col("node").alias(c), F.col("codes").alias(f"{t}_text")) for c, t in (("x", "a"), ("y", "b")))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = math.ceil(pairs.count() / max(texts.count(), PAIRS_AT_ONCE)) or 1
    longer = F.greatest(F.length("a_text"), F.length("b_text"))
    allowed = F.floor(longer * (1 - similarity) + 1e-9).cast("int")
    links = []
    for part in range(parts):
        some = pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("x", "y"), F.lit(parts)) == part)
        # Pairs are few bytes and much work, so they are dealt over all tasks by number, not by size.
        both = some.join(right, "y").repartition(tasks, "x").join(left.repartition(tasks, "x"), "x")
        similar = both.filter(within_edits(F.col("a_text"), F.col("b_text"), allowed))
        links.append(stored(similar.select(F.col("x").alias("a"), F.col("y").alias("b")), "line-links"))
    return functools.reduce(DataFrame.union, links)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``similar_pairs`` with the codes of the lines (node, norm) asked for."""
    pairs = cut_lineage(pairs.distinct())
    asked = cut_lineage(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct())
    return similar_pairs(pairs, line_codes(asked, texts), similarity)


def _byte_values() -> np.ndarray:
    """What each byte adds to a word's hash; a space is no part of a word."""
    values = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(31)
    values[32] = 0
    return values


BYTE_VALUES = _byte_values()


def word_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some lines (words between single spaces), and the number of words of each line."""
    lines = lines.cast(pa.large_binary())
    _, offsets, data = lines.buffers()
    ends = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    filled = ends[1:] > ends[:-1]
    if not filled.any():
        return np.zeros(0, np.uint64), np.zeros(len(lines), np.int64)
    begins = np.concatenate([[False], raw == 32])
    begins[ends[:-1][filled]] = True
    starts = np.flatnonzero(begins[:-1])
    sizes = np.diff(np.searchsorted(starts, ends))
    # Polynomials in the place within the word, from those in the place within the batch: the factor is odd, so its powers divide.
    high, low = powers_of(0x9E3779B97F4A7C15, len(raw))
    values = (high[:, None] * low).ravel()[: len(raw)]
    values *= BYTE_VALUES[raw]
    high, low = powers_of(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(raw))
    hashes = np.add.reduceat(values, starts) * high[starts >> 12] * low[starts & 4095]
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31)), sizes


def grams_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of every pair of neighbouring words."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    inside = line[1:] == line[:-1]
    grams = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    grams ^= grams >> np.uint64(29)
    return line[:-1][inside], grams[inside]


def bags_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each line ``BAG_WORDS`` longs of bits, one bit per word: a word that two lines share sets it in both."""
    bags = np.zeros((BAG_WORDS, len(sizes)), np.int64)
    filled = sizes > 0
    if filled.any():
        starts = (np.cumsum(sizes) - sizes)[filled]
        at = words >> np.uint64(58)
        own = (words >> np.uint64(40)) % np.uint64(BAG_WORDS)
        for part in range(BAG_WORDS):
            bits = np.where(own == part, np.uint64(1) << at, np.uint64(0))
            bags[part, filled] = np.bitwise_or.reduceat(bits, starts).view(np.int64)
    return bags


def _word_codes(words: np.ndarray, sizes: np.ndarray) -> list[str]:
    """For each line a string with one character per word, so that edits of it are edits of words.

    The character is a hash of the word in 20 bits, beyond the basic plane: two
    different words look alike once in a million.
    """
    text = ((words >> np.uint64(44)) + np.uint64(1 << 16)).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def prefix_size(n_words: int, similarity: float) -> int:
    """How many of a line's first word pairs meet those of any similar line, of the same or another length."""
    longer = np.arange(n_words, math.ceil(n_words / similarity) + 2)
    edits = np.floor(longer * (1 - similarity) + 1e-9).astype(np.int64)
    fits = longer - edits <= n_words
    common = int((longer - 1 - 2 * edits)[fits].min())
    if common < 1 and n_words > 1:
        raise ValueError(f"lines of {n_words} words may be similar without two words in a row in common")
    return n_words - common


def common_grams(df: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the commonest word pairs in a sample of the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(grams_of(*word_hashes(batch.column(0)))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    n_docs = df.count()
    some = df.sample(min(1.0, SAMPLE_DOCS / n_docs), 1) if n_docs else df
    lines = every_line(some, id_col, text_col).select("norm")
    counted = lines.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    with shuffles_dropped(df.sparkSession):
        rows = counted.orderBy(F.desc("n"), "gram").limit(KNOWN_GRAMS).toArrow()
    grams, n = (rows.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(grams.view(np.uint64))
    return grams.view(np.uint64)[order], n[order]


def sorted_within(line: np.ndarray, n_lines: int, keys: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The order by line, count and key, by one number of as many of their bits as it holds; if that is too few, by all of them."""
    line_bits = n_lines.bit_length()
    count_bits = 0 if count is None or not len(count) else int(count.max()).bit_length()
    if line_bits + count_bits < 32:
        packed = line.astype(np.uint64) << np.uint64(64 - line_bits)
        if count_bits:
            packed |= count.astype(np.uint64) << np.uint64(64 - line_bits - count_bits)
        packed |= keys >> np.uint64(line_bits + count_bits)
        order = np.argsort(packed)
        packed, ordered = packed[order], keys[order]
        if not ((packed[1:] == packed[:-1]) & (ordered[1:] != ordered[:-1])).any():
            return order
    return np.lexsort((keys, line) if count is None else (keys, count, line))


def prefix_keys(
    words: np.ndarray, sizes: np.ndarray, known: tuple[np.ndarray, np.ndarray], min_words: int, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of each line's first word pairs, rarest first; lines of fewer than ``min_words`` words have none."""
    line, grams = grams_of(words, sizes)
    # A pair that stands in a line again is another one.
    order = sorted_within(line, len(sizes), grams)
    line, grams = line[order], grams[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (line[1:] != line[:-1])])[: len(grams)]
    heads = np.flatnonzero(new)
    again = np.arange(len(grams)) - np.repeat(heads, np.diff(np.append(heads, len(grams))))
    count = np.zeros(len(grams), np.int64)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], grams), len(known[0]) - 1)
        count = np.where(known[0][at] == grams, known[1][at], 0)
    keys = (grams + again.astype(np.uint64)) * np.uint64(0x165667B19E3779F9)
    keys ^= keys >> np.uint64(32)
    order = sorted_within(line, len(sizes), keys, count)
    line, keys = line[order], keys[order]
    per_line = np.bincount(line, minlength=len(sizes))
    place = np.arange(len(line)) - np.repeat(np.cumsum(per_line) - per_line, per_line)
    lengths, of = np.unique(sizes, return_inverse=True)
    most = np.array([prefix_size(int(n), similarity) if n >= min_words else 0 for n in lengths], np.int64)[of]
    kept = place < most[line]
    return line[kept], keys[kept].view(np.int64)


def pairs_under_keys(rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y), x above y, of the rows (node, key, size, bags) under one key that may be similar; some more than once.

    A key of more than ``PAIRWISE_KEY`` rows and ``FEW_PAIRS`` such pairs a row gives no pairs but itself, as x without y.
    """

    def chunks(here: list[np.ndarray], after: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs of each row from ``low`` to ``high`` with as many next ones as ``after`` says."""
        upto = np.concatenate([[0], np.cumsum(after[low:high])])
        first = 0
        while first < high - low:
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRED_AT_ONCE, "right")) - 1)
            n = after[low + first : low + last]
            if n.any():
                a = np.repeat(np.arange(low + first, low + last), n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                yield close_enough(here, a, b, similarity)
            first = last

    def as_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["x", "y"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [column.to_numpy() for column in batch.columns]
                columns = [np.concatenate(both) for both in zip(columns, new, strict=True)] if columns else new
            if not columns or not len(columns[0]):
                continue
            keys = columns[0]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            # The last key's rows may go on in the next batch.
            edges = edges if batch is None else edges[:-1]
            done = edges[-1]
            here, columns = [column[:done] for column in columns], [column[done:] for column in columns]
            nodes, sizes, counts = here[1], here[2].astype(np.int64), np.diff(edges)
            # Rows of a key are in the order of their sizes: those that are too long for a row come after those that are not.
            group = np.repeat(np.arange(len(counts)), counts) << 32
            longest = np.floor((sizes + 1e-6) / similarity).astype(np.int64)
            after = np.searchsorted(group + sizes, group + longest, "right") - np.arange(done) - 1
            large = counts > PAIRWISE_KEY
            for a, b in chunks(here, np.where(np.repeat(large, counts), 0, after), 0, done):
                yield as_batch(nodes[a], nodes[b])
            for at in np.flatnonzero(large):
                found, n = [], 0
                for a, b in chunks(here, after, edges[at], edges[at + 1]):
                    found.append((nodes[a], nodes[b]))
                    n += len(a)
                    if n > FEW_PAIRS * counts[at]:
                        found = []
                        yield pa.RecordBatch.from_arrays([pa.array(here[0][edges[at] : edges[at] + 1]), pa.nulls(1, pa.int64())], names=["x", "y"])
                        break
                yield from itertools.starmap(as_batch, found)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "node", "size", *[c for c in rows.columns if c.startswith("bag")]).repartition(tasks, "key")
    return dealt.sortWithinPartitions("key", "size").mapInArrow(pair, "x long, y long")


def close_enough(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places ``a`` and ``b`` in ``rows`` (key, node, size, bags) whose sizes and bags lie no further apart than edits allow."""
    sizes = rows[2]
    allowed = np.floor(np.maximum(sizes[a], sizes[b]) * (1 - similarity) + 1e-9)
    kept = (np.abs(sizes[a] - sizes[b]) <= allowed) & (rows[1][a] != rows[1][b])
    a, b, allowed = a[kept], b[kept], allowed[kept]
    bags = [bag.view(np.uint64) for bag in rows[3:]]
    # Each word of one line that the other has not is an edit of its own.
    for _ in range(2):
        kept = sum(np.bitwise_count(bag[a] & ~bag[b]).astype(np.int64) for bag in bags) <= allowed
        b, a, allowed = a[kept], b[kept], allowed[kept]
    return a, b


def similar_links(nodes: DataFrame, known: tuple[np.ndarray, np.ndarray], min_words: int, similarity: float) -> DataFrame:
    """Links (a, b) between ``nodes`` (node, norm) that connect what all similar pairs would."""
    texts = nodes.select("node", "norm").filter(F.col("norm") != "")

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, keys = prefix_keys(*word_hashes(batch.column(0)), known, min_words, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    counts = texts.select("norm").mapInArrow(only_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.filter(F.col("n") > 1), "line-key-counts")
    huge = repeated.filter(F.col("n") > MOST_ROWS).select("key")
    huge_keys = huge.toArrow().column("key").to_numpy()
    n_keys, n_rows = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("norm")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(n_rows * ROW_BYTES / max(n_bytes, LEAST_BYTES)), math.ceil(n_keys / KEYS_AT_ONCE))

    def members(let: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, sizes = word_hashes(batch.column(1))
                line, keys = prefix_keys(words, sizes, known, min_words, similarity)
                kept = let(keys)
                line, keys = line[kept], keys[kept]
                bags = bags_of(words, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(line)), pa.array(keys), pa.array(sizes[line].astype(np.int32)), *[pa.array(b[line]) for b in bags]],
                    names=["node", "key", "size", *bag_names],
                )

        return texts.mapInArrow(list_keys, "node long, key long, size int, " + ", ".join(f"{b} long" for b in bag_names))

    def in_part(rows: DataFrame, part: int) -> DataFrame:
        # By bits that the bitmaps do not go by.
        return rows.filter(F.pmod(F.shiftright("key", 40), F.lit(parts)) == part)

    def usual_rows(part: int) -> DataFrame:
        bits = bitmap(in_part(repeated, part).select("key"), F.col("key"))

        def let(keys: np.ndarray) -> np.ndarray:
            # A key that the bits let through by chance stands alone and makes no pair.
            kept = (keys >> 40) % parts == part
            if bits is not None:
                kept &= let_through(bits, keys)
            return kept & ~np.isin(keys, huge_keys) if len(huge_keys) else kept

        return members(let)

    bag_names = [f"bag{n}" for n in range(BAG_WORDS)]
    # The rows of the usual keys are many: they are shuffled once and not written before.  Those of crowded keys are.
    found = [stored(pairs_under_keys(usual_rows(part), similarity).distinct(), "line-pairs") for part in range(parts)]
    both = functools.reduce(DataFrame.union, found)
    crowded = stored(both.filter(F.col("y").isNull()).select(F.col("x").alias("key")).union(huge), "line-crowded-keys")
    pairs = both.filter(F.col("y").isNotNull())
    pairs = pairs if parts == 1 else stored(pairs.distinct(), "line-pairs")

    def may_be_similar(a: str, b: str) -> Column:
        longer = F.greatest(f"{a}size", f"{b}size")
        allowed = F.floor(longer * (1 - similarity) + 1e-9)
        left, right = (
            sum((F.bit_count(F.col(x + bag).bitwiseAND(F.bitwise_not(F.col(y + bag)))) for bag in bag_names), F.lit(0))
            for x, y in ((a, b), (b, a))
        )
        # Each word of one line that the other has not is an edit of its own.
        return (F.abs(F.col(f"{a}size") - F.col(f"{b}size")) <= allowed) & (left <= allowed) & (right <= allowed)

    def decided(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        return similar_pairs(pairs, line_codes(stored(asked, "line-asked"), texts), similarity)

    # Each line with its first neighbour, then only what that leaves in different groups.
    first = stored(pairs.groupBy("x").agg(F.min("y").alias("y")), "line-pairs")
    links = decided(first)
    groups = components(links)
    roots = [groups.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "xy"]
    apart = pairs.join(roots[0], "x", "left").join(roots[1], "y", "left").filter(F.coalesce("x_root", "x") != F.coalesce("y_root", "y"))
    links = links.union(decided(stored(apart.select("x", "y").join(first, ["x", "y"], "left_anti"), "line-pairs")))
    if crowded.isEmpty():
        return links
    crowd_bits = bitmap(crowded, F.col("key"))
    many = members(lambda keys: np.ones(len(keys), bool) if crowd_bits is None else let_through(crowd_bits, keys))
    bag = F.struct(*bag_names).alias("bag")
    many = stored(many.join(crowded, "key", "left_semi").select("key", F.col("node").alias("digest"), F.struct("size", bag).alias("size")), "line-crowds")

    def verified(pairs: DataFrame) -> DataFrame:
        flat = pairs.select(
            F.col("a").alias("x"), F.col("b").alias("y"),
            *[F.col(f"{c}_size.size").alias(f"{c}_size") for c in "ab"], *[F.col(f"{c}_size.bag.{b}").alias(f"{c}_{b}") for c in "ab" for b in bag_names],
        )
        return decided(stored(flat.filter(may_be_similar("a_", "b_")).select("x", "y").distinct(), "line-pairs"))

    return links.union(links_under_keys(many, verified))


def fuzzy_links(nodes: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) between ``nodes`` (node, fp) that connect what all similar pairs would."""
    points = nodes.select("node", "fp", F.explode(block_keys(F.col("fp"), k)).alias("key"))
    repeated = cut_lineage(points.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    shared = stored(prefiltered(points, repeated, "key").join(repeated, "key"), "line-keys")

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= k

    heads = shared.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("head"))
    first = (
        shared.join(heads, "key")
        .filter((F.col("node") != F.col("head.node")) & near("fp", "head.fp"))
        .select(F.col("node").alias("x"), F.col("head.node").alias("y"))
    )
    links = cut_lineage(verified(first, texts, similarity))
    joined = components(links).withColumnRenamed("node", "root_of")
    crowded = shared.filter(F.col("n") > 2).join(joined, shared["node"] == joined["root_of"], "left").select(
        "key", "node", "fp", F.coalesce("root", "node").alias("group")
    )
    crowded = cut_lineage(crowded)
    split = crowded.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
    left, right = (crowded.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "fp", "group")]) for s in "ab")
    second = (
        left.join(split.select("key"), "key", "left_semi").join(right, "key")
        .filter((F.col("a_group") > F.col("b_group")) & near("a_fp", "b_fp"))
        .select(F.col("a_node").alias("x"), F.col("b_node").alias("y"))
    )
    return links.union(verified(second, texts, similarity))


def line_nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, digest, first, n, norm)``: every different line once, with its first occurrence (doc, line) and their number.

    Occurrences are combined before the shuffle, so a line that stands in every
    document is a few rows of each task.
    """
    lines = every_line(df, id_col, text_col)
    found = lines.groupBy("digest").agg(
        F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("norm").alias("norm")
    )
    return stored(found.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "n", "norm"), "line-nodes", "zstd")


def repeated_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 5,
    k: int | None = None,
    similarity: float = 0.8,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``(doc, line, keep_doc, keep_line)``: every line to remove, with the occurrence of its group that stays.

    ``doc`` and ``keep_doc`` are (``id``, ``text``): the row's id and a key of its text, so
    rows that share an id but not the text are documents of their own; rows
    repeated with id and text count as one.  Lines are numbered from 0 and end at line
    feeds.  The occurrence with the smallest (doc, line) stays.

    Lines that are not blank go if they are equal: once normalised, or, without
    letters, as they are.  Of ``min_words`` words on they also go if they are similar:
    edits of words over the words of the longer line are at most 1 - ``similarity``.  All
    such pairs are linked, or, with ``k``, those whose fingerprints are within ``k`` bits.
    Rows without an id take no part.
    """
    nodes = line_nodes(df, id_col, text_col)
    texts = nodes.select("node", "norm").filter(F.length("norm") - F.length(F.replace("norm", F.lit(" "))) >= min_words - 1)
    if k is None:
        links = similar_links(texts, common_grams(df, id_col, text_col), min_words, similarity)
    else:
        long_enough = texts.filter(F.col("norm") != "")
        links = fuzzy_links(cut_lineage(with_simhash(long_enough)), long_enough, k, similarity)
    groups = components(links).withColumnRenamed("node", "member")
    grouped = stored(
        nodes.select("node", "digest", "first", "n").join(groups, F.col("node") == F.col("member"), "left")
        .filter((F.col("n") > 1) | F.col("root").isNotNull())
        .select("digest", "first", "n", F.coalesce("root", "node").alias("group")),
        "line-groups",
    )
    keep = grouped.groupBy("group").agg(F.min("first").alias("keep"))
    labels = grouped.join(keep, "group").select("digest", "keep")
    lines = every_line(df, id_col, text_col).select("doc", "line", "digest")
    frequent = heavy_keys(grouped, ["digest"], "n", rows_per_salt)
    return (
        salted_lookup(lines, labels, ["digest"], frequent, ["digest"], ["doc", "line"], "inner")
        .filter(F.struct("doc", "line") != F.col("keep"))
        .select("doc", "line", F.col("keep.doc").alias("keep_doc"), F.col("keep.line").alias("keep_line"))
    )


def drop_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, k: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """``df`` without the repeated lines; a document that loses all its lines goes as well.

    Other columns stay as they are.  Texts that lose nothing are unchanged, null and
    empty ones too, and rows without an id.  No text goes because another has its id.
    """
    gone = (
        repeated_lines(df, id_col, text_col, min_words, k, similarity)
        .groupBy("doc").agg(F.collect_set("line").alias("_gone"))  # of one text
    )
    # The lines are cut before the join, so that they are cut once a text; other columns travel in a struct, whatever their names.
    others = [c for c in df.columns if c != text_col]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(id_col).alias("id"),
        text_key(F.col(text_col)).alias("text"),
        F.split(F.col(text_col), "\n", -1).alias("parts"),
    )
    joined = rows.join(gone, (rows["id"] == gone["doc.id"]) & (rows["text"] == gone["doc.text"]), "left")
    every = F.sequence(F.lit(0), F.size("parts") - 1)
    left = joined.select("row", "parts", F.when(F.col("_gone").isNotNull(), F.array_except(every, F.col("_gone"))).alias("kept"))
    kept = F.transform("kept", lambda i: F.get(F.col("parts"), i))
    text = F.array_join(F.when(F.col("kept").isNull(), F.col("parts")).otherwise(kept), "\n")
    return left.filter(F.col("kept").isNull() | (F.size("kept") > 0)).select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns]
    )


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line of the documents, with the occurrence that stays for it."""
    return repeated_lines(table(spark, sf_dir, "documents")).select(
        F.col("doc.id").alias("doc_id"), "line", F.col("keep_doc.id").alias("keep_doc_id"), "keep_line"
    )
