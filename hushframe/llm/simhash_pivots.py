"""Near-duplicate documents: 64-bit SimHash fingerprints, linked by pivot distance tables.

The Hamming distances of a fingerprint to fixed reference fingerprints (pivots) are its
coordinates.  Flipping one bit changes every coordinate by one, so fingerprints within
``k`` bits differ by at most ``k`` in each.  The pivots come in groups: those of group
``g`` differ from a base pivot only inside block ``g`` of the bits, so a fingerprint's
coordinates in that group (relative to the base) change only if a bit in that block does.
With ``k + 2`` blocks, two fingerprints within ``k`` bits have all coordinates of some two
groups in common: those are the candidates.  Candidates whose free coordinates differ by
more than ``k`` anywhere are discarded, and the Hamming distance decides on the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, query, stored, table, with_row_key, without_rows
from hushframe.llm.components import components, links_under_keys
from hushframe.llm.line_dedup import prefiltered

BITS = 64
FREE_PIVOTS = 8
# Fingerprints under one key that are compared with each other; larger keys go by midpoints, without loss.
PAIRWISE_KEY = 48
# Candidates of the similarity of shingle sets: 1 - (1 - 0.8**4)**24 of the pairs at 0.8 share a key.
BANDS, BAND_ROWS = 24, 4


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle, or of all words if fewer; empty without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)] or [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(x, 42) for x in shingles), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(hashes)).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id_col, fp)``, the fingerprint as a signed long; a text without words (null, too) has 0."""
    id_type = df.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(text.as_py() or "", shingle)) for text in batch.column(1)]
            values = np.array(found, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(hashed, f"`{id_col}` {id_type}, fp long")


def pivots(k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The base, the groups (one per block) and the free pivots.

    Inside its block a group's pivots flip the bits of Walsh patterns, half of the
    block each, which tell the contents of the block from the distances.
    """
    draw = np.random.default_rng(64)
    base = draw.integers(0, 2**63, 1, dtype=np.uint64)
    edges = np.linspace(0, BITS, k + 3).astype(int)
    groups = []
    for low, high in itertools.pairwise(edges):
        width = int(high - low)
        order = 1 << (width - 1).bit_length()
        masks = [
            sum(1 << (low + i) for i in range(width) if bin(i & row).count("1") % 2 == 0) for row in range(order)
        ]
        groups.append(base ^ np.array(masks, np.uint64))
    return base, groups, draw.integers(0, 2**63, FREE_PIVOTS, dtype=np.uint64)


def coordinate_table(nodes: DataFrame, k: int) -> DataFrame:
    """``(node, fp, keys, free)``: for each fingerprint, a key per pair of pivot groups, and the free coordinates, a byte each."""
    base, groups, free = pivots(k)
    multipliers = [np.random.default_rng(5 + i).integers(1, 2**63, len(g), dtype=np.uint64) | np.uint64(1) for i, g in enumerate(groups)]
    pairs = list(itertools.combinations(range(len(groups)), 2))
    node_type = nodes.schema["node"].dataType.simpleString()

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            to_base = np.bitwise_count(fp ^ base).astype(np.int64)
            tuples = []
            for group, factor in zip(groups, multipliers, strict=True):
                change = np.bitwise_count(fp[:, None] ^ group[None, :]).astype(np.int64) - to_base[:, None]
                tuples.append((change.astype(np.uint64) * factor).sum(axis=1, dtype=np.uint64))
            keys = np.empty((len(fp), len(pairs)), np.uint64)
            for at, (a, b) in enumerate(pairs):
                mixed = (tuples[a] * np.uint64(0x9E3779B97F4A7C15) + tuples[b]) * np.uint64(0xC2B2AE3D27D4EB4F)
                keys[:, at] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + np.uint64(at)
            distances = np.bitwise_count(fp[:, None] ^ free[None, :]).astype(np.uint8)
            offsets = np.arange(0, keys.size + 1, len(pairs), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                    pa.array(np.ascontiguousarray(distances).view(np.int64).ravel()),
                ],
                names=["node", "fp", "keys", "free"],
            )

    return nodes.select("node", "fp").mapInArrow(coordinates, f"node {node_type}, fp long, keys array<long>, free long")


def largest_difference_within(a: Column, b: Column, k: int) -> Column:
    """Whether the packed free coordinates differ by at most ``k`` in each."""
    test = F.lit(True)
    for at in range(FREE_PIVOTS):
        x, y = (F.shiftright(c, 8 * at).bitwiseAND(255) for c in (a, b))
        test = test & (F.abs(x - y) <= k)
    return test


def links_by_midpoint(members: DataFrame, k: int) -> DataFrame:
    """Links of all fingerprints within 2 bits by the values one flip away from both, in work linear in the members.

    Two values within two bits are each within one of a common value; every
    value's members are joined to the smallest of them.
    """
    if k != 2:
        raise ValueError("midpoints stand for 2 differing bits")
    flips = F.transform(F.sequence(F.lit(-1), F.lit(BITS - 1)), lambda i: F.when(i < 0, F.col("fp")).otherwise(
        F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    ))
    probes = members.select("node", F.explode(flips).alias("middle"))
    least = probes.groupBy("middle").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return probes.join(least, "middle").filter(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def near_links(nodes: DataFrame, k: int = 2, pairwise_key: int = PAIRWISE_KEY) -> DataFrame:
    """``(a, b)`` that connect all nodes ``(node, fp)`` within ``k`` bits as their links would; fingerprints are distinct.

    Keys with many fingerprints are not compared pair by pair: their members are
    linked by midpoints, which finds the same components.
    """
    points = cut_lineage(
        coordinate_table(nodes, k).select("node", "fp", "free", F.explode("keys").alias("key"))
    )
    sizes = points.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = cut_lineage(points.join(sizes, "key"))
    small = shared.filter(F.col("n") <= pairwise_key)
    left, right = (small.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "fp", "free")]) for side in "ab")
    pairs = left.join(right, "key").filter(
        (F.col("a_node") > F.col("b_node"))
        & largest_difference_within(F.col("a_free"), F.col("b_free"), k)
        & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= k)
    )
    crowded = shared.filter(F.col("n") > pairwise_key).select("node", "fp").distinct()
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).union(links_by_midpoint(crowded, k))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 2
) -> DataFrame:
    """One row per input row: ``id_col, fp, component_id`` (the smallest id reachable over links of at most ``k`` bits).

    Rows with one fingerprint are one node, so exact copies are never paired.  Texts
    without words all have fingerprint zero and link as any other.  Rows without an
    id take the component of their fingerprint; it is null only if no row of the
    component has an id.
    """
    rows = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("node")).filter(F.col("node").isNotNull()))
    roots = components(near_links(nodes, k))
    labels = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(labels, "fp", "left").select(id_col, "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 2) -> DataFrame:
    """``df`` with the row of the smallest id of each component; rows without an id stay.

    Rows that share an id but not the text are told apart; rows repeated with id and text
    stay or go together.
    """
    rows = with_row_key(df.select(id_col, text_col), id_col, text_col).filter(F.col("_row").isNotNull())
    found = near_duplicates(rows, "_row", text_col, shingle, k)
    return without_rows(df, found.filter(F.col("component_id") != F.col("_row")), id_col, text_col)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the smallest values of a set of hashes; two sets share each with probability similarity ** ``BAND_ROWS``."""
    draw = np.random.default_rng(24)
    turns = draw.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)
    factors = draw.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[at : at + (1 << 12), None] ^ turns) * factors).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(29)
    return keys


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a sorted set of shingle hashes."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, digest, size, fp, keys)``: each text's set of shingles by digest, its size, its fingerprint and its band keys (none without words)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py() or "", shingle)
                sets.append(np.unique(hashes))
                prints.append(majority(hashes))
            keys = [band_keys(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([set_digest(x) for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.array(prints, np.uint64).astype(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "digest", "size", "fp", "keys"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(hashed, f"id {id_type}, digest binary, size long, fp long, keys array<long>")


def sets_of(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(digest, hashes)``: the shingle sets of ``nodes`` (digest, id), from one text each; other texts are not shuffled."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                # Rows of one id may have other texts.
                sets = [np.unique(shingle_hashes(text.as_py() or "", shingle)) for text in part.column(1)]
                found = [(d, x) for d, x in zip(part.column(0).to_pylist(), sets, strict=True) if set_digest(x) == d]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in found], pa.binary()),
                        pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64())),
                    ],
                    names=["digest", "hashes"],
                )

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("_key"))
    texts = prefiltered(texts, nodes.withColumn("_key", F.xxhash64("id")), "_key").drop("_key")
    asked = nodes.join(texts, "id").select("digest", "text")
    return asked.mapInArrow(hashed, "digest binary, hashes array<long>").dropDuplicates(["digest"])


def fingerprint_pairs(nodes: DataFrame, k: int = 2) -> DataFrame:
    """Pairs (a, a_size, b, b_size) of ``nodes`` (digest, size, fp) by the pivots: one for each set whose fingerprint another has, and the links of the fingerprints."""
    heads = cut_lineage(nodes.groupBy("fp").agg(F.min(F.struct("digest", "size")).alias("head")))
    heads = heads.select("fp", F.col("head.digest").alias("node"), F.col("head.size").alias("node_size"))
    same = nodes.join(heads, "fp").filter(F.col("digest") != F.col("node")).select(
        F.col("digest").alias("a"), F.col("size").alias("a_size"), F.col("node").alias("b"), F.col("node_size").alias("b_size")
    )
    a, b = (heads.select(F.col("node").alias(c), F.col("node_size").alias(f"{c}_size")) for c in "ab")
    near = near_links(heads.select("node", "fp"), k).join(a, "a").join(b, "b").select("a", "a_size", "b", "b_size")
    return same.union(near)


def similar_links(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of digests of ``nodes`` (digest, id, size, fp, keys) that connect what all pairs of similar sets with a common key would.

    Sets whose fingerprints the pivots bring together are candidates first; the keys
    find those that two bits do not reach.  The sets decide on both.
    """
    near = cut_lineage(fingerprint_pairs(nodes))
    points = cut_lineage(nodes.select("digest", "size", F.explode("keys").alias("key")))
    repeated = points.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key")
    shared = cut_lineage(points.join(repeated, "key"))
    asked = shared.select("digest").union(near.select("a")).union(near.select("b")).distinct()
    sets = stored(
        sets_of(nodes.join(asked, "digest").select("digest", "id"), df, id_col, text_col, shingle),
        "shingle-sets",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(
            F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - 1e-9
        ).select("a", "b").distinct()
        left, right = (sets.select(F.col("digest").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "ab")
        common = F.size(F.array_intersect("a_set", "b_set"))
        either = F.size("a_set") + F.size("b_set") - common
        return cut_lineage(
            pairs.join(left, "a").join(right, "b").filter(common >= either * similarity - 1e-9).select("a", "b")
        )

    return verified(near).union(links_under_keys(shared, verified))


def keep_first_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``df`` with the row of the smallest id of each group linked by a Jaccard similarity of shingle sets of at least ``similarity``.

    Fingerprints of 64 bits do not reach that far: at 0.8 they differ in 9 bits on
    average, often in more than 15, and blocks short enough for that fit any text.  So
    the pivots give the candidates within 2 bits, and for the others candidates share
    the smallest shingle hashes in one of 24 bands of 4, which a pair at 0.8 misses 3
    times in a million; the sets themselves decide on all.  Equal sets
    (texts without words, too) are one node; rows without an id stay.  Rows that share
    an id but not the text are told apart; rows repeated with id and text stay or go together.
    """
    keyed = with_row_key(df.select(id_col, text_col), id_col, text_col).filter(F.col("_row").isNotNull())
    rows = cut_lineage(shingle_sets(keyed, "_row", text_col, shingle))
    nodes = cut_lineage(
        rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    )
    roots = components(similar_links(nodes, keyed, "_row", text_col, shingle, similarity))
    grouped = cut_lineage(
        nodes.join(roots, nodes["digest"] == roots["node"], "left")
        .select("digest", "id", F.coalesce("root", "digest").alias("group"))
    )
    keep = grouped.groupBy("group").agg(F.min("id").alias("keep"))
    labels = grouped.join(keep, "group").select("digest", "keep")
    dropped = rows.join(labels, "digest").filter(F.col("id") != F.col("keep")).select(F.col("id").alias("_row"))
    return without_rows(df, dropped, id_col, text_col)


@query("op3_simhash_pivots")
def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over 3-word shingles and its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, k=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
