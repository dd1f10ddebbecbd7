"""Connected components by rewiring every node to the smallest neighbour until only stars are left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, stored

MAX_ROUNDS = 100


def rewire(edges: DataFrame, both_sides: bool) -> DataFrame:
    """One half round over edges (a, b) with a > b.

    With ``both_sides`` every larger neighbour of a node goes to the node's
    smallest neighbour; otherwise the node and its smaller neighbours do.  The
    smallest neighbours come from an aggregation and go back by a join, so no
    node's neighbours are gathered in one place.
    """
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if both_sides:
        near = near.union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = near.groupBy("node").agg(F.min("other").alias("low"))
    if both_sides:
        moved = near.filter(F.col("other") > F.col("node")).join(least, "node").select(
            F.col("other").alias("a"), F.least("low", "node").alias("b")
        )
    else:
        moved = (
            near.join(least, "node").filter(F.col("other") != F.col("low")).select(F.col("other").alias("a"), F.col("low").alias("b"))
            .union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b), the root being the smallest node it reaches.

    Self-links and repeated or turned links do no harm; no links give no rows.
    """
    state = cut_lineage(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    known = None
    for _ in range(MAX_ROUNDS):
        sign = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == known:
            break
        known = sign
        state = cut_lineage(rewire(rewire(state, True), False))
    else:
        raise RuntimeError("the components do not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b"), F.col("b")).distinct()
    )


def links_under_keys(shared: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect what all verified pairs under the keys of ``shared`` (key, digest, size) would.

    ``verified`` takes pairs (a, a_size, b, b_size) and gives those (a, b) that are links.
    Under each key all members are compared with one head first, then with one member of
    another group, and only what is in different groups after that pair by pair.
    """

    def split(links: DataFrame) -> DataFrame:
        """The members of the keys that still hold different groups."""
        joined = components(links)
        members = shared.join(joined, shared["digest"] == joined["node"], "left").select(
            "key", F.coalesce("root", "digest").alias("group"), "digest", "size"
        )
        members = stored(members, "members")
        mixed = members.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
        return members.join(mixed.select("key"), "key", "left_semi")

    def with_head(members: DataFrame, head: Column) -> DataFrame:
        heads = members.groupBy("key").agg(head.alias("head"))
        return members.join(heads, "key").select(
            F.col("digest").alias("a"), F.col("size").alias("a_size"), F.col("head.digest").alias("b"),
            F.col("head.size").alias("b_size"), *[F.col(c) for c in members.columns if c == "group"], "head",
        )

    links = verified(with_head(shared, F.min(F.struct("digest", "size"))).filter("a <> b"))
    members = split(links)
    links = links.union(
        verified(with_head(members, F.max(F.struct("group", "digest", "size"))).filter(F.col("group") != F.col("head.group")))
    )
    members = stored(split(links), "members")
    left, right = (
        members.select("key", F.col("group").alias(f"{c}_group"), F.col("digest").alias(c), F.col("size").alias(f"{c}_size"))
        for c in "ab"
    )
    return links.union(verified(left.join(right, "key").filter("a_group > b_group")))
