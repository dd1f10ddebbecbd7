"""The pipeline's near-dedup goes through SimHash fingerprints and pivots; the sets decide."""

from pyspark.sql import functions as F

from hushframe.llm import simhash_pivots

WORDS = " ".join(f"w{n}" for n in range(3_000))


def nodes_of(df):
    sets = simhash_pivots.shingle_sets(df, "doc_id", "text", 5)
    return sets.withColumn("keys", F.array(F.xxhash64("digest"))).cache()  # no band in common


def test_pivots_give_candidates_that_share_no_band(spark):
    texts = [(1, WORDS), (2, WORDS + " end"), (3, "other " + WORDS[::-1]), (4, ""), (5, "a b")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = nodes_of(df)
    prints = {r["id"]: r["fp"] for r in nodes.collect()}
    assert bin((prints[1] ^ prints[2]) & (2**64 - 1)).count("1") <= 2
    assert prints == {r["doc_id"]: r["fp"] for r in simhash_pivots.fingerprints(df).collect()}
    ids = {bytes(r["digest"]): r["id"] for r in nodes.collect()}
    links = simhash_pivots.similar_links(nodes, df, "doc_id", "text", 5, 0.8).collect()
    assert {frozenset((ids[bytes(a)], ids[bytes(b)])) for a, b in links} == {frozenset((1, 2))}


def test_fingerprints_alone_do_not_link(spark):
    nodes = nodes_of(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string"))
    same = nodes.withColumn("fp", F.lit(7).cast("long"))
    assert simhash_pivots.fingerprint_pairs(same).count() == 1
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert simhash_pivots.similar_links(same, df, "doc_id", "text", 5, 0.8).count() == 0
