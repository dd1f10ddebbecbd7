"""Line dedup's disk: unlike long lines are no candidates, keys and pairs are gone through in parts, crowds are not paired."""

import itertools

import numpy as np
import pyarrow as pa

from hushframe.llm import line_dedup


def test_unlike_long_lines_are_no_candidates():
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + n // 676)}{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}" for n in range(2000)]
    lines = [" ".join(rng.choice(names, 200, replace=False)) for _ in range(12)]
    bags = line_dedup.bags_of(*line_dedup.word_hashes(pa.array(lines)))
    rows = [np.zeros(12, np.int64), np.arange(12), np.full(12, 200, np.int32), *bags]
    a, b = (np.array(places) for places in zip(*itertools.combinations(range(12), 2), strict=True))
    assert not len(line_dedup.close_enough(rows, a, b, 0.8)[0])


def test_pairs_are_joined_with_their_lines_a_part_at_a_time(spark, monkeypatch):
    written = []
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, *rest: written.append(set(df.columns)) or stored(df, *rest))
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 10)
    codes = [(n, "abcdefghij"[: n % 10] + "z" * (10 - n % 10)) for n in range(20)]
    pairs = [(a, b) for a, b in itertools.product(range(20), repeat=2) if a > b]
    links = line_dedup.similar_pairs(spark.createDataFrame(pairs, "x long, y long"), spark.createDataFrame(codes, "node long, codes string"), 0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a, b in pairs if abs(a % 10 - b % 10) <= 2}
    assert written.count({"a", "b"}) == 10  # 190 pairs, 20 lines


def test_keys_are_gone_through_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_BYTES", 1)
    paired, found = [], line_dedup.pairs_under_keys
    monkeypatch.setattr(line_dedup, "pairs_under_keys", lambda rows, *rest: paired.append(rows) or found(rows, *rest))
    words = [f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(400)]
    lines = [" ".join([*words[n % 9 * 30 : n % 9 * 30 + 19], words[300 + n]]) for n in range(45)]
    gone = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {(r.doc.id, r.keep_doc.id) for r in gone} == {(n, n % 9) for n in range(9, 45)}
    assert len(paired) > 1
    keys = [{r.key for r in rows.select("key").collect()} for rows in paired]
    assert all(keys)
    assert sum(map(len, keys)) == len(set().union(*keys))


def test_crowds_of_similar_lines_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRWISE_KEY", 20)
    alike = [(n, 1, 30, 7, 7) for n in range(40)]
    unlike = [(100 + n, 2, 30, (1 << 40) - 1 << n // 2, ((1 << 10) - 1) << 10 * (n // 2 % 5)) for n in range(40)]
    rows = spark.createDataFrame(alike + unlike, "node long, key long, size int, bag0 long, bag1 long")
    found = {(r.x, r.y) for r in line_dedup.pairs_under_keys(rows, 0.8).collect()}
    assert {pair for pair in found if pair[1] is None} == {(1, None)}
    assert found - {(1, None)} >= {(101 + n, 100 + n) for n in range(0, 40, 2)}
    assert all(x >= 100 for x, y in found if y is not None)
