"""Pairs of lines under common keys: made from one shuffle that nothing has written before, and none is lost."""

import itertools

import numpy as np

from hushframe.llm import line_dedup


def test_rows_under_keys_are_not_written(spark, monkeypatch):
    written = []
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, *rest: written.append(set(df.columns)) or stored(df, *rest))
    line = "one two three four five six seven eight nine ten"
    rows = [(1, line), (2, line.replace("five", "fave")), (3, "quite another line of seven words here")]
    gone = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(row.doc.id, row.line, row.keep_doc.id) for row in gone] == [(2, 0, 1)]
    assert not [columns for columns in written if {"node", "key", "size"} <= columns]


def test_pairs_are_those_of_all_rows_with_a_common_key(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRED_AT_ONCE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rng = np.random.default_rng(5)
        base = rng.integers(-(1 << 63), (1 << 63) - 1, 2)
        rows = [
            (node, int(rng.integers(40)), int(rng.integers(18, 24)), *[int(b ^ (1 << int(rng.integers(63)))) for b in base])
            for node in range(300)
        ]
        df = spark.createDataFrame(rows, "node long, key long, size int, bag0 long, bag1 long")
        got = {(r.x, r.y) for r in line_dedup.pairs_under_keys(df, 0.95).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for a, b in itertools.combinations(rows, 2):
        allowed = int(max(a[2], b[2]) * 0.05 + 1e-9)
        apart = [sum(bin((p & ~q) & ((1 << 64) - 1)).count("1") for p, q in zip(x[3:], y[3:], strict=True)) for x, y in ((a, b), (b, a))]
        if a[1] == b[1] and abs(a[2] - b[2]) <= allowed and max(apart) <= allowed:
            expected.add((b[0], a[0]))
    assert got == expected
    assert expected


def test_crowded_and_usual_keys_beside_each_other(spark, monkeypatch):
    words = [f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(400)]
    lines = [" ".join([*words[:9], words[20 + n]]) for n in range(30)] + [" ".join([*words[100:109], words[120 + n]]) for n in range(3)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def gone():
        return {(row.doc.id, row.keep_doc.id) for row in line_dedup.repeated_lines(df).collect()}

    expected = {(n, 0) for n in range(1, 30)} | {(31, 30), (32, 30)}
    assert gone() == expected
    monkeypatch.setattr(line_dedup, "PAIRWISE_KEY", 4)
    assert gone() == expected
    monkeypatch.setattr(line_dedup, "bitmap", lambda *_: None)
    assert gone() == expected
