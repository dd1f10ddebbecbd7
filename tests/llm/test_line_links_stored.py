"""Large tables of line dedup are written compressed, not as checkpoints, which hold every row serialised as it is."""

from hushframe.llm import line_dedup


def test_key_counts_and_pairs_are_no_checkpoints(spark, monkeypatch):
    checkpoints, written = [], []
    cut, stored = line_dedup.cut_lineage, line_dedup.stored
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df: checkpoints.append(set(df.columns)) or cut(df))
    monkeypatch.setattr(line_dedup, "stored", lambda df, *rest: written.append(set(df.columns)) or stored(df, *rest))
    line = "one two three four five six seven eight nine ten"
    rows = [(1, line), (2, line.replace("five", "fave")), (3, "quite another line of seven words here")]
    gone = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(row.doc.id, row.line, row.keep_doc.id) for row in gone] == [(2, 0, 1)]
    for columns in ({"key", "n"}, {"x", "y"}, {"node", "codes"}):
        assert columns in written
        assert columns not in checkpoints
