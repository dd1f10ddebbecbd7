"""Streams read a table that is one file and one that is a folder of files alike."""

import pytest

from hushframe.plans import extended  # noqa: F401  (registers its queries)
from hushframe.plans.queries import QUERIES

TURNS = [(c, t, "user", f"turn {t} of {c}") for c in range(6) for t in range(2)]


@pytest.mark.parametrize("name", ["stream_reveal", "stream_session_mask", "stream_reveal_joined", "stream_mask_lines"])
def test_streams_read_folders_as_files(spark, tmp_path, name):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(d, f"mail a{d}@b.io") for d in range(6)], "doc_id long, text string")
    folder, flat = tmp_path / "folder", tmp_path / "flat"
    flat.mkdir()
    for table, rows in (("conversations", turns), ("documents", docs)):
        rows.repartition(3).write.parquet(str(folder / f"{table}.parquet"))
        rows.coalesce(1).write.parquet(str(tmp_path / table))
        (part,) = (tmp_path / table).glob("*.parquet")
        part.rename(flat / f"{table}.parquet")
    a, b = (sorted(tuple(r) for r in QUERIES[name](spark, str(at)).collect()) for at in (folder, flat))
    assert a == b and len(a) == (6 if name == "stream_mask_lines" else 12)
