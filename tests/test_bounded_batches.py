"""Python code in tasks holds a few rows at a time, whatever the size of Spark's batches; inputs of few splits use every core."""

import pyarrow as pa

from hushframe.operators import literals
from hushframe.plans import queries, samples
from hushframe.sources import office


def test_office_files_are_packed_and_parsed_in_slices(monkeypatch):
    texts = [f"line {n}\nend" for n in range(1_000)]
    rows = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(1_000)]), pa.array(texts)], names=["path", "text"])
    packed = list(samples.pack_docx(iter([rows])))
    assert max(b.num_rows for b in packed) <= samples.FILES_AT_ONCE
    whole = pa.Table.from_batches(packed).combine_chunks().to_batches()
    parsed = list(office.parse_docx(iter(whole)))
    assert max(b.num_rows for b in parsed) <= office.FILES_AT_ONCE
    assert [t for b in parsed for t in b.column(1).to_pylist()] == [t.replace("\n", "\n\n") + "\n\n" for t in texts]
    cells = [["Name"], ["x"]]
    books = [samples.xlsx_bytes({"A": cells, "B": cells}), b"broken", samples.xlsx_bytes({"C": cells})]
    (got,) = office.parse_xlsx(iter([pa.RecordBatch.from_arrays([pa.array(["1", "2", "3"]), pa.array(books)], names=["path", "content"])]))
    assert got.select(["path", "sheet"]).to_pylist() == [
        {"path": "1", "sheet": "A"}, {"path": "1", "sheet": "B"}, {"path": "2", "sheet": None}, {"path": "3", "sheet": "C"},
    ]


def test_literal_candidates_leave_the_task_in_slices(spark, monkeypatch):
    monkeypatch.setattr(literals, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(literals, "CANDIDATES_AT_ONCE", 7)
    rows = spark.createDataFrame([(n, "ab ä ab " * n) for n in range(20)], "id long, text string").coalesce(1)
    words = spark.createDataFrame([("ab",), ("ä ab",)], "value string")
    got = sorted((r["id"], r["start"], r["value"]) for r in literals.find_literals(rows, ["id"], words, word_bounded=True).collect())
    want = [(n, 8 * i + at, v) for n in range(20) for i in range(n) for at, v in ((0, "ab"), (5, "ab"), (3, "ä ab"))]
    assert got == sorted(want)


def test_tables_of_one_split_use_every_core(spark, tmp_path):
    spark.createDataFrame([(1, "n")], "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    plan = queries.QUERIES["xlsx_text"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(c_custkey" in plan
