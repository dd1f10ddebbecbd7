"""Queries over documents against their SQL where values touch letters outside ASCII."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from test_word_boundaries import TEXT

NAMES = (
    "corpus_vault custom_rules custom_rules_table entity_counts entity_counts_by_lang entity_profile"
    " entity_profile_merged findings_spans leak_audit mask_detector mask_document_scope mask_long_texts"
).split()
ROWS = [
    (1, TEXT, "fr", "src1"),
    (2, "Bob Stone von ümail3.example.com und 555-0101", "de", "src2"),
    (3, "ñ123-45-6789 y Bob Stoneé\nélan which é555-0101", "es", "src1"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("letters"))
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    rows.selectExpr("*", "cast(length(text) as bigint) AS n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_letters_beside_values(spark, folder, name):
    result = entry_point.queries()[name](spark, folder)
    columns = sorted(result.columns)
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        reply = duck.execute(entry_point.oracle_sql()[name])
        at = [[d[0] for d in reply.description].index(c) for c in columns]
        want = sorted((tuple(row[i] for i in at) for row in reply.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr) == want
