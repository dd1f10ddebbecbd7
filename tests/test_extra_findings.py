"""Dictionaries of any size, detectors of the user's, literal search, and audits of shared vaults."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.operators import detect, literals, mask, report, reveal
from hushframe.operators.detector import with_detector

WORDY = re.compile(r"[A-Za-z0-9_]|[^\x00-\x7F]")


def brute_places(rows, strings, word_bounded):
    out = set()
    for i, text in rows:
        for value in set(strings):
            at = (text or "").find(value) if value else -1
            while value and at >= 0:
                end = at + len(value)
                before, after = text[at - 1 : at] if at else "", text[end : end + 1]
                tied = (WORDY.match(before) and WORDY.match(value[0])) or (WORDY.match(after) and WORDY.match(value[-1]))
                if not (word_bounded and tied):
                    out.add((i, at, end, value))
                at = text.find(value, at + 1)
    return sorted(out)


def found_places(spark, rows, strings, word_bounded, **kwargs):
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    table = spark.createDataFrame([(s,) for s in strings], "value string")
    got = literals.find_literals(df, ["id"], table, word_bounded=word_bounded, **kwargs)
    return sorted((r["id"], r["start"], r["end"], r["value"]) for r in got.collect())


TEXT = st.text(alphabet="ab é中.😀_\n", max_size=40)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.lists(st.one_of(st.none(), st.text(alphabet="ab é中.😀", max_size=9)), max_size=12), st.booleans())
def test_places_against_brute_force(spark, texts, strings, word_bounded):
    rows = list(enumerate(texts))
    assert found_places(spark, rows, strings, word_bounded) == brute_places(rows, [s for s in strings if s], word_bounded)


@pytest.mark.parametrize("word_bounded", [True, False])
def test_long_texts_in_parts_and_salted_keys(spark, monkeypatch, word_bounded):
    monkeypatch.setattr(literals, "BYTES_AT_ONCE", 64)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["é", "ab", "abc", "中文x", "a-b"], k=rng.choice([1, 30, 400])))) for i in range(6)]
    strings = ["ab", "abc ab", "中文x", "é é", "a-b", "b", "ab abc é", "no such", "é " * 30]
    assert found_places(spark, rows, strings, word_bounded, rows_per_salt=5) == brute_places(rows, strings, word_bounded)


def test_window_hashes_are_those_of_the_bytes():
    raw = np.frombuffer(b"abcabcabcabcxyz", np.uint8)
    for width, hashes in literals.window_hashes(raw, [1, 2, 4, 8]):
        assert len(hashes) == len(raw) - width + 1
        by_window = {}
        for at, value in enumerate(hashes.tolist()):
            assert by_window.setdefault(raw[at : at + width].tobytes(), value) == value
        assert len(set(by_window.values())) == len(by_window)


NAMES = [("José García", "NAME"), ("Wei Zhang", "NAME"), ("Ludwig van Beethoven", "NAME"), ("García", "NAME"), ("St. Louis", "LOCATION"), ("Winston-Salem", "LOCATION"), ("Łódź", "LOCATION")]


def test_names_and_places_of_a_table_are_masked(spark):
    text = "met José García and Wei Zhang in St. Louis, then Ludwig van Beethoven (Winston-Salem, Łódź); not Wei Zhangs; mail a@b.io García"
    df = spark.createDataFrame([(1, text), (2, None), (3, "nobody here"), (4, "")], "id long, text string")
    dictionary = spark.createDataFrame(NAMES + NAMES, "phrase string, label string")
    rows = detect.with_dictionary(df, ["id"], dictionary)
    masked = mask.sanitize(rows, extra="dictionary_findings")
    got = {r["id"]: r for r in masked.collect()}
    assert got[1]["masked_text"] == (
        "met [NAME_1] and [NAME_2] in [LOCATION_1], then [NAME_3] ([LOCATION_2], [LOCATION_3]); not Wei Zhangs; mail [EMAIL_1] [NAME_4]"
    )
    assert got[2]["masked_text"] is None and got[3]["masked_text"] == "nobody here"
    for row in rows.collect():
        for finding in row["dictionary_findings"] or []:
            assert row["text"][finding["start"] : finding["end"]] == finding["value"]
    scoped, numbers = mask.sanitize_scope(rows, ["id"], ["id"], extra="dictionary_findings", broadcast_bytes=0)
    assert {r["id"]: r["masked_text"] for r in scoped.collect()} == {i: r["masked_text"] for i, r in got.items()}
    assert numbers.filter("entity_type = 'LOCATION'").count() == 3


def test_a_dictionary_of_a_million_phrases(spark):
    dictionary = spark.range(1_000_000).select(F.concat(F.lit("Person"), "id", F.lit(" von Ort"), "id").alias("phrase"), F.lit("NAME").alias("label"))
    rows = [(i, f"here Person{i * 1000} von Ort{i * 1000}, not Person{i} von Ort{i + 1} but Person{i} von Ort{i}.") for i in range(1, 300)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = mask.sanitize(detect.with_dictionary(df, ["id"], dictionary), rules=[], extra="dictionary_findings")
    assert {r["masked_text"] for r in got.collect()} == {f"here [NAME_1], not Person{i} von Ort{i + 1} but [NAME_2]." for i in range(1, 300)}


def test_labels_that_no_placeholder_carries_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(Exception, match="cannot carry"):
        detect.with_dictionary(df, ["id"], spark.createDataFrame([("x", "A B")], "phrase string, label string")).collect()


def test_a_detector_joins_the_rules(spark):
    def capitals(texts):
        return [[(m.start(), m.end(), "SHOUT") for m in re.finditer(r"\b[A-Z]{3,}\b", text)] for text in texts]

    df = spark.createDataFrame([(1, "é HELLO mail ann@a.io WORLD HELLO"), (2, None), (3, "quiet")], "id long, text string")
    rows = with_detector(df, capitals, texts_at_once=1)
    got = {r["id"]: r["masked_text"] for r in mask.sanitize(rows, extra="detector_findings", exclusions=["WORLD"]).collect()}
    assert got == {1: "é [SHOUT_1] mail [EMAIL_1] WORLD [SHOUT_1]", 2: None, 3: "quiet"}
    plan = mask.sanitize(rows, extra="detector_findings")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    without = mask.sanitize(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in without


@pytest.mark.parametrize("answer", [[[(0, 99, "X")]], [[(2, 2, "X")]], [[(0, 1, "A B")]], [], [[], []]])
def test_wrong_answers_of_a_detector_are_errors(spark, answer):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    with pytest.raises(Exception, match="finding in a text|answers for"):
        with_detector(df, lambda texts: answer).collect()


def test_bare_values_left_in_masked_texts_are_reported(spark):
    vault = spark.createDataFrame(
        [("s", "[NAME_1]", "NAME", "Smith"), ("s", "[NAME_2]", "NAME", "1"), ("t", "[NAME_1]", "NAME", "Jones"), ("s", "[EMAIL_1]", "EMAIL", "a@b.io"), ("s", "[X_1]", "X", None)],
        "session_id string, token string, entity_type string, value string",
    )
    rows = [(1, "s", "[NAME_1] and xSmithy Jones"), (2, "t", "Smith but [NAME_1]"), (3, "t", "a Jones"), (4, "s", None), (5, None, "Smith")]
    masked = spark.createDataFrame(rows, "id long, s string, masked_text string")
    found = report.vault_value_leaks(masked, vault, ["id"], "s")
    assert sorted(map(tuple, found.collect())) == [(1, 14, 19, "NAME", "Smith"), (3, 2, 7, "NAME", "Jones")]
    audit = report.vault_leak_audit(masked, vault, "s")
    assert sorted(map(tuple, audit.collect())) == [("EMAIL", 1, 0), ("NAME", 3, 2)]
    everywhere = report.vault_leak_audit(masked, vault)
    assert sorted(map(tuple, everywhere.collect())) == [("EMAIL", 1, 0), ("NAME", 3, 2)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    values = ["".join(rng.choices("abé ", k=rng.randint(1, 7))) for _ in range(60)]
    vault = spark.createDataFrame([(rng.choice("st"), f"[N_{i}]", "N", v) for i, v in enumerate(values)], "session_id string, token string, entity_type string, value string")
    texts = [(i, rng.choice("st"), "".join(rng.choices(["a", "b", "é", " ", "[N_1]"], k=30))) for i in range(20)]
    masked = spark.createDataFrame(texts, "id long, s string, masked_text string")
    held = {(r["session_id"], r["value"]) for r in vault.collect()}
    token = re.compile(r"\[[^\[\] \t\r\n]+_\d+\]")
    expected = {(i, v) for i, s, t in texts for own, v in held if own == s and v in token.sub(lambda m: "\0" * len(m[0]), t)}
    got = report.vault_value_leaks(masked, vault, ["id"], "s")
    assert {(r["id"], r["value"]) for r in got.collect()} == expected


FAR = [
    "[EMAIL_999999999999999999] [EMAIL_1000000000000000000] x@y.io",
    "[EMAIL_999999999999999998] [EMAIL_1000000000000000001] [EMAIL_1000000000000000000] a@y.io b@y.io c@y.io d@y.io",
    "[EMAIL_99999999999999999999999] e@y.io",
    "[EMAIL_9223372036854775807] f@y.io [PHONE_1000000000000000000] 555-1234",
]


@pytest.mark.parametrize("session", [["s"], []])
@pytest.mark.parametrize("resumed", [False, True])
def test_no_number_that_stands_in_a_text_is_given_out(spark, session, resumed):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(FAR)], "id long, s string, text string")
    known = spark.createDataFrame([], "session_id string, token string, entity_type string, value string") if resumed else None
    masked, numbers = mask.sanitize_scope(df, ["id"], ["id"], session, vault=known)
    tokens = [r["token"] for r in numbers.filter("value IS NOT NULL").collect()]
    assert len(tokens) == len(set(tokens)) == 8
    assert not any(token in text for token in tokens for text in FAR)
    if resumed:
        vault = numbers.filter("value IS NOT NULL")
    else:
        from hushframe.operators.vault import as_vault
        vault = as_vault(numbers, session)
    rows = masked.withColumn("s", F.lit("s" if session else "corpus"))
    back = reveal.reveal(rows.drop("text"), vault, ["id"], "masked_text", "s")
    assert {r["id"]: r["revealed_text"] for r in back.collect()} == dict(enumerate(FAR))


def test_far_numbers_of_earlier_runs_are_stepped_over(spark):
    schema = "id long, s string, text string"
    known = spark.createDataFrame([], "session_id string, token string, entity_type string, value string")
    given_out = []
    for run, text in enumerate(["[EMAIL_999999999999999999] [EMAIL_1000000000000000002]", "a@y.io b@y.io", "c@y.io d@y.io a@y.io"]):
        _, added = mask.sanitize_scope(spark.createDataFrame([(run, "s", text)], schema), ["id"], ["id"], ["s"], vault=known)
        rows = added.collect()
        given_out += [r["token"] for r in rows if r["value"] is not None]
        known = known.unionByName(spark.createDataFrame(rows, known.schema))
    assert given_out == [f"[EMAIL_{n}]" for n in (10**18, 10**18 + 1, 10**18 + 3, 10**18 + 4)]
