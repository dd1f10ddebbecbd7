"""Session numbers in the state store, versions of a vault, nested records, absent files."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from hushframe.operators import mask, nested
from hushframe.operators.vault import VaultConflict
from hushframe.operators.vault_store import VaultMoved, VaultStore, sanitize_into
from hushframe.sources import files
from hushframe.streaming import stateful

SCHEMA = "id long, session string, turn long, text string"
BATCHES = [
    [(1, "s", 1, "a@b.io and 10.0.0.1"), (2, "t", 1, "z@z.io [EMAIL_7]"), (3, None, 1, "n@n.io"), (9, "s", 0, "first@b.io")],
    [(4, "s", 2, "c@d.io then a@b.io"), (5, "t", 2, "y@y.io"), (10, "t", 3, None), (11, "w", 1, "[EMAIL_999999999999999999] [EMAIL_1000000000000000000]")],
    [(6, "s", 3, "e@f.io"), (7, "u", 1, "nothing"), (8, None, 2, "m@m.io n@n.io"), (12, "w", 2, "x@y.io [IP_1]")],
    [(13, "w", 3, "q@y.io x@y.io 10.0.0.2"), (14, "s", 4, "")],
]
EXPECTED = {
    9: "[EMAIL_1]", 1: "[EMAIL_2] and [IP_1]", 2: "[EMAIL_8] [EMAIL_7]", 3: "[EMAIL_1]", 4: "[EMAIL_3] then [EMAIL_2]", 5: "[EMAIL_9]",
    10: None, 11: BATCHES[1][3][3], 6: "[EMAIL_4]", 7: "nothing", 8: "[EMAIL_2] [EMAIL_1]", 12: "[EMAIL_1000000000000000001] [IP_1]",
    13: "[EMAIL_1000000000000000002] [EMAIL_1000000000000000001] [IP_2]", 14: "",
}


@pytest.fixture
def rocksdb(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stateful.require_rocksdb(spark)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    yield
    spark.conf.unset(stateful.PROVIDER)


def run_stream(spark, folder, **kwargs):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    masked = stateful.mask_session_state(source, ["id", "turn"], ["session"], ["turn"], **kwargs)
    query = stateful.write_by_kind(masked, str(folder / "out"), str(folder / "state"))
    query.awaitTermination()
    return query


def test_state_numbers_as_the_batch_operator_and_survives_restarts(spark, tmp_path, rocksdb):
    known = spark.createDataFrame([], "session_id string, token string, entity_type string, value string")
    batch = {}
    for at, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if at != 1:  # the second and third part arrive as two micro-batches of one run
            run_stream(spark, tmp_path)
        out, added = mask.sanitize_scope(df, ["id"], ["turn", "id"], ["session"], vault=known)
        batch |= {r.id: r.masked_text for r in out.collect()}
        known = known.unionByName(spark.createDataFrame(added.collect(), known.schema))
    got = {r.id: r.masked_text for r in stateful.read_masked(spark, str(tmp_path / "out")).collect()}
    assert got == EXPECTED == batch
    tokens = stateful.read_new_tokens(spark, str(tmp_path / "out"))
    key = ["session_id", "token", "entity_type", "value"]
    assert sorted(map(tuple, tokens.select(key).collect()), key=repr) == sorted(map(tuple, known.filter("value IS NOT NULL").select(key).collect()), key=repr)


def test_forgotten_values_get_a_new_number(spark, tmp_path, rocksdb):
    def arrived():
        if not (tmp_path / "out" / "_spark_metadata").exists():
            return {}
        rows = spark.read.schema("id long, masked_text string, kind string").parquet(str(tmp_path / "out"))
        return {r.id: r.masked_text for r in rows.filter("kind = 'masked'").collect()}

    # With a time to live the stream looks at the clock, so it runs until it is stopped.
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    masked = stateful.mask_session_state(source, ["id", "turn"], ["session"], ["turn"], ttl_ms=3_000)
    query = stateful.write_by_kind(masked, str(tmp_path / "out"), str(tmp_path / "state"), available_now=False)
    try:
        for i in (1, 2):
            spark.createDataFrame([(i, "s", i, "a@b.io")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            until = time.monotonic() + 60
            while i not in arrived() and time.monotonic() < until and query.isActive:
                time.sleep(0.5)
            time.sleep(5)
    finally:
        query.stop()
    assert arrived() == {1: "[EMAIL_1]", 2: "[EMAIL_2]"}


# ---- versions of a vault


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_writers_of_one_session_never_share_a_token(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"), b"0123456789abcdef")
    one, two = (spark.createDataFrame([(i, "s", 1, f"{name}@x.io both@x.io")], SCHEMA) for i, name in enumerate(("ann", "bo")))
    base = store.latest()
    _, first = mask.sanitize_scope(one, ["id"], ["turn"], ["session"], vault=store.read(base))
    _, second = mask.sanitize_scope(two, ["id"], ["turn"], ["session"], vault=store.read(base))
    made = store.commit(first, base)
    with pytest.raises(VaultMoved):
        store.commit(second, base)
    assert store.latest() == made
    masked, version = sanitize_into(store, two, ["id"], ["turn"], ["session"])
    assert masked.first()["masked_text"] == "[EMAIL_3] [EMAIL_2]" and version.number == made.number + 1
    tokens = store.read().filter("value IS NOT NULL")
    assert tokens.select("token").distinct().count() == tokens.count() == 3
    # A reader of an older version still sees it.
    assert store.read(made).count() == 2 and store.read(base).count() == 0


def test_writers_of_other_sessions_pass_each_other(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"))
    base = store.latest()
    for session in "stu":
        df = spark.createDataFrame([(1, session, 1, f"{session}@x.io")], SCHEMA)
        _, added = mask.sanitize_scope(df, ["id"], ["turn"], ["session"], vault=store.read(base))
        store.commit(added, base)
    assert [r[:2] for r in rows_of(store.read())] == [("s", "[EMAIL_1]"), ("t", "[EMAIL_1]"), ("u", "[EMAIL_1]")]
    assert rows_of(store.read(sessions=["t"])) == [("t", "[EMAIL_1]", "EMAIL", "t@x.io")]
    assert store.read(sessions=[]).count() == 0


def test_concurrent_runs_go_again(spark, tmp_path):
    errors = []

    def work(i):
        try:
            own = VaultStore(spark, str(tmp_path / "vault"))
            df = spark.createDataFrame([(i, "s", 1, f"w{i}@x.io shared@x.io")], SCHEMA)
            sanitize_into(own, df, ["id"], ["turn"], ["session"], attempts=10)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    tokens = VaultStore(spark, str(tmp_path / "vault")).read().filter("value IS NOT NULL").collect()
    assert len({t.token for t in tokens}) == len({t.value for t in tokens}) == len(tokens) == 4


def test_files_stay_few_over_many_commits(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"), buckets=2, max_folders=5)
    schema = "session_id string, token string, entity_type string, value string"
    for i in range(100):
        pairs = spark.createDataFrame([("s", f"[EMAIL_{i}]", "EMAIL", f"v{i}")], schema)
        made = store.commit(pairs, store.latest())
        assert len(made.folders) <= 5
    assert store.read().count() == 100
    store.vacuum()
    assert store.read().count() == 100
    data = [p for p in (tmp_path / "vault" / "data").rglob("*.parquet")]
    assert len(data) <= 2 * 6
    with pytest.raises(VaultConflict):
        store.commit(spark.createDataFrame([("s", "[EMAIL_1]", "EMAIL", "other")], schema), store.latest())


# ---- nested records


def test_strings_at_any_depth_are_masked_and_revealed(spark, tmp_path):
    schema = (
        "id long, name string, people array<struct<mail:string,tags:array<string>,n:int>>, extra map<string,struct<note:string,day:date>>, `odd name` struct<`a b`:string>, when timestamp"
    )
    records = [
        {"id": 1, "name": "ann@x.io [EMAIL_4]", "people": [{"mail": "bo@x.io", "tags": ["ann@x.io", None, "10.0.0.1"], "n": 1}, None, {"mail": None, "tags": [], "n": 2}],
         "extra": {"k@k.io": {"note": "call 555-1234 bo@x.io", "day": "2024-01-02"}, "z": None}, "odd name": {"a b": "cy@x.io"}},
        {"id": 2, "name": None, "people": None, "extra": {}, "odd name": None},
        {"id": 3, "name": "plain", "people": [], "extra": None, "odd name": {"a b": None}},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, records)))
    df = files.read_tabular(spark, "json", str(tmp_path / "in.json"), schema)
    masked = nested.mask_nested(df)
    assert masked.drop("tokens").schema.simpleString() == df.schema.simpleString()
    rows = {r["id"]: r for r in masked.collect()}
    one = rows[1]
    assert one["name"] == "[EMAIL_5] [EMAIL_4]"
    assert one["people"][0].asDict() == {"mail": "[EMAIL_6]", "tags": ["[EMAIL_5]", None, "[IP_1]"], "n": 1} and one["people"][1] is None
    assert one["extra"]["k@k.io"]["note"] == "call [PHONE_1] [EMAIL_6]" and one["extra"]["z"] is None and one["odd name"]["a b"] == "[EMAIL_7]"
    assert rows[2]["tokens"] == [] and rows[3]["name"] == "plain" and rows[2]["people"] is None
    back = nested.reveal_nested(masked).drop("tokens")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    only = nested.mask_nested(df, ["people"]).filter("id = 1").first()
    assert only["name"] == "ann@x.io [EMAIL_4]" and only["people"][0]["mail"] == "[EMAIL_1]"
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert nested.mask_nested(df.select("id")).columns == ["id", "tokens"]


# ---- files that are not there


def test_absent_paths_are_quarantined(spark, tmp_path):
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "a.txt").write_text("mail a@b.io")
    asked = [str(tmp_path / "some"), str(tmp_path / "none.txt"), str(tmp_path / "no*.md")]
    texts, bad = files.read_documents(spark, asked)
    assert [r["text"] for r in texts.collect()] == ["mail a@b.io"]
    assert rows_of(bad.select("path", "reason")) == sorted((p, "missing_file") for p in asked[1:])
    texts, bad = files.read_documents(spark, asked[1])
    assert texts.count() == 0 and bad.count() == 1
    masked, bad = files.sanitize_files(spark, asked)
    assert masked.first()["masked_text"] == "mail [EMAIL_1]" and bad.filter(F.col("reason") == "missing_file").count() == 2


# ---- reveal by a join in one plan


def test_joined_reveal_equals_reveal(spark):
    from hushframe.operators.reveal import reveal
    from hushframe.streaming.joined import reveal_joined

    vault = spark.createDataFrame(
        [("s", "[A_1]", "A", "x"), ("s", "[A_2]", "A", "y"), ("s", "[A_3]", "A", "p"), ("s", "[A_3]", "A", "q"), ("t", "[A_1]", "A", "z"), ("t", "[A_9]", "A", None)],
        "session_id string, token string, entity_type string, value string",
    )
    texts = ["[A_1] [A_2]", "[A_1] [A_7]", "[A_7]", "no token", None, "", "[A_1] [A_3]", "[x] http://http://a [A_1]"]
    rows = [(f"{s}{i}", s, text) for s in ("s", "t", "u", None) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, session string, text string")
    one = reveal(df, vault, ["id"], "text", "session")
    two = reveal_joined(df, vault, "text", "session")
    columns_ = ["id", "revealed_text", "status"]
    assert rows_of(two.select(columns_)) == rows_of(one.select(columns_))
    with pytest.raises(Exception, match="too many tokens"):
        reveal_joined(df, vault, "text", "session", max_session_tokens=2).collect()


def test_reveal_reads_the_documents_once(spark):
    import __spark_entry__ as entry_point

    plan = entry_point.queries()["reveal_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0
