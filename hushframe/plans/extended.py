"""More registered queries: dictionaries, detectors, shared vaults, rule files, absent files, nested records."""

from __future__ import annotations

import json
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from hushframe.functions.catalog import TEMPLATE_EXCLUSIONS, TEMPLATE_RULE, Rule, rules_for
from hushframe.functions.spans import TOKEN_PATTERN
from hushframe.operators import detect, mask, nested, report, reveal, vault, vault_store
from hushframe.operators.detector import with_detector
from hushframe.operators.skew import cut_lineage
from hushframe.plans import oracle, texts
from hushframe.plans.queries import (
    _REPLY, _SESSION_MASK, _TURN_TEXT, BASE, DOCS, ORACLES, _stream, _turns, documents, query, scratch, session_vault, table,
)
from hushframe.sources import files, rulebook
from hushframe.streaming import joined, lines, stateful

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- dictionaries and detectors -------------------------------------------

# Every two and three words in a row of every benchmark text are phrases to mask.
_PHRASES = """phrases AS (
  SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT string_split_regex(trim(text), '\\s+') AS w FROM benchmark)),
    (VALUES (2), (3)) x(n)
  WHERE i + n - 1 <= len(w))"""
_ATOM = "[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+|[^A-Za-z0-9_\\x{80}-\\x{10FFFF}]"
_PLACES = f"""{_PHRASES},
parts AS MATERIALIZED (SELECT v, len(a) AS n, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS k
  FROM (SELECT v, regexp_extract_all(v, '{_ATOM}') AS a FROM phrases)),
atoms AS MATERIALIZED (SELECT id, x, i, (sum(length(x)) OVER (PARTITION BY id ORDER BY i) - length(x))::BIGINT AS s
  FROM (SELECT id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{_ATOM}') AS a FROM src))),
grown AS (
  SELECT p.v, p.n, t.id, t.i, t.s, 1 AS k FROM atoms t JOIN parts p ON p.k = 1 AND p.x = t.x
  UNION ALL
  SELECT g.v, g.n, g.id, g.i, g.s, g.k + 1 FROM grown g JOIN parts p ON p.v = g.v AND p.k = g.k + 1
    JOIN atoms t ON t.id = g.id AND t.i = g.i + g.k AND t.x = p.x),
spans AS MATERIALIZED (SELECT id, s, s + length(v) AS e, v FROM grown WHERE k = n)"""


def _phrases(spark, sf_dir):
    words = F.split(F.trim("text"), r"\s+")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(3)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + n - 1 <= F.size("w")),
        lambda i: F.array_join(F.slice("w", i, n), " "),
    )))
    rows = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(runs).alias("phrase"))
    return rows.distinct().select("phrase", F.lit("PHRASE").alias("label"))


@query(
    "dictionary_findings",
    f"WITH RECURSIVE src AS MATERIALIZED ({DOCS}),\n{_PLACES}\n"
    "SELECT id AS doc_id, s::INT AS span_start, e::INT AS span_end, v AS value FROM spans",
)
def dictionary_findings(spark, sf_dir):
    rows = detect.with_dictionary(documents(spark, sf_dir), ["doc_id"], _phrases(spark, sf_dir))
    found = rows.select("doc_id", F.inline("dictionary_findings"))
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "value")


@query(
    "mask_dictionary",
    f"WITH RECURSIVE src AS MATERIALIZED ({DOCS}),\n{_PLACES},\n"
    "pick AS (SELECT id, min({'s': s, 'n': -e, 'v': v}) AS b FROM spans GROUP BY id UNION ALL"
    " SELECT p.id, min({'s': x.s, 'n': -x.e, 'v': x.v}) FROM pick p JOIN spans x ON x.id = p.id AND x.s >= -p.b.n GROUP BY p.id),\n"
    "acc AS MATERIALIZED (SELECT id, b.s AS s, -b.n AS e, 'PHRASE' AS et, 'dictionary' AS rid, b.v AS v FROM pick),\n"
    f"{oracle.row_tokens()},\n{oracle.masked()}\nSELECT id AS doc_id, masked_text FROM masked",
)
def mask_dictionary(spark, sf_dir):
    rows = detect.with_dictionary(documents(spark, sf_dir), ["doc_id"], _phrases(spark, sf_dir))
    return mask.sanitize(rows, rules=[], extra="dictionary_findings").select("doc_id", "masked_text")


# What the example detector below finds, as rules for the check.
_SHOUTS = [Rule("detector_shout", "SHOUT", r"\b[A-Z]{3,}\b", 500), Rule("detector_year", "YEAR", r"\b(?:19|20)\d\d\b", 500)]


def find_shouts(found_in):
    """An example of a user's detector: words in capitals, and years."""
    shapes = [("SHOUT", re.compile(r"\b[A-Z]{3,}\b", re.ASCII)), ("YEAR", re.compile(r"\b(?:19|20)\d\d\b", re.ASCII))]
    return [[(m.start(), m.end(), label) for label, shape in shapes for m in shape.finditer(text)] for text in found_in]


@query("mask_detector", oracle.mask_rows(DOCS, [*_SHOUTS, *BASE], "SELECT id AS doc_id, masked_text FROM masked"))
def mask_detector(spark, sf_dir):
    rows = with_detector(documents(spark, sf_dir), find_shouts)
    return mask.sanitize(rows, extra="detector_findings").select("doc_id", "masked_text")


# --- shared vaults --------------------------------------------------------

# Numbered by all rules but masked without those for cards and e-mail: what these find is left over.
_LEFT_OUT = ("CARD", "EMAIL")
_FEWER = [r for r in BASE if r.entity_type not in _LEFT_OUT]


@query(
    "vault_leak_audit",
    f"WITH src AS MATERIALIZED ({DOCS}),\n{oracle.accepted(BASE)},\n"
    "held AS MATERIALIZED (SELECT DISTINCT et, v FROM acc),\n"
    f"less AS MATERIALIZED (WITH {oracle.accepted(_FEWER)},\n{oracle.row_tokens()},\n{oracle.masked()}\n"
    f" SELECT id, regexp_replace(masked_text, {oracle.q(TOKEN_PATTERN)}, chr(1), 'g') AS t FROM masked)\n"
    "SELECT et AS entity_type, count(*) AS checked,"
    " count(*) FILTER (EXISTS (SELECT 1 FROM less WHERE contains(t, v))) AS leaked FROM held GROUP BY et",
)
def vault_leak_audit(spark, sf_dir):
    docs = documents(spark, sf_dir)
    entries = vault.as_vault(mask.sanitize_scope(docs, ["doc_id"], ["doc_id"])[1])
    masked = cut_lineage(mask.sanitize(docs, rules=_FEWER).select("doc_id", "masked_text"))
    return report.vault_leak_audit(masked, entries)


@query(
    "vault_store_commits",
    _SESSION_MASK + "\nSELECT s.conv_id, s.turn, m.masked_text, s.text AS revealed_text FROM masked m JOIN src s ON s.id = m.id",
)
def vault_store_commits(spark, sf_dir):
    """Three runs over the turns in order, each committed to one versioned vault, compacted, and all revealed from its last version."""
    store = vault_store.VaultStore(spark, f"{scratch(spark)}/vault", b"0123456789abcdef", max_folders=2)
    parts = []
    for part in ("turn < 1", "turn BETWEEN 1 AND 2", "turn > 2"):
        rows = _turns(spark, sf_dir, part)
        masked, _ = vault_store.sanitize_into(store, rows, ["conv_id", "turn"], ["turn"], ["conv_id"])
        parts.append(masked.select("conv_id", "turn", "masked_text"))
    masked = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    back = reveal.reveal(masked, store.read().filter("value IS NOT NULL"), ["conv_id", "turn"], "masked_text", "conv_id")
    return back.select("conv_id", "turn", "masked_text", "revealed_text")


@query(
    "stream_session_state",
    _SESSION_MASK + "\nSELECT s.conv_id, s.turn, m.masked_text FROM masked m JOIN src s ON s.id = m.id",
)
def stream_session_state(spark, sf_dir):
    """Turns arrive in three parts; the stream is stopped and started again between them and goes on from its state."""
    folder = scratch(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN_TEXT).alias("text"))
    provider = spark.conf.get(stateful.PROVIDER, None)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    try:
        for part in ("turn < 1", "turn BETWEEN 1 AND 2", "turn > 2"):
            turns.filter(part).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(turns.schema).parquet(f"{folder}/in")
            masked = stateful.mask_session_state(source, ["conv_id", "turn"], ["conv_id"], ["turn"])
            stateful.write_by_kind(masked, f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset(stateful.PROVIDER)
        else:
            spark.conf.set(stateful.PROVIDER, provider)
    return stateful.read_masked(spark, f"{folder}/out").select("conv_id", "turn", "masked_text")


@query("stream_reveal_joined", ORACLES["stream_reveal"])
def stream_reveal_joined(spark, sf_dir):
    """Replies restored by a join with the sessions' maps inside the streaming plan."""
    folder = scratch(spark)
    entries = cut_lineage(session_vault(spark, sf_dir))
    source = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("text"))
    done = joined.reveal_joined(source, entries, "text", "conv_id").select("conv_id", "turn", "revealed_text")
    lines.write_append(done, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("conv_id bigint, turn bigint, revealed_text string").parquet(f"{folder}/out")


@query(
    "stream_request_counts",
    "SELECT 'all' AS part, count(*) AS requests, count(text) AS texts FROM conversations",
)
def stream_request_counts(spark, sf_dir):
    """Counts observed on a stream over two runs with a restart in between, added up from the saved batches."""
    folder = scratch(spark)
    turns = table(spark, sf_dir, "conversations")
    counts = joined.RequestCounts()
    spark.streams.addListener(counts)
    try:
        for part in ("turn < 1", "turn >= 1"):
            turns.filter(part).write.mode("append").parquet(f"{folder}/in")
            source = joined.count_requests(spark.readStream.schema(turns.schema).parquet(f"{folder}/in"))
            run = lines.write_append(lines.mask_stream(source, "text"), f"{folder}/out", f"{folder}/state")
            run.awaitTermination()
            counts.wait_for(str(run.runId))
            counts.save(spark, f"{folder}/counts")
    finally:
        spark.streams.removeListener(counts)
    saved = joined.read_request_counts(spark, f"{folder}/counts")
    return saved.groupBy(F.lit("all").alias("part")).agg(F.sum("requests").alias("requests"), F.sum("texts").alias("texts"))


# --- profiles -------------------------------------------------------------

@query(
    "entity_profile_merged",
    oracle.found(
        DOCS, BASE,
        "SELECT d.lang, a.et AS entity_type, count(*) AS findings, count(DISTINCT a.v) AS exact_values, true AS within_3_percent"
        " FROM acc a JOIN documents d ON d.doc_id = a.id GROUP BY ALL",
    ),
)
def entity_profile_merged(spark, sf_dir):
    """Sketches per language and source are written, read and merged by language; the estimates are held against exact counts."""
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    report.entity_sketches(docs, ["lang", "source"]).write.parquet(f"{folder}/sketches")
    merged = report.merged_profile(spark.read.parquet(f"{folder}/sketches"), ["lang"])
    exact = detect.findings(docs, ["lang"]).groupBy("lang", "entity_type").agg(F.count_distinct("value").alias("exact_values"))
    close = F.abs(F.col("approx_values") - F.col("exact_values")) <= F.col("exact_values") * 0.03
    return merged.join(exact, ["lang", "entity_type"]).select(
        "lang", "entity_type", "findings", "exact_values", close.alias("within_3_percent")
    )


# --- files ----------------------------------------------------------------

_FILE_RULES = (
    {"pattern": r"\b[A-Z][a-z]+berg\b", "label": "hill"},
    {"regex": r"\b\d{4}-\d{2}-\d{2}\b", "category": "day"},
    {"pattern": r"(a|aa)+$", "label": "slow"},
    TEMPLATE_RULE,
)
_FILE_ACCEPTED = [Rule(f"custom_{i}", label, pattern, -1_000_000_000 + i) for i, (pattern, label) in enumerate(
    [(r"\b[A-Z][a-z]+berg\b", "HILL"), (r"\b\d{4}-\d{2}-\d{2}\b", "DAY")]
)]


@query(
    "rule_file_masked",
    oracle.mask_rows(DOCS, rules_for("general", _FILE_ACCEPTED), "SELECT id AS doc_id, masked_text FROM masked", TEMPLATE_EXCLUSIONS),
)
def rule_file_masked(spark, sf_dir):
    """A rule file is written, read and checked; the documents are masked by it, written, and read back."""
    folder = scratch(spark)
    written = rulebook.write_default_rules(spark, f"{folder}/default")
    _, _, exclusions = rulebook.load_rules(spark, f"{folder}/default")
    assert written and not rulebook.write_default_rules(spark, f"{folder}/default")
    content = json.dumps({"customRules": _FILE_RULES, "exclusions": exclusions})
    spark.createDataFrame([(content,)], "value string").write.text(f"{folder}/rules")
    accepted, rejected, exclusions = rulebook.load_rules(spark, f"{folder}/rules")
    assert [r["reason"] for r in rejected] == ["ambiguous_repeat"] and len(accepted) == 3
    masked = mask.sanitize(documents(spark, sf_dir), rules=rules_for("general", accepted), exclusions=exclusions)
    files.write_masked(masked, f"{folder}/masked")
    return spark.read.schema("doc_id bigint, masked_text string").parquet(f"{folder}/masked")


@query(
    "missing_files",
    "SELECT 'text' AS kind, text AS content FROM documents WHERE text <> '' UNION ALL SELECT 'quarantine', 'absent-1 missing_file'"
    " UNION ALL SELECT 'quarantine', 'absent-2 missing_file'",
)
def missing_files(spark, sf_dir):
    """One folder that is there, with a file for each document, and two paths that are not."""
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("text")
    docs.withColumn("part", F.xxhash64("text") % 8).write.partitionBy("part").text(f"{folder}/lines", lineSep="\x1e")
    found, bad = files.read_documents(spark, [f"{folder}/lines", f"{folder}/absent-1", f"{folder}/absent-2"], max_bytes=1 << 40)
    # The files hold many documents each, ended by a record separator.
    rows = found.select(F.lit("text").alias("kind"), F.explode(F.split("text", "\x1e")).alias("content")).filter("content <> ''")
    reasons = bad.select(F.lit("quarantine").alias("kind"), F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" "), "reason").alias("content"))
    return rows.unionByName(reasons)


# --- nested records -------------------------------------------------------

_MAIL = texts.sentence("r{4}@post.example or 10.0.0.{2}", "c_custkey")
_NOTE = texts.sentence("see r{4}@post.example and x{3}@post.example", "c_custkey")
# The leaves of a record in schema order, one per line; no built-in rule matches across lines.
_NESTED_TEXT = f"c_name || chr(10) || {_MAIL} || chr(10) || {_NOTE} || chr(10) || c_mktsegment || chr(10) || {_MAIL}"


@query(
    "mask_nested_json",
    oracle.mask_rows(
        f"SELECT c_custkey AS id, {_NESTED_TEXT} AS text FROM customer", BASE,
        "SELECT id AS c_custkey, string_split(masked_text, chr(10))[1] AS name, string_split(masked_text, chr(10))[2] AS first_contact,"
        " string_split(masked_text, chr(10))[3] AS second_note, string_split(masked_text, chr(10))[5] AS mapped FROM masked",
    ),
)
def mask_nested_json(spark, sf_dir):
    """Records with arrays of structs and a map, written as JSON, read under their schema, masked; revealed ones are compared."""
    path = scratch(spark)
    record = F.expr(
        f"named_struct('name', c_name, 'contacts', array(named_struct('mail', {_MAIL}, 'note', cast(null AS string)),"
        f" named_struct('mail', cast(null AS string), 'note', {_NOTE})), 'extra', map('segment', c_mktsegment, 'mail', {_MAIL}))"
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", record.alias("record"))
    rows.write.json(path)
    read = files.read_tabular(spark, "json", path, rows.schema)
    masked = cut_lineage(nested.mask_nested(read, ["record"]))
    back = nested.reveal_nested(masked, ["record"]).select("c_custkey", F.to_json("record").alias("after"))
    same = read.select("c_custkey", F.to_json("record").alias("before")).join(back, "c_custkey").filter("before = after")
    return masked.join(same.select("c_custkey"), "c_custkey").select(
        "c_custkey", "record.name", F.expr("record.contacts[0].mail").alias("first_contact"),
        F.expr("record.contacts[1].note").alias("second_note"), F.expr("record.extra['mail']").alias("mapped"),
    )
