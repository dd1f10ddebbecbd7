"""The registered queries: each operator over whole tables, with SQL to check it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import columns
from hushframe.functions.catalog import (
    BINARY_SNIFF_BYTES,
    PROFILES,
    Rule,
    rules_for,
)
from hushframe.operators import detect, guards, mask, policy, report, reveal, vault
from hushframe.operators.skew import cut_lineage, shared_folder, spread
from hushframe.plans import oracle, samples, texts
from hushframe.sources import files, rulebook
from hushframe.streaming import lines

cloudpickle.register_pickle_by_value(samples)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its check."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids and texts, spread over the cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def customer_texts(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """``(c_custkey, text)`` with a text built from the key."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return spread(customers, ["c_custkey"]).select("c_custkey", F.expr(expression).alias("text"))


def scratch(spark: SparkSession) -> str:
    """A new folder path the executors share."""
    return f"{shared_folder(spark)}/hushframe-{uuid.uuid4().hex}"


DOCS = "SELECT doc_id AS id, text FROM documents"
BASE = rules_for()
CUSTOMER = "SELECT c_custkey AS id, {} AS text FROM customer"
SECRET_TEXT = texts.pick(texts.SECRET_SENTENCES, "c_custkey")
OVERLAP_TEXT = texts.pick(texts.OVERLAP_SENTENCES, "c_custkey")


# --- detection ------------------------------------------------------------

@query(
    "entity_counts_by_lang",
    oracle.found(
        DOCS, BASE,
        "SELECT d.lang, a.et AS entity_type, a.rid AS rule_id, count(*) AS hits, count(DISTINCT a.id) AS docs"
        " FROM acc a JOIN documents d ON d.doc_id = a.id GROUP BY ALL",
    ),
)
def entity_counts_by_lang(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    return report.entity_totals(docs, ["lang"])


@query(
    "findings_spans",
    oracle.found(
        DOCS, BASE,
        "SELECT id AS doc_id, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end,"
        " et AS entity_type, rid AS rule_id, v AS value FROM acc",
    ),
)
def findings_spans(spark, sf_dir):
    found = detect.findings(documents(spark, sf_dir), ["doc_id"])
    return found.select(
        "doc_id",
        F.col("start").cast("long").alias("span_start"),
        F.col("end").cast("long").alias("span_end"),
        "entity_type", "rule_id", "value",
    )


@query(
    "secret_flags",
    f"SELECT c_custkey, {oracle.secret_names(f'({SECRET_TEXT})')} AS secrets FROM customer",
)
def secret_flags(spark, sf_dir):
    found = detect.detect_secrets(customer_texts(spark, sf_dir, SECRET_TEXT))
    return found.select("c_custkey", F.array_join("secrets", ",").alias("secrets"))


@query(
    "secret_flags_documents",
    f"SELECT doc_id, {oracle.secret_names('text')} AS secrets FROM documents",
)
def secret_flags_documents(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(columns.detect_secrets("text"), ",").alias("secrets")
    )


_KV = [r for r in BASE if r.rule_id == "secret_kv"]


@query(
    "secret_kv_quoted",
    oracle.found(DOCS, _KV, "SELECT id AS doc_id, v AS value FROM acc"),
)
def secret_kv_quoted(spark, sf_dir):
    return detect.findings(documents(spark, sf_dir), ["doc_id"], rules=_KV).select("doc_id", "value")


@query(
    "card_luhn_confidence",
    oracle.found(
        DOCS, [r for r in BASE if r.entity_type == "CARD"],
        f"SELECT id AS doc_id, v AS value, {oracle.luhn('dg')} AS passes"
        " FROM (SELECT id, v, regexp_replace(v, '[- ]', '', 'g') AS dg FROM acc)",
    ),
)
def card_luhn_confidence(spark, sf_dir):
    cards = [r for r in BASE if r.entity_type == "CARD"]
    return detect.findings(documents(spark, sf_dir), ["doc_id"], rules=cards).select(
        "doc_id", "value", columns.luhn_confidence("value").alias("passes")
    )


# Fixed by the query: places are the first word, and the first three words, of each benchmark text.
@query(
    "places_from_gazetteer",
    r"""
    WITH gaz AS (
      SELECT DISTINCT regexp_replace(array_to_string(string_split_regex(trim(text), '\s+')[1:n], ' '), '^\p{P}+|\p{P}+$', '', 'g') AS place
      FROM benchmark, (VALUES (1), (3)) v(n)
    ),
    lens AS (SELECT DISTINCT len(string_split(place, ' ')) AS n FROM gaz),
    words AS (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    phrases AS (
      SELECT DISTINCT doc_id, regexp_replace(array_to_string(w[i:i + n - 1], ' '), '^\p{P}+|\p{P}+$', '', 'g') AS place
      FROM starts JOIN lens ON i + n - 1 <= len(w) WHERE regexp_matches(w[i], '^\p{P}*\p{Lu}')
    )
    SELECT doc_id, 'LOCATION' AS entity_type, place AS value FROM phrases JOIN gaz USING (place)
    """,
)
def places_from_gazetteer(spark, sf_dir):
    words = F.split(F.trim("text"), r"\s+")
    gazetteer = table(spark, sf_dir, "benchmark").select(
        F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (1, 3)])).alias("place")
    )
    return detect.detect_places(documents(spark, sf_dir), gazetteer, ["doc_id"])


# --- profiles -------------------------------------------------------------

def _register_profile(profile: str) -> None:
    # Real text first, where the pack should find nothing much, then a note of its kind.
    text = "text || chr(10) || " + texts.sentence(texts.PROFILE_SENTENCES[profile], "doc_id")

    @query(
        f"profile_pack_{profile}",
        oracle.mask_rows(
            f"SELECT doc_id AS id, {text} AS text FROM documents", rules_for(profile),
            "SELECT id AS doc_id, masked_text FROM masked",
        ),
    )
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir).select("doc_id", F.expr(text).alias("text"))
        return mask.sanitize(docs, profile=profile).select("doc_id", "masked_text")


for _profile in PROFILES:
    _register_profile(_profile)


_BY_PROFILE_TEXT = "CASE c_custkey % 3 " + " ".join(
    f"WHEN {i} THEN {texts.sentence(texts.PROFILE_SENTENCES[p], 'c_custkey')}"
    for i, p in enumerate(("medical", "finance", "creative"))
) + " END"


def _by_profile_sql() -> str:
    # Each profile in turn over its own rows, named by the outer query.
    selects = []
    for i, p in enumerate(("medical", "finance", "general")):
        source = CUSTOMER.format(_BY_PROFILE_TEXT) + f" WHERE c_custkey % 3 = {i}"
        selects.append(
            "SELECT * FROM ("
            + oracle.mask_rows(source, rules_for(p), "SELECT id AS c_custkey, masked_text FROM masked")
            + ")"
        )
    return " UNION ALL ".join(selects)


@query("profile_per_row", _by_profile_sql())
def profile_per_row(spark, sf_dir):
    names = F.expr("CASE c_custkey % 3 WHEN 0 THEN ' Medical' WHEN 1 THEN 'FINANCE' END")
    rows = customer_texts(spark, sf_dir, _BY_PROFILE_TEXT).withColumn("profile", names)
    good, _ = guards.require_profile(rows)
    return mask.sanitize_by_profile(good).select("c_custkey", "masked_text")


@query(
    "profile_quarantine",
    "SELECT c_custkey, lower(trim(c_mktsegment)) AS profile, 'unknown_profile' AS reason FROM customer"
    " WHERE c_custkey % 2 = 0",
)
def profile_quarantine(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE ' Legal ' END").alias("profile")
    )
    return guards.require_profile(rows)[1]


# --- masking --------------------------------------------------------------

_MASK_DOCS = oracle.mask_rows(DOCS, BASE, "SELECT id AS doc_id, masked_text FROM masked")


@query("mask_document_scope", _MASK_DOCS)
def mask_document_scope(spark, sf_dir):
    return mask.sanitize(documents(spark, sf_dir)).select("doc_id", "masked_text")


@query("mask_long_texts", _MASK_DOCS)
def mask_long_texts(spark, sf_dir):
    return mask.sanitize_long(documents(spark, sf_dir), ["doc_id"], lines_per_part=20)[0].select(
        "doc_id", "masked_text"
    )


_BOTH = (
    "SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM documents"
    " UNION ALL SELECT 'p' || CAST(page_id AS STRING) AS id, html AS text FROM pages"
)


@query("redact_types", oracle.redacted(_BOTH, BASE, "SELECT id, masked_text AS redacted_text FROM masked"))
def redact_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("'d' || CAST(doc_id AS STRING) AS id", "text")
    pages = table(spark, sf_dir, "pages").selectExpr("'p' || CAST(page_id AS STRING) AS id", "html AS text")
    both = spread(docs, ["id"]).unionByName(spread(pages, ["id"]))
    return mask.redact(both).select("id", "redacted_text")


_CUSTOM = [
    Rule("custom_0", "MAILBOX", r"\bmail\d+\.example\.com\b", 0, profile="custom"),
    Rule("custom_1", "HEXKEY", r"[0-9a-f]{40}", 1, profile="custom"),
]


@query(
    "custom_rules",
    oracle.mask_rows(DOCS, rules_for("general", _CUSTOM), "SELECT id AS doc_id, masked_text FROM masked"),
)
def custom_rules(spark, sf_dir):
    rules = rules_for("general", _CUSTOM)
    return mask.sanitize(documents(spark, sf_dir), rules=rules).select("doc_id", "masked_text")


# A rule table as users write it: fall-backs, nothing to look for, a bad expression, a label no placeholder can carry.
_RULE_TABLE = [
    (r"\bmail\d+\.example\.com\b", None, "mailbox", None),
    ("", r"[0-9a-f]{40}", None, "hexkey"),
    (None, None, "empty", None),
    ("(", None, "broken", None),
    (r"\bthe\b", None, "two words", None),
    (r"(?:o+u)+x", None, "slow", None),
    (r"\bwhich\b", "", "", ""),
]
_ACCEPTED = [
    Rule("custom_0", "MAILBOX", r"\bmail\d+\.example\.com\b", -3),
    Rule("custom_1", "HEXKEY", r"[0-9a-f]{40}", -2),
    Rule("custom_2", "CUSTOM", r"\bwhich\b", -1),
]


@query(
    "custom_rules_table",
    oracle.mask_rows(DOCS, rules_for("general", _ACCEPTED), "SELECT id AS doc_id, masked_text FROM masked"),
)
def custom_rules_table(spark, sf_dir):
    raw = spark.createDataFrame(_RULE_TABLE, "pattern string, regex string, label string, category string")
    accepted, _ = rulebook.rules_from_table(spark, rulebook.normalise_rules(raw))
    return mask.sanitize(documents(spark, sf_dir), rules=rules_for("general", accepted)).select("doc_id", "masked_text")


_EXCLUDED = ("4111-2222-3333-1100", "555-1100", "alice1150@corp.example.com", "bob1150@corp.example.com", "10.0.0.11")


@query(
    "exclusions",
    oracle.mask_rows(
        CUSTOMER.format(OVERLAP_TEXT), BASE, "SELECT id AS c_custkey, masked_text FROM masked", _EXCLUDED
    ),
)
def exclusions(spark, sf_dir):
    rows = customer_texts(spark, sf_dir, OVERLAP_TEXT)
    return mask.sanitize(rows, exclusions=_EXCLUDED).select("c_custkey", "masked_text")


@query(
    "exclusions_from_table",
    oracle.found(
        DOCS, BASE,
        "SELECT a.id AS doc_id, a.v AS value FROM acc a WHERE NOT EXISTS"
        " (SELECT 1 FROM (SELECT min(v) AS v FROM acc GROUP BY et) x WHERE x.v = a.v)",
    ),
)
def exclusions_from_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    allowed = detect.findings(docs, ["doc_id"]).groupBy("entity_type").agg(F.min("value").alias("value"))
    return detect.findings_excluding(docs, ["doc_id"], allowed).select("doc_id", "value")


# Every second customer's assignment is allowed, so the address inside it has to be found instead.
_ALLOWED = "'token=alice' || lpad(CAST(c_custkey AS STRING), 4, '1') || '@corp.example.com'"


@query(
    "mask_exclusions_table",
    oracle.mask_rows(
        CUSTOMER.format(OVERLAP_TEXT), BASE, "SELECT id AS c_custkey, masked_text FROM masked", ("\x00",)
    ).replace("v NOT IN ('\x00')", f"v NOT IN (SELECT {_ALLOWED} FROM customer WHERE c_custkey % 2 = 0)"),
)
def mask_exclusions_table(spark, sf_dir):
    rows = customer_texts(spark, sf_dir, OVERLAP_TEXT)
    allowed = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.expr(_ALLOWED).alias("value"))
    return mask.sanitize_excluding(rows, ["c_custkey"], allowed).select("c_custkey", "masked_text")


@query(
    "overlap_resolution",
    oracle.found(
        CUSTOMER.format(OVERLAP_TEXT), rules_for("dev"),
        "SELECT id AS c_custkey, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, rid AS rule_id FROM acc",
    ),
)
def overlap_resolution(spark, sf_dir):
    found = detect.findings(customer_texts(spark, sf_dir, OVERLAP_TEXT), ["c_custkey"], rules=rules_for("dev"))
    return found.select(
        "c_custkey",
        F.col("start").cast("long").alias("span_start"),
        F.col("end").cast("long").alias("span_end"),
        "rule_id",
    )


_CONTACT = texts.sentence("Alice Vance wrote from u{4}@example.com about 555-{4}.", "(c_custkey % 40)")
_COLUMN_SQL = f"c_name || ' / ' || {_CONTACT}"


@query(
    "mask_columns",
    # Two columns share one numbering, so the check masks them as one text cut by a mark no rule matches.
    oracle.mask_rows(
        "SELECT c_custkey AS id, ("
        + _COLUMN_SQL + ") || chr(10) || '~#~' || chr(10) || (" + texts.pick(texts.OVERLAP_SENTENCES, "c_custkey")
        + ") AS text FROM customer",
        BASE,
        "SELECT id AS c_custkey, split_part(masked_text, chr(10) || '~#~' || chr(10), 1) AS contact,"
        " split_part(masked_text, chr(10) || '~#~' || chr(10), 2) AS note FROM masked",
    ),
)
def mask_columns(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select(
        "c_custkey", F.expr(_COLUMN_SQL).alias("contact"), F.expr(OVERLAP_TEXT).alias("note")
    )
    return mask.mask_columns(rows, ["contact", "note"]).select("c_custkey", "contact", "note")


_TURN_TEXT = (
    "text || ' Write to u' || CAST((conv_id * 7 + turn * turn) % 5 AS STRING) || '@example.com or 555-'"
    " || lpad(CAST(turn % 3 AS STRING), 4, '0') || ' or [PHONE_' || CAST(conv_id % 4 AS STRING) || ']'"
)
_TURNS = (
    f"SELECT conv_id * 100000 + turn AS id, conv_id, turn, {_TURN_TEXT} AS text FROM conversations"
)
# Placeholders already in a session push its numbers up.
_SESSION_TOKENS = (
    "firsts AS (SELECT d.conv_id, a.et, a.v, min((d.turn, a.s)) AS f FROM acc a JOIN src d ON d.id = a.id GROUP BY ALL),\n"
    "top AS (SELECT conv_id, et, max(n) AS top FROM (SELECT conv_id, regexp_extract(t, '^\\[(.+)_\\d+\\]$', 1) AS et,"
    " CAST(regexp_extract(t, '_(\\d+)\\]$', 1) AS INTEGER) AS n FROM (SELECT conv_id,"
    f" unnest(regexp_extract_all(text, {oracle.q(oracle.TOKEN_PATTERN)})) AS t FROM src)) GROUP BY ALL),\n"
    "tok AS MATERIALIZED (SELECT f.*, '[' || f.et || '_' || (row_number() OVER (PARTITION BY f.conv_id, f.et ORDER BY f.f)"
    " + coalesce(t.top, 0)) || ']' AS token FROM firsts f LEFT JOIN top t ON t.conv_id = f.conv_id AND t.et = f.et)"
)
_SESSION_MASK = (
    f"WITH src AS MATERIALIZED ({_TURNS}),\n{oracle.accepted(BASE)},\n{_SESSION_TOKENS},\n"
    + oracle.masked(
        join="JOIN src sd ON sd.id = a.id JOIN tok t ON t.conv_id = sd.conv_id AND t.et = a.et AND t.v = a.v"
    )
)


def _turns(spark: SparkSession, sf_dir: str, part: str = "true") -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").filter(part)
    return spread(turns, ["conv_id", "turn"]).select("conv_id", "turn", F.expr(_TURN_TEXT).alias("text"))


@query(
    "session_numbering",
    _SESSION_MASK + "\nSELECT s.conv_id, s.turn, m.masked_text FROM masked m JOIN src s ON s.id = m.id",
)
def session_numbering(spark, sf_dir):
    masked, _ = mask.sanitize_scope(_turns(spark, sf_dir), ["conv_id", "turn"], ["turn"], ["conv_id"])
    return masked.select("conv_id", "turn", "masked_text")


@query(
    "session_numbering_resumed",
    _SESSION_MASK + "\nSELECT s.conv_id, s.turn, m.masked_text, s.text AS revealed_text FROM masked m JOIN src s ON s.id = m.id",
)
def session_numbering_resumed(spark, sf_dir):
    """The early turns in one run, the later ones in another that goes on from the vault on disk, all revealed from it."""
    path, key = f"{scratch(spark)}/vault", b"0123456789abcdef"
    nothing = spark.createDataFrame([], "session_id string, token string, entity_type string, value string")
    early, first = mask.sanitize_scope(
        _turns(spark, sf_dir, "turn < 2"), ["conv_id", "turn"], ["turn"], ["conv_id"], vault=nothing
    )
    vault.write_vault(first, path, key)
    late, second = mask.sanitize_scope(
        _turns(spark, sf_dir, "turn >= 2"), ["conv_id", "turn"], ["turn"], ["conv_id"], vault=vault.read_vault(spark, path, key)
    )
    vault.write_vault(second, path, key)
    masked = cut_lineage(early.unionByName(late).select("conv_id", "turn", "masked_text"))
    back = reveal.reveal(masked, vault.read_vault(spark, path, key), ["conv_id", "turn"], "masked_text", "conv_id")
    return back.select("conv_id", "turn", "masked_text", "revealed_text")


@query(
    "vault_write_read",
    f"WITH src AS MATERIALIZED ({_TURNS}),\n{oracle.accepted(BASE)},\n{_SESSION_TOKENS}\n"
    "SELECT CAST(conv_id AS STRING) AS session_id, token, et AS entity_type, v AS value FROM tok",
)
def vault_write_read(spark, sf_dir):
    path, key = f"{scratch(spark)}/vault", b"0123456789abcdef"
    _, numbers = mask.sanitize_scope(_turns(spark, sf_dir), ["conv_id", "turn"], ["turn"], ["conv_id"])
    entries = vault.as_vault(numbers, ["conv_id"])
    vault.write_vault(entries, path, key)
    vault.write_vault(entries, path, key)  # adds nothing
    return vault.read_vault(spark, path, key)


@query(
    "session_vault",
    f"WITH src AS MATERIALIZED ({_TURNS}),\n{oracle.accepted(BASE)},\n{_SESSION_TOKENS}\n"
    "SELECT CAST(conv_id AS STRING) AS session_id, token, et AS entity_type, v AS value FROM tok",
)
def session_vault(spark, sf_dir):
    _, numbers = mask.sanitize_scope(_turns(spark, sf_dir), ["conv_id", "turn"], ["turn"], ["conv_id"])
    return vault.as_vault(numbers, ["conv_id"])


_CORPUS = (
    f"WITH src AS MATERIALIZED (SELECT doc_id AS id, doc_id, text FROM documents),\n{oracle.accepted(BASE)},\n"
    f"{oracle.scope_tokens(None, 'doc_id')}"
)


@query(
    "corpus_numbering",
    _CORPUS + ",\n" + oracle.masked(join="JOIN tok t ON t.et = a.et AND t.v = a.v")
    + "\nSELECT id AS doc_id, masked_text FROM masked",
)
def corpus_numbering(spark, sf_dir):
    masked, _ = mask.sanitize_scope(documents(spark, sf_dir), ["doc_id"], ["doc_id"])
    return masked.select("doc_id", "masked_text")


@query("corpus_vault", _CORPUS + "\nSELECT 'corpus' AS session_id, token, et AS entity_type, v AS value FROM tok")
def corpus_vault(spark, sf_dir):
    return vault.as_vault(mask.sanitize_scope(documents(spark, sf_dir), ["doc_id"], ["doc_id"])[1])


# --- vault and reports ----------------------------------------------------

_DOC_TOKENS = f"WITH src AS MATERIALIZED ({DOCS}),\n{oracle.accepted(BASE)},\n{oracle.row_tokens()}"


def _doc_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.token_map(mask.sanitize(documents(spark, sf_dir)), ["doc_id"])


@query(
    "vault_distinct",
    _DOC_TOKENS + "\nSELECT CAST(id AS STRING) AS session_id, token, et AS entity_type, v AS value FROM tok",
)
def vault_distinct(spark, sf_dir):
    return _doc_vault(spark, sf_dir)


@query(
    "entity_counts",
    _CORPUS + "\nSELECT et AS entity_type, count(DISTINCT token) AS n FROM tok GROUP BY et",
)
def entity_counts(spark, sf_dir):
    return report.entity_counts(corpus_vault(spark, sf_dir))


@query(
    "metrics_summary",
    _DOC_TOKENS + """
    , cnt AS (SELECT id, et, count(DISTINCT token) AS n FROM tok GROUP BY ALL),
    named AS (SELECT id, n,
      CASE et WHEN 'NAME' THEN 0 WHEN 'EMAIL' THEN 1 WHEN 'PHONE' THEN 2 WHEN 'ID' THEN 3 WHEN 'CUSTOM' THEN 4 ELSE 5 END AS r, et,
      CASE et WHEN 'NAME' THEN 'Name' WHEN 'EMAIL' THEN 'Email' WHEN 'PHONE' THEN 'Phone' WHEN 'CUSTOM' THEN 'Custom' ELSE et END AS w
      FROM cnt)
    SELECT CAST(id AS STRING) AS session_id,
      string_agg(n || ' ' || w || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY r, et) AS summary
    FROM named GROUP BY id""",
)
def metrics_summary(spark, sf_dir):
    return report.metrics_summary(_doc_vault(spark, sf_dir), ["session_id"])


@query("request_counts", "SELECT conv_id, count(*) AS requests FROM conversations GROUP BY conv_id")
def request_counts(spark, sf_dir):
    return report.request_counts(table(spark, sf_dir, "conversations"), ["conv_id"])


@query(
    "entity_profile",
    oracle.found(
        DOCS, BASE,
        "SELECT a.et AS entity_type, d.source, count(*) AS findings"
        " FROM acc a JOIN documents d ON d.doc_id = a.id GROUP BY ROLLUP (a.et, d.source)",
    ),
)
def entity_profile(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    return report.entity_profile(docs, ["source"]).select("entity_type", "source", "findings")


@query(
    "leak_audit",
    oracle.mask_rows(
        DOCS, BASE,
        "SELECT d.lang, t.et AS entity_type, count(*) AS checked,"
        " CAST(sum(CASE WHEN contains(m.masked_text, t.v) THEN 1 ELSE 0 END) AS BIGINT) AS leaked"
        " FROM tok t JOIN masked m ON m.id = t.id JOIN documents d ON d.doc_id = t.id GROUP BY ALL",
    ),
)
def leak_audit(spark, sf_dir):
    return report.leak_audit(mask.sanitize(_documents_by_lang(spark, sf_dir)), ["lang"])


def _documents_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])


@query("redetect_audit", "SELECT lang, count(*) AS checked, CAST(0 AS BIGINT) AS leaked FROM documents GROUP BY lang")
def redetect_audit(spark, sf_dir):
    return report.redetect_audit(mask.sanitize(_documents_by_lang(spark, sf_dir)), ["lang"])


_BUILT_VAULT = oracle.mask_rows(
    CUSTOMER.format(SECRET_TEXT), BASE,
    f"SELECT CAST(id AS STRING) AS session_id, token, v AS value, {oracle.has_secret('v')} AS is_secret,"
    f" {oracle.secret_names('v')} AS secrets FROM tok",
)


@query("vault_rescan", _BUILT_VAULT)
def vault_rescan(spark, sf_dir):
    masked = mask.sanitize(customer_texts(spark, sf_dir, SECRET_TEXT))
    scanned = vault.rescan_vault(vault.token_map(masked, ["c_custkey"]))
    return scanned.select(
        "session_id", "token", "value", "is_secret", F.array_join("secrets", ",").alias("secrets")
    )


@query(
    "policy_exempt",
    f"WITH src AS MATERIALIZED ({CUSTOMER.format(SECRET_TEXT)}),\n"
    + oracle.accepted(BASE).replace(
        "acc AS MATERIALIZED (SELECT id, s, e, et, rid, v FROM",
        "acc AS MATERIALIZED (SELECT id, s, e, et, rid, v FROM (SELECT * FROM",
    )[:-1]
    + f") WHERE NOT {oracle.has_secret('v')}),\n{oracle.row_tokens()},\n{oracle.masked()}\n"
    "SELECT id AS c_custkey, masked_text FROM masked",
)
def policy_exempt(spark, sf_dir):
    rows = customer_texts(spark, sf_dir, SECRET_TEXT)
    return policy.sanitize_with_policy(rows, {}, secrets="pass").select("c_custkey", "masked_text")


@query(
    "policy_flag",
    oracle.found(
        DOCS, BASE,
        "SELECT id AS doc_id, v AS value FROM acc WHERE et = 'IP'",
    ),
)
def policy_flag(spark, sf_dir):
    done = policy.sanitize_with_policy(documents(spark, sf_dir), {"IP": "flag", "CARD": "pass"})
    return done.select("doc_id", F.explode("flagged.value").alias("value"))


# --- reveal ---------------------------------------------------------------

@query("reveal_rows", "SELECT doc_id, text AS revealed_text FROM documents")
def reveal_rows(spark, sf_dir):
    return reveal.reveal_rows(mask.sanitize(documents(spark, sf_dir))).select("doc_id", "revealed_text")


@query(
    "reveal_roundtrip",
    oracle.found(
        DOCS, BASE,
        "SELECT d.doc_id, d.text AS revealed_text, CASE WHEN d.doc_id IN (SELECT id FROM acc) THEN 'restored'"
        " ELSE 'unchanged' END AS status FROM documents d",
    ),
)
def reveal_roundtrip(spark, sf_dir):
    masked = cut_lineage(mask.sanitize(documents(spark, sf_dir)).drop("text"))
    entries = vault.token_map(masked, ["doc_id"])
    texts_only = masked.select("doc_id", "masked_text")
    back = reveal.reveal(texts_only, entries, ["doc_id"], "masked_text", "doc_id")
    return back.select("doc_id", "revealed_text", "status")


@query("roundtrip_audit", "SELECT lang, count(*) AS checked, CAST(0 AS BIGINT) AS changed FROM documents GROUP BY lang")
def roundtrip_audit(spark, sf_dir):
    return report.roundtrip_audit(reveal.reveal_rows(mask.sanitize(_documents_by_lang(spark, sf_dir))), ["lang"])


_REPLY = (
    "CASE conv_id % 3 WHEN 0 THEN 'Mail [EMAIL_1] or [EMAIL_999].' WHEN 1 THEN 'Call [FAX_7]' ELSE 'No tokens' END"
)


@query(
    "reveal_unknown",
    f"WITH src AS MATERIALIZED ({_TURNS}),\n{oracle.accepted(BASE)},\n{_SESSION_TOKENS}\n"
    "SELECT c.conv_id, c.turn, CASE c.conv_id % 3 WHEN 0 THEN 'Mail ' || t.v || ' or [EMAIL_999].'"
    " WHEN 1 THEN 'Call [FAX_7]' ELSE 'No tokens' END AS revealed_text,"
    " CASE c.conv_id % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'unknown_tokens' ELSE 'unchanged' END AS status"
    " FROM conversations c LEFT JOIN tok t ON t.conv_id = c.conv_id AND t.token = '[EMAIL_1]'",
)
def reveal_unknown(spark, sf_dir):
    entries = session_vault(spark, sf_dir)
    replies = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("text"))
    back = reveal.reveal(replies, entries, ["conv_id", "turn"], "text", "conv_id")
    return back.select("conv_id", "turn", "revealed_text", "status")


@query(
    "reveal_empty_vault",
    "SELECT conv_id, turn, 'The answer went to [EMAIL_1] today.' AS revealed_text, 'empty_vault' AS status FROM conversations",
)
def reveal_empty_vault(spark, sf_dir):
    entries = session_vault(spark, sf_dir).filter("session_id = 'none'")
    replies = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lit("The answer went to [EMAIL_1] today.").alias("text")
    )
    back = reveal.reveal(replies, entries, ["conv_id", "turn"], "text", "conv_id")
    return back.select("conv_id", "turn", "revealed_text", "status")


_DOUBLED = (
    "CASE page_id % 4 WHEN 0 THEN 'https://' || url WHEN 1 THEN 'see mysql://MySQL://db' || CAST(page_id AS STRING)"
    " WHEN 2 THEN 'ftp://ftp://x redis://redis://y ' || url ELSE url END"
)


@query(
    "scheme_dedupe",
    # The kept scheme is the first of the two, as written.
    "SELECT page_id, " + oracle.dedupe_scheme(f"({_DOUBLED})") + " AS url FROM pages",
)
def scheme_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_DOUBLED).alias("url")).withColumn(
        "url", columns.dedupe_scheme("url")
    )


# --- guards ---------------------------------------------------------------

@query(
    "truncate_flag",
    "SELECT doc_id, length(text) > 3000 AS was_truncated, substring(text, 1, 3000) AS text FROM documents",
)
def truncate_flag(spark, sf_dir):
    cut = guards.truncate_text(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=3_000)
    return cut.select("doc_id", "was_truncated", "text")


@query(
    "null_quarantine",
    "SELECT doc_id, 'missing_text' AS reason FROM documents WHERE lang = 'de'"
    " UNION ALL SELECT doc_id, 'ok' AS reason FROM documents WHERE lang <> 'de'",
)
def null_quarantine(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '' ELSE text END").alias("text")
    )
    good, bad = guards.require_text(rows)
    return bad.select("doc_id", "reason").unionByName(good.select("doc_id", F.lit("ok").alias("reason")))


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of a file listing, some with a NUL byte early or late."""
    return table(spark, sf_dir, "documents").select(
        F.expr(
            "concat('/data/', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.DOCX'"
            " WHEN 2 THEN '.pdf' WHEN 3 THEN '.Xlsx' WHEN 4 THEN '.xls' ELSE '.md' END)"
        ).alias("path"),
        F.expr(
            f"CASE doc_id % 4 WHEN 0 THEN concat(repeat('x', {BINARY_SNIFF_BYTES - 1}), chr(0), text)"
            f" WHEN 1 THEN concat(repeat('x', {BINARY_SNIFF_BYTES}), chr(0), text)"
            " WHEN 2 THEN concat(chr(0), text) ELSE text END"
        ).cast("binary").alias("content"),
        "doc_id",
    ).withColumn("length", F.octet_length("content").cast("long"))


@query(
    "binary_guard",
    "SELECT doc_id, 'binary_file' AS reason FROM documents WHERE doc_id % 4 IN (0, 2)",
)
def binary_guard(spark, sf_dir):
    return guards.reject_binary(_as_files(spark, sf_dir))[1].select("doc_id", "reason")


@query(
    "size_guard",
    "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'file_too_large' ELSE 'ok' END AS reason FROM documents",
)
def size_guard(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    good, bad = guards.max_file_size(listed, 4_000)
    return bad.select("doc_id", "reason").unionByName(good.select("doc_id", F.lit("ok").alias("reason")))


@query(
    "format_route",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'xlsx'"
    " WHEN 4 THEN 'xls' ELSE 'text' END AS format FROM documents",
)
def format_route(spark, sf_dir):
    return guards.route_by_format(_as_files(spark, sf_dir)).select("doc_id", "format")


@query(
    "missing_paths",
    "SELECT '/data/' || CAST(doc_id AS STRING) AS path, 'missing_file' AS reason FROM documents"
    " WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_paths(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").selectExpr("concat('/data/', CAST(doc_id AS STRING)) AS path")
    found = table(spark, sf_dir, "labels").selectExpr("concat('file:///data/', CAST(doc_id AS STRING)) AS path")
    return guards.missing_path_report(asked, found)


# --- files ----------------------------------------------------------------

@query(
    "docx_text",
    "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) AS text FROM documents",
)
def docx_text(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("CAST(doc_id AS STRING) AS path", "text")
    packed = docs.mapInArrow(samples.pack_docx, "path string, content binary")
    return files.read_docx(packed).selectExpr("CAST(path AS BIGINT) AS doc_id", "text")


_CELL = texts.sentence("alice{5}@company.com,\"x\"", "c_custkey")


@query(
    "xlsx_text",
    f"SELECT c_custkey, '--- Sheet: Sheet1 ---' || chr(10) || 'Name,Contact' || chr(10) || c_name || ',\"' ||"
    f" replace({_CELL}, '\"', '\"\"') || '\"' || chr(10) AS text FROM customer",
)
def xlsx_text(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select(
        F.col("c_custkey").cast("string").alias("path"),
        F.array(F.lit("Name"), F.lit("Contact")).alias("header"),
        F.array("c_name", F.expr(_CELL)).alias("row"),
    )
    packed = rows.mapInArrow(samples.pack_xlsx, "path string, content binary")
    return files.read_xlsx(packed).selectExpr("CAST(path AS BIGINT) AS c_custkey", "text")


@query("text_files", "SELECT doc_id, text FROM documents")
def text_files(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")
    )
    return files.decode_text(listed).selectExpr("CAST(path AS BIGINT) AS doc_id", "text")


_LINE = "'u' || CAST(page_id AS STRING) || '@example.com ' || url"


@query(
    "text_file_lines",
    oracle.mask_rows(f"SELECT page_id AS id, {_LINE} AS text FROM pages", BASE,
                     "SELECT m.masked_text, s.text FROM masked m JOIN src s ON s.id = m.id"),
)
def text_file_lines(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "pages").select(F.expr(_LINE).alias("value")).write.text(path)
    return mask.sanitize(files.read_text_files(spark, path, whole=False)).select("text", "masked_text")


@query(
    "tabular_csv",
    oracle.mask_rows(
        "SELECT c_custkey AS id, " + _COLUMN_SQL + " AS text FROM customer", BASE,
        "SELECT id AS c_custkey, masked_text AS contact FROM masked",
    ),
)
def tabular_csv(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", F.expr(_COLUMN_SQL).alias("contact")).write.csv(path)
    rows = files.read_tabular(spark, "csv", path, "c_custkey bigint, contact string")
    return files.sanitize_table(rows, ["contact"]).select("c_custkey", "contact")


# --- SQL functions --------------------------------------------------------

@query(
    "sql_mask_function",
    oracle.mask_rows(CUSTOMER.format(SECRET_TEXT), BASE, "SELECT id AS c_custkey, masked_text FROM masked"),
)
def sql_mask_function(spark, sf_dir):
    columns.register_sql_functions(spark)
    customer_texts(spark, sf_dir, SECRET_TEXT).createOrReplaceTempView("hushframe_secret_texts")
    return spark.sql("SELECT c_custkey, pii_mask(text, 'general') AS masked_text FROM hushframe_secret_texts")


@query(
    "sql_findings_function",
    oracle.found(
        CUSTOMER.format(SECRET_TEXT), BASE, "SELECT id AS c_custkey, et AS entity_type, v AS value FROM acc"
    ),
)
def sql_findings_function(spark, sf_dir):
    columns.register_sql_functions(spark)
    customer_texts(spark, sf_dir, SECRET_TEXT).createOrReplaceTempView("hushframe_secret_texts")
    return spark.sql(
        "SELECT c_custkey, f.entity_type, f.value FROM hushframe_secret_texts, LATERAL pii_findings(text, 'general') f"
    )


@query("sql_redact_function", oracle.redacted(DOCS, BASE, "SELECT id AS doc_id, masked_text AS redacted_text FROM masked"))
def sql_redact_function(spark, sf_dir):
    columns.register_sql_functions(spark)
    documents(spark, sf_dir).createOrReplaceTempView("hushframe_documents")
    return spark.sql("SELECT doc_id, pii_redact(text, 'general') AS redacted_text FROM hushframe_documents")


@query("sql_secrets_function", f"SELECT doc_id, {oracle.secret_names('text')} AS secrets FROM documents")
def sql_secrets_function(spark, sf_dir):
    columns.register_sql_functions(spark)
    documents(spark, sf_dir).createOrReplaceTempView("hushframe_documents")
    return spark.sql("SELECT doc_id, array_join(pii_secrets(text), ',') AS secrets FROM hushframe_documents")


@query("sql_reveal_function", "SELECT doc_id, text AS revealed_text FROM documents")
def sql_reveal_function(spark, sf_dir):
    columns.register_sql_functions(spark)
    mask.sanitize(documents(spark, sf_dir)).createOrReplaceTempView("hushframe_masked")
    return spark.sql(
        "SELECT doc_id, pii_reveal(masked_text, map_from_entries(transform(tokens, t -> struct(t.token, t.value))))"
        " AS revealed_text FROM hushframe_masked"
    )


# --- streams --------------------------------------------------------------

def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # A pattern, because a stream takes a plain path for a folder, and a table may be one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query("stream_mask_lines", _MASK_DOCS)
def stream_mask_lines(spark, sf_dir):
    folder = scratch(spark)
    source = _stream(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    done = lines.mask_stream(source).select("doc_id", "masked_text")
    lines.write_append(done, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("doc_id bigint, masked_text string").parquet(f"{folder}/out")


@query(
    "stream_session_mask",
    _SESSION_MASK + "\nSELECT s.conv_id, s.turn, m.masked_text FROM masked m JOIN src s ON s.id = m.id",
)
def stream_session_mask(spark, sf_dir):
    folder = scratch(spark)
    source = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN_TEXT).alias("text"))
    lines.mask_session_stream(
        source, f"{folder}/out", f"{folder}/vault", f"{folder}/state", ["conv_id", "turn"], "conv_id", ["turn"]
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "masked_text")


@query(
    "stream_secret_alerts",
    f"SELECT c_custkey, {oracle.secret_names('text')} AS secrets FROM"
    f" (SELECT c_custkey, {SECRET_TEXT} AS text FROM customer) WHERE {oracle.has_secret('text')}",
)
def stream_secret_alerts(spark, sf_dir):
    folder = scratch(spark)
    source = _stream(spark, sf_dir, "customer").select("c_custkey", F.expr(SECRET_TEXT).alias("value"))
    alerts = lines.secret_alerts(source).select("c_custkey", F.array_join("secrets", ",").alias("secrets"))
    lines.write_append(alerts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("c_custkey bigint, secrets string").parquet(f"{folder}/out")


@query(
    "stream_reveal",
    f"WITH src AS MATERIALIZED ({_TURNS}),\n{oracle.accepted(BASE)},\n{_SESSION_TOKENS}\n"
    "SELECT c.conv_id, c.turn, CASE c.conv_id % 3 WHEN 0 THEN 'Mail ' || t.v || ' or [EMAIL_999].'"
    " WHEN 1 THEN 'Call [FAX_7]' ELSE 'No tokens' END AS revealed_text"
    " FROM conversations c LEFT JOIN tok t ON t.conv_id = c.conv_id AND t.token = '[EMAIL_1]'",
)
def stream_reveal(spark, sf_dir):
    folder = scratch(spark)
    entries = session_vault(spark, sf_dir)
    source = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("text"))
    lines.reveal_stream(
        source, entries, f"{folder}/out", f"{folder}/state", ["conv_id", "turn"], "text", "conv_id"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "revealed_text")


@query(
    "stream_two_outputs",
    oracle.mask_rows(
        f"SELECT page_id AS id, {_LINE} AS text FROM pages", BASE,
        "SELECT CASE WHEN id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, masked_text FROM masked",
    ),
)
def stream_two_outputs(spark, sf_dir):
    folder = scratch(spark)
    pages = table(spark, sf_dir, "pages")
    for rest, name in enumerate(("stdout", "stderr")):
        pages.filter(f"page_id % 2 = {rest}").select(F.expr(_LINE).alias("value")).write.text(f"{folder}/{name}")
    both = lines.both_streams(*[lines.read_line_stream(spark, f"{folder}/{name}", name) for name in ("stdout", "stderr")])
    done = lines.mask_stream(both).select("stream", "masked_text")
    lines.write_append(done, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("stream string, masked_text string").parquet(f"{folder}/out")
