"""URL filters: a cascade of Bloom filters that answers membership exactly and without joins.

Level 0 encodes the listed keys.  Level 1 encodes the keys of the corpus that level
0 wrongly lets through, level 2 the listed keys that level 1 wrongly lets through,
and so on until a level lets nothing wrong through.  As every level is built against
the complete key universe of the corpus, a key of that universe is listed exactly if
the first level that rejects it is an odd one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import ascii_lower, cut_lineage, query, table

# Largest filter of one level that is put into a plan; more listed keys than fit are an error, not a cut.
MAX_LEVEL_BYTES = 64 << 20
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits in 64-bit words, ``hashes`` probes, salted by ``seed``."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        """The probed bits of a key, by double hashing."""
        first = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.bits))
        second = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.bits))
        return [F.pmod(first + F.lit(i) * second, F.lit(self.bits)) for i in range(self.hashes)]

    def might_contain(self, key: Column, plain: bool = False) -> Column:
        """Whether the filter lets a key through; ``plain`` says that the key is a stored column, cheap to read again."""
        # One string literal, which is parsed once, when the plan is optimised.
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")

        def test(key: Column) -> Column:
            found = F.lit(True)
            for bit in self.positions(key):
                word = F.get(words, F.shiftright(bit, 6).cast("int"))
                found = found & (F.call_function("shiftright", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
            return found

        # Otherwise the key stands here once, so what it is made from is worked out once a row.
        return test(key) if plain else F.exists(F.array(key), test)


def bloom(keys: DataFrame, n_keys: int, false_positives: float, seed: int) -> Level:
    """A Bloom filter of column ``key``; its words, bounded by ``MAX_LEVEL_BYTES``, are gathered by an aggregation."""
    bits = max(64, math.ceil(-max(n_keys, 1) * math.log(false_positives) / math.log(2) ** 2 / 64) * 64)
    if bits // 8 > MAX_LEVEL_BYTES:
        raise ValueError(f"{n_keys} listed keys need a filter of {bits // 8} bytes; raise MAX_LEVEL_BYTES")
    hashes = max(1, round(bits / max(n_keys, 1) * math.log(2)))
    hashes = min(hashes, 16)
    level = Level((), bits, hashes, seed)
    set_words = (
        keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("value"))
    )
    words = [0] * (bits // 64)
    for row in set_words.toLocalIterator():
        words[row["word"]] = row["value"]
    return Level(tuple(words), bits, hashes, seed)


class Cascade:
    """Exact membership, among the keys it was built against, as a column expression."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def contains(self, key: Column) -> Column:
        # Past the last level nothing wrong is left: what passed an even level is listed.
        answer = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[at].might_contain(key), F.lit(at % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` against ``universe`` (both with a string column ``key``, repeats allowed).

    Only the keys that a level lets through by mistake are kept for the next one,
    so everything after the first scan of the universe is about as small as the list.
    """
    listed = cut_lineage(listed.filter(F.col("key").isNotNull()).distinct())
    n_listed = listed.count()
    if n_listed == 0:
        return Cascade([])
    n_other = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n_listed / max(n_other, 1)))
    inside, n_inside = listed, n_listed
    levels = [bloom(inside, n_inside, rate, 0)]
    outside = cut_lineage(
        universe.filter(levels[0].might_contain(F.col("key"))).distinct().join(listed, "key", "left_anti")
    )
    while (n_outside := outside.count()) > 0:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not converge")
        level = bloom(outside, n_outside, 0.5, len(levels))
        levels.append(level)
        # The roles change: the keys just encoded are "inside" for the next level.
        wrong = cut_lineage(inside.filter(level.might_contain(F.col("key"))))
        inside, outside = outside, wrong
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def candidate_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Host suffix + path prefix, for the label counts and path lengths that rules have."""
    keys = []
    for n in labels:
        for size in lengths:
            fits = (F.size(F.split(host, r"\.")) >= n) & (F.length(path) >= size)
            keys.append(F.when(fits, F.concat(F.substring_index(host, ".", -n), F.left(path, F.lit(size)))))
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def listed_hits(keys: Column, cascade: Cascade, verdict: str) -> Column:
    """The keys that the cascade holds, as structs that order by length, then by host length."""

    def hit(key: Column) -> Column:
        return F.struct(
            F.length(key).alias("size"), F.instr(key, "/").alias("host_size"), key.alias("key"), F.lit(verdict).alias("verdict")
        )

    return F.transform(F.filter(keys, cascade.contains), hit)


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``df`` with ``host, path, rule, verdict`` (columns of these names are replaced).

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains
    if the path starts with the rule's; of several that fit the longest (host and
    path together, then the longer host) decides.  Without one, ``rule`` is null
    and the verdict is ``default``, as every key of the corpus that the cascades
    do not hold is known to be unlisted.  A null url, or one without ``://``, has
    an empty host and path.  Repeated rows each get their verdict.

    One cascade is built per verdict.  Rules given twice with different verdicts
    are refused.
    """
    seen: dict[str, str] = {}
    for verdict, host, path in rules:
        if seen.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"rule {host + path} has two verdicts")
        if "/" in host or not path.startswith("/"):
            raise ValueError(f"rule {host + path}: a host has no '/', a path starts with one")
    labels = sorted({len(host.split(".")) for _, host, _ in rules})
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = host_and_path(F.col(url_col))
    rows = df.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths)
    universe = rows.select(F.explode(keys).alias("key"))
    spark = df.sparkSession
    schema = T.StructType([T.StructField("key", T.StringType())])
    hits, verdict_of = [], F.lit(default)
    for verdict in sorted(set(seen.values())):
        listed = spark.createDataFrame([(key,) for key, v in seen.items() if v == verdict], schema)
        cascade = build_cascade(listed, universe)
        hits.append(listed_hits(F.col("__url_keys"), cascade, verdict))
    if not hits:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": verdict_of})
    best = F.array_max(F.concat(*hits))
    return (
        rows.withColumn("__url_keys", keys)
        .withColumn("__url_best", best)
        .withColumns({"rule": F.col("__url_best.key"), "verdict": F.coalesce(F.col("__url_best.verdict"), verdict_of)})
        .drop("__url_keys", "__url_best")
    )


# The rules of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path FROM parts
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, r.rule, coalesce(r.verdict, 'allow') AS verdict FROM split s LEFT JOIN hits r USING (page_id)
"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
