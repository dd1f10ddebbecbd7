"""How far the sources of a language diverge in their terms, by cells of (group block, group block, term block)."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import LOWER, UPPER, query, stored, table

# On UTF-8 bytes: A-Z become a-z, all other ASCII characters that are no letters become spaces.
_TERM_BYTES = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))
# A task hands on its counts when it holds so many, and reads a long text by so many bytes at a time.
COUNTS_AT_ONCE, BYTES_AT_ONCE = 500_000, 4 << 20


def _term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of bounded length."""
    raw = text.encode().translate(_TERM_BYTES)
    at = 0
    while len(raw) - at > BYTES_AT_ONCE:
        cut = raw.find(b" ", at + BYTES_AT_ONCE)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def count_terms(df: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: counts and documents of every term in every group of ``(lang, source, text)``.

    Each group also has a row with a null term.  Tasks count before the shuffle, so
    a hot group or a frequent term is a few rows of each task.
    """

    def rows(counts: dict) -> pa.RecordBatch:
        langs, sources, terms, often, docs = [], [], [], [], []
        for (lang, source), (n, d) in counts.items():
            langs += [lang] * (len(n) + 1)
            sources += [source] * (len(n) + 1)
            terms += [None, *n]
            often += [0, *n.values()]
            docs += [0, *map(d.__getitem__, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(often, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                seen: set[bytes] = set()
                for terms in _term_lists(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(n) - before
                if held > COUNTS_AT_ONCE:
                    yield rows(counts)
                    counts, held = {}, 0
        if counts:
            yield rows(counts)

    parts = df.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column, smoothing: int, scale: int) -> Column:
    """``1 + floor(scale * (n + smoothing) / (total + smoothing * kept))``, exactly; null without kept terms."""
    wide = "decimal(19,0)"
    above = F.lit(scale).cast("decimal(13,0)") * (n + smoothing).cast(wide)
    below = F.nullif(total + F.lit(smoothing) * kept, F.lit(0)).cast(wide)
    return F.lit(1) + F.call_function("div", above, below)


def _partial(table_: pa.Table) -> pa.Table:
    """One cell: summed differences over the terms that any group of its two blocks has, for every pair of groups.

    Rows without a term name the groups of the blocks and their value for terms they do not have.
    """
    lang, low, high = (table_.column(c)[0].as_py() for c in ("lang", "low", "high"))
    marks = table_.filter(pa.compute.is_null(table_.column("term")))
    rows = table_.filter(pa.compute.is_valid(table_.column("term")))
    order = np.argsort(marks.column("block").to_numpy(), kind="stable")
    names = marks.column("source").take(pa.array(order))
    base = marks.column("p").to_numpy()[order]
    first = int((marks.column("block").to_numpy() == low).sum())
    terms = pa.compute.unique(rows.column("term"))
    dense = np.repeat(base[:, None], len(terms), axis=1)
    at = pa.compute.index_in(rows.column("source"), names).to_numpy()
    dense[at, pa.compute.index_in(rows.column("term"), terms).to_numpy()] = rows.column("p").to_numpy()
    left, right, values = [], [], []
    for a in range(first):
        b = np.arange(a + 1 if low == high else first, len(base))
        left.append(np.full(len(b), a))
        right.append(b)
        values.append(np.abs(dense[b] - dense[a]).sum(axis=1))
    left, right, values = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right, values))
    return pa.table({
        "lang": pa.array([lang] * len(left), pa.string()),
        "a": names.take(pa.array(left)).cast(pa.string()),
        "b": names.take(pa.array(right)).cast(pa.string()),
        "part": values,
        "terms": np.full(len(left), len(terms), np.int64),
        "gap": np.abs(base[left] - base[right]),
    })


def source_divergence(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 30,
    smoothing: int = 5,
    scale: int = 1_000_000_000,
    top: int = 50,
    group_block: int = 16,
    term_block: int = 4_096,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: divergence of every group from the others of its language.

    A group is a (lang, source) that occurs; null text, lang and source are empty.
    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language
    keeps those in at least ``min_docs`` of its documents.  A term's share in a group is
    ``1 + floor(scale * (count + smoothing) / (N + smoothing * V))``, in whole numbers.

    Part ``pair``: for each other source of the language the sum of differences of
    shares over all kept terms (0 without kept terms).  Part ``term``: the ``top`` kept
    terms of the group whose share is above that in the whole language, by how much.

    Groups and terms are dealt to blocks by hash.  The slice (group block, term block) goes
    to all cells of its group block, so a cell holds two blocks of groups and one of
    terms, whatever the table's size; cells are added up along the term axis, and terms
    that neither group has are added by their number.  Repeated rows are documents like
    all others, ties go by item in UTF-8 order, an empty table gives no rows, groups
    without terms take part, and other columns play no part.
    """
    texts = df.select(*[
        F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(name)
        for column, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    ])
    in_lang = Window.partitionBy("lang", "term")
    marker = F.col("term").isNull()
    kept = stored(
        count_terms(texts)
        .withColumn("lang_docs", F.sum("docs").over(in_lang))
        .withColumn("lang_n", F.sum("n").over(in_lang))
        .withColumn("first", (F.min("source").over(in_lang) == F.col("source")) & ~marker)
        .filter(marker | (F.col("lang_docs") >= min_docs))
        .drop("docs", "lang_docs"),
        "divergence-terms",
    )
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"), F.sum(marker.cast("long")).alias("groups")
    )
    rows = kept.join(groups, ["lang", "source"]).join(langs, "lang").withColumn(
        "p", F.coalesce(_share(F.col("n"), F.col("group_total"), F.col("kept"), smoothing, scale), F.lit(0))
    )

    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), smoothing, scale)
    terms = (
        rows.filter(~marker)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value"))
        .filter("value > 0")
        .withColumn("rank", F.row_number().over(by_group))
        .filter(F.col("rank") <= top)
    )

    group_blocks = F.ceil(F.col("groups") / group_block)
    term_blocks = F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1))
    cells = (
        rows.select(
            "lang", "source", "term", "p",
            F.pmod(F.xxhash64("source"), group_blocks).alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), group_blocks - 1)).alias("other"),
            F.when(marker, F.sequence(F.lit(0).cast("long"), term_blocks - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("term"), term_blocks))).alias("slices"),
        )
        .select(
            "lang", "source", "term", "p", "block", F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"), F.explode("slices").alias("slice"),
        )
        .groupBy("lang", "low", "high", "slice")
        .applyInArrow(_partial, "lang string, a string, b string, part long, terms long, gap long")
    )
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))
    ))
    pairs = (
        cells.groupBy("lang", "a", "b")
        .agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"), F.max("gap").alias("gap"))
        .join(langs.select("lang", "kept"), "lang")
        .select("lang", both.alias("pair"), (F.col("part") + (F.col("kept") - F.col("terms")) * F.col("gap")).alias("value"))
        .select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value")
        .withColumn("rank", F.row_number().over(by_group))
    )
    return pairs.unionByName(terms)


SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
l AS (
  SELECT lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how far each source is from the others of its language, and by which terms it stands out."""
    return source_divergence(table(spark, sf_dir, "documents"))
