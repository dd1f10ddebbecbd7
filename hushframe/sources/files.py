"""File sources: listing, guards and one reader per format."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.catalog import MAX_FILE_BYTES, Rule
from hushframe.operators.guards import is_binary, max_file_size, route_by_format
from hushframe.operators.mask import mask_columns, sanitize
from hushframe.sources import office
from hushframe.sources.office import parse_docx, parse_xlsx

# Send the parsers themselves to the workers, which then need no copy of this package.
cloudpickle.register_pickle_by_value(office)

# Paths looked up at the same time.
PROBES_AT_ONCE = 16
_TEXT_OUT = "path string, text string, reason string"
_SHEETS_OUT = "path string, sheet_no int, sheet string, csv string, reason string"


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """``(path, modificationTime, length, content)``; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path)


def read_text_files(spark: SparkSession, path: str | list[str], whole: bool = True) -> DataFrame:
    """Text files: one row per file, or one row per line."""
    lines = spark.read.option("wholetext", whole).text(path)
    return lines.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def decode_text(files: DataFrame) -> DataFrame:
    """UTF-8 text of listed files; malformed bytes become the replacement character."""
    text = F.expr("try_validate_utf8(cast(content AS string))")
    return files.select("path", F.coalesce(text, F.expr("make_valid_utf8(cast(content AS string))")).alias("text"))


def read_docx(files: DataFrame) -> DataFrame:
    """Text of word-processor files: (path, text, reason)."""
    return files.select("path", "content").mapInArrow(parse_docx, _TEXT_OUT)


def read_xlsx_sheets(files: DataFrame) -> DataFrame:
    """One row per sheet: (path, sheet_no, sheet, csv, reason)."""
    return files.select("path", "content").mapInArrow(parse_xlsx, _SHEETS_OUT)


def read_xlsx(files: DataFrame) -> DataFrame:
    """Text of workbooks: a title line and the CSV of each sheet, in order."""
    part = F.concat(F.lit("--- Sheet: "), "sheet", F.lit(" ---\n"), "csv", F.lit("\n"))
    sheets = F.sort_array(F.collect_list(F.struct("sheet_no", part.alias("part"))))
    return (
        read_xlsx_sheets(files)
        .groupBy("path")
        .agg(
            F.array_join(F.transform(sheets, lambda s: s["part"]), "").alias("text"),
            F.max("reason").alias("reason"),
        )
        .withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))
    )


def probe_paths(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """The requested paths that are there (files, folders, patterns with a match), and those that are not.

    Each is looked up through the Hadoop file system of its scheme, several at a
    time; only the list that the caller gave is held.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = hadoop.Path(path)
        found = at.getFileSystem(conf).globStatus(at)
        return found is not None and len(found) > 0

    with ThreadPoolExecutor(PROBES_AT_ONCE) as pool:
        known = list(pool.map(there, paths))
    return [p for p, ok in zip(paths, known, strict=True) if ok], [p for p, ok in zip(paths, known, strict=True) if not ok]


def read_documents(
    spark: SparkSession, path: str | list[str], max_bytes: int = MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Texts of all readable files under ``path``, and a quarantine ``(path, reason)``.

    Requested paths that do not exist are quarantined as ``missing_file``.  Files are
    checked for size, routed by suffix, and plain files for NUL bytes.  The size
    test needs no content, so large files are never read.
    """
    present, absent = probe_paths(spark, [path] if isinstance(path, str) else list(path))
    missing = spark.createDataFrame([(p, "missing_file") for p in absent], "path string, reason string")
    if not present:
        return spark.createDataFrame([], "path string, text string"), missing
    listed = route_by_format(list_files(spark, present))
    small, large = max_file_size(listed, max_bytes)
    plain = small.filter("format = 'text'")
    office = read_docx(small.filter("format = 'docx'")).unionByName(read_xlsx(small.filter("format = 'xlsx'")))
    texts = decode_text(plain.filter(~is_binary())).unionByName(
        office.filter("reason IS NULL").select("path", "text")
    )
    unsupported = small.filter("format IN ('pdf', 'xls')").select(
        "path", F.concat(F.lit("unsupported_"), "format").alias("reason")
    )
    quarantine = (
        large.select("path", "reason")
        .unionByName(plain.filter(is_binary()).select("path", F.lit("binary_file").alias("reason")))
        .unionByName(unsupported)
        .unionByName(office.filter("reason IS NOT NULL").select("path", "reason"))
        .unionByName(missing)
    )
    return texts, quarantine


def sanitize_files(
    spark: SparkSession,
    path: str | list[str],
    profile: str | None = "general",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Mask all readable files under ``path``: ``(path, masked_text, tokens)`` and a quarantine.

    Each file has its own numbering.
    """
    texts, quarantine = read_documents(spark, path)
    masked = sanitize(texts, "text", profile, rules, exclusions)
    return masked.select("path", "masked_text", "tokens"), quarantine


def read_tabular(spark: SparkSession, fmt: str, path: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """A CSV, JSON, ORC or Parquet table under an explicit schema (none is inferred)."""
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def sanitize_table(df: DataFrame, text_cols: Sequence[str], **kwargs) -> DataFrame:
    """Mask chosen string columns of a table; each record has its own numbering."""
    return mask_columns(df, text_cols, **kwargs)


def write_masked(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write masked rows.  The token arrays hold the originals, so they are left out."""
    out = df.drop("tokens", "flagged", "text") if "masked_text" in df.columns else df.drop("tokens", "flagged")
    if fmt == "text":
        out = out.select("masked_text")
    out.write.mode("errorifexists").partitionBy(*partition_by).format(fmt).save(path)
