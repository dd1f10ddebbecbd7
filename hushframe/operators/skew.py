"""Joins and numbering that hold up when one key owns a large share of the rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
ROWS_PER_SALT = 1_000_000
# Up to this many splits a core, some of them may be empty.
SPLITS_TRUSTED = 8
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where Spark itself is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="hushframe-")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Whatever is run inside leaves no shuffle files behind: for results that are written and read from there on.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint()


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Use every core for heavy row-local work when the input has fewer splits with rows than that.

    A file's rows all lie in as few splits as it has row groups, so splits near the
    number of cores are looked at (the row counts of the files say it).  On a large
    table the scan has many more splits than cores and stays as it is.  Filters set on
    the result are not moved before the shuffle, where a heavy one would run in the
    few full splits; cheap ones belong before this call.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits > SPLITS_TRUSTED * cores:
        return df
    if splits >= cores and df.select(F.spark_partition_id().alias("_split")).distinct().count() >= cores:
        return df
    return df.repartition(cores, *keys).filter(F.spark_partition_id() >= 0)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, matching null with null, keeping the left key columns."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition = None
    for key in keys:
        test = left[key].eqNullSafe(renamed[f"_right_{key}"])
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def heavy_keys(
    counts: DataFrame, keys: Sequence[str], count_col: str, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """The keys worth salting, with their number of salts: at most one key per ``rows_per_salt`` rows counted."""
    return counts.filter(F.col(count_col) > rows_per_salt).select(
        *keys, F.ceil(F.col(count_col) / rows_per_salt).cast("int").alias("_salts")
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    heavy: DataFrame,
    heavy_on: Sequence[str],
    spread_on: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Equi-join ``left`` with ``right`` (unique per ``keys``), spreading the heavy keys.

    Left rows of a heavy key get one of its salts; right rows of that key are
    repeated once per salt.  All other keys keep salt 0 and are not repeated.
    ``heavy`` comes from ``heavy_keys``: every key above the threshold, so a list far
    shorter than the rows.  Spark picks its join; without heavy keys this is a plain one.
    """
    if heavy.isEmpty():
        return join_null_safe(left, right, keys, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    probe = (
        join_null_safe(left, heavy, heavy_on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_on), salts).cast("int"))
        .drop("_salts")
    )
    build = (
        join_null_safe(right, heavy, heavy_on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return join_null_safe(probe, build, [*keys, "_salt"], how).drop("_salt")


def number_within(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str,
    start: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, whatever the group sizes.

    ``start`` (group columns and ``_start``) says after which number a group begins.

    Rows are range-partitioned by (group, order), so one huge group spans many
    slices.  Each slice is ranked by itself and shifted by the sizes of the
    slices before it; there is at most one shift row per group and slice.  The
    slice number is read back from a checkpoint, so both uses of it agree.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.repartitionByRange(slices, *groups, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*groups, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    )
    if start is not None:
        # Added to the few shift rows rather than to the numbered ones, which one group may dominate.
        shifts = join_null_safe(shifts, start, groups, "left").select(
            *groups, "_slice", (F.col("_shift") + F.coalesce("_start", F.lit(0))).alias("_shift")
        )
    in_slice = Window.partitionBy(*groups, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(in_slice))
    return (
        join_null_safe(ranked, shifts, [*groups, "_slice"], "inner")
        .withColumn(name, (F.col("_rank") + F.col("_shift")).cast("long"))
        .drop("_rank", "_shift", "_slice")
    )
