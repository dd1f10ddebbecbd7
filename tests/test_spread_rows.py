"""Heavy work is spread by the splits that hold rows, not by those a file is cut into."""

from pyspark.sql import functions as F

from hushframe.operators.skew import spread

SIZES = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "8k"}


def filled(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_row_group_in_many_splits(spark, tmp_path):
    rows = spark.range(20_000).withColumn("text", F.concat(F.lit("row "), F.col("id")))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    before = {name: spark.conf.get(name) for name in SIZES}
    for name, value in SIZES.items():
        spark.conf.set(name, value)
    try:
        df = spark.read.parquet(str(tmp_path / "one"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and filled(df) == 1
        done = spread(df, ["id"])
        assert filled(done) == spark.sparkContext.defaultParallelism
        assert sorted(done.collect()) == sorted(df.collect())
        assert spread(done, ["id"]) is done
        plan = done.filter(F.col("text").rlike("7$"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("RLIKE") < plan.index("RepartitionByExpression")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
