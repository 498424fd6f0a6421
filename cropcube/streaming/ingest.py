"""Incremental ingest: months that are new are appended, those that are there are skipped; as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTS = ("product", "month")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("time", "yyyyMM"))


def missing(found: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is not processed yet."""
    return found.join(done.select(*on).distinct(), on, "left_anti")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store, or no rows of its schema if nothing is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_months(df: DataFrame, path: str) -> int:
    """Append the (product, month) partitions that the store lacks; the number of rows written."""
    df = with_month(df)
    new = missing(df, stored(df.sparkSession, path, df.schema), list(PARTS))
    n = new.count()
    if n:
        new.repartition(*PARTS).sortWithinPartitions("y", "x").write.mode("append").partitionBy(*PARTS).parquet(path)
    return n


def overwrite_months(df: DataFrame, path: str) -> None:
    """Replace just the partitions that ``df`` has."""
    with_month(df).repartition(*PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def stream_months(spark: SparkSession, source: str, schema, path: str, checkpoint: str) -> StreamingQuery:
    """Files that arrive in a folder go to the store, each once; runs until what is there is read."""
    stream = with_month(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").partitionBy(*PARTS).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_monthly_fraction(spark: SparkSession, source: str, schema, delay: str = "40 days") -> DataFrame:
    """Clear fraction by product and calendar month (its first instant) over a stream of pixels; a month closes when another one begins more than ``delay`` after its start."""
    s = spark.readStream.schema(schema).parquet(source).withColumn("month", F.date_trunc("month", F.col("time").cast("timestamp"))).withWatermark("month", delay)
    return s.groupBy("product", "month").agg(F.avg(F.col("mask").cast("int").cast("double")).alias("fraction"), F.count("*").alias("n"))


def training_rows(df: DataFrame, sets: list[str], keys: list[str]) -> DataFrame:
    """Class sets as rows: (keys, set, vclass) with a class above 0."""
    return df.unpivot(keys, sets, "set", "vclass").where("vclass > 0")


def write_training(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set", "time").parquet(path)
