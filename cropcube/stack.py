"""The region's stack: products as views of one partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = ("S1_ASCENDING", "S1_DESCENDING", "S1_ASCENDING_GLCM", "S1_DESCENDING_GLCM", "S2", "LE07", "LC08")


class RegionStack:
    """``stack["S2"]`` is that product's cube, ``LC08`` its harmonised version where the store has one.

    ``between`` adds the months of a range of dates as a predicate on the partitions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.df = spark.read.parquet(path)

    def __getitem__(self, product: str) -> DataFrame:
        if product == "LC08" and not self.df.where(F.col("product") == "hLC08").limit(1).isEmpty():
            product = "hLC08"
        return self.df.where(F.col("product") == product)

    def products(self) -> list[str]:
        return sorted(r[0] for r in self.df.select("product").distinct().collect())

    def between(self, product: str, start: str, end: str) -> DataFrame:
        first, last = start[:7].replace("-", ""), end[:7].replace("-", "")
        return self[product].where(F.col("month").cast("string").between(first, last)).where(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
