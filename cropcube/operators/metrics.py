"""Accuracy of classifications from (truth, pred) rows, and statistics of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    return df.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy("truth", "pred").agg(F.count("*").alias("n"))


def overall_accuracy(df: DataFrame) -> DataFrame:
    """Percent of rows with truth = pred."""
    m = confusion(df)
    return m.agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("overall_accuracy"))


def cohen_kappa(df: DataFrame) -> DataFrame:
    """(po - pe) / (1 - pe); NULL if all rows are of one class on both sides."""
    m = confusion(df)
    ends = m.select(F.col("truth").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p")).union(m.select("pred", F.lit(0), "n"))
    margins = ends.groupBy("k").agg(F.sum("t").alias("t"), F.sum("p").alias("p")).agg(F.sum(F.col("t") * F.col("p")).cast("double").alias("both"))
    total = m.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).cast("double").alias("hit"))
    po, pe = F.col("hit") / F.col("n"), margins.scalar() / (F.col("n") * F.col("n"))
    return total.select(F.try_divide(po - pe, 1 - pe).alias("kappa"))


def user_producer(df: DataFrame) -> DataFrame:
    """User's accuracy (of a predicted class) and producer's (of a true class)."""
    m = confusion(df)
    rows = m.select(F.col("truth").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    rows = rows.union(m.select("pred", F.lit(0), "n", F.lit(0)))
    s = rows.groupBy("k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").cast("double").alias("hit"))
    return s.select(F.col("k").alias("class"), F.try_divide(F.col("hit"), F.col("p").cast("double")).alias("user_accuracy"), F.try_divide(F.col("hit"), F.col("t").cast("double")).alias("producer_accuracy"))


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers: the outermost values within 1.5 quartile ranges. Two aggregations; no group is gathered."""
    df = df.select(*by, F.col(value).alias("v"))
    q = df.groupBy(*by).agg(F.expr("percentile(v, array(0.25D, 0.5D, 0.75D))").alias("q"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.when(F.col("v") >= F.col("q1") - reach, F.col("v")), F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))
    return df.join(q, by).groupBy(*by, "q1", "median", "q3").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def correlations(df: DataFrame, target: str, others: list[str]) -> DataFrame:
    """Pearson correlation of each variable with the target over the rows that have both: one pass, then one row for each."""
    pair = lambda c: F.corr(F.when(F.col(c).isNotNull(), F.col(target)), F.when(F.col(target).isNotNull(), F.col(c)))
    return df.agg(*[pair(c).alias(c) for c in others]).unpivot([], others, "variable", "r").orderBy(F.desc_nulls_last("r"), "variable")
