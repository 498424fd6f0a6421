"""Numbering rows in an order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the bounds of the ranges are taken from, and the number of ranges: both fixed, so what the driver sees is bounded.
SAMPLE = 2048
RANGES = 64


def numbered(df: DataFrame, name: str, order: Column, *ties: Column) -> DataFrame:
    """``df`` with ``name``, the row's place from 1 in the order of ``order``, then ``ties``.

    Bounds from a bounded sample deal the rows to ranges of ``order``; each range is numbered by itself and moved by the number of rows
    before it. The result is the same for any bounds. Rows of one value of ``order`` share a range; nulls come first.
    """
    keyed = df.withColumn("cc_k", order)
    picked = keyed.select("cc_k").where("cc_k IS NOT NULL").orderBy(F.rand(1)).limit(SAMPLE).collect()
    values = sorted({r[0] for r in picked})
    bounds = sorted({values[len(values) * i // RANGES] for i in range(1, RANGES)}) if values else []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("cc_k"))) if bounds else F.lit(0)
    keyed = keyed.withColumn("cc_b", F.when(F.col("cc_k").isNull(), F.lit(-1)).otherwise(at))
    before = F.coalesce(F.sum("cc_n").over(Window.orderBy("cc_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy("cc_b").agg(F.count("*").alias("cc_n")).select("cc_b", before.alias("cc_before"))  # at most RANGES + 1 rows
    k = F.row_number().over(Window.partitionBy("cc_b").orderBy("cc_k", *ties))
    return keyed.join(F.broadcast(counts), "cc_b").withColumn(name, k + F.col("cc_before")).select(*df.columns, name)
