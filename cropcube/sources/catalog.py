"""The catalogue of scenes: file names as rows, and what names say about product, date and band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.functions.bands import BANDS
from cropcube.operators.numbering import numbered

# Where each product's names have their date (from 1).
DATE_AT: Mapping[str, tuple[int, ...]] = {"S2": (12, 48), "LC08": (11,), "LE07": (11,)}


def folder(path: Column) -> Column:
    """A folder's path with one slash at its end."""
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def area_of_interest(spark: SparkSession, path: str, region: str) -> str | None:
    """The first row's text under a region's column."""
    row = spark.read.csv(path, header=True).select(region).limit(1).first()
    return None if row is None else row[0]


def day_at(name: Column, places: tuple[int, ...]) -> Column:
    """The first of the places that has a date of the form yyyyMMdd."""
    return F.coalesce(*[F.try_to_date(F.when(F.substring(name, p, 8).rlike("^[0-9]{8}$"), F.substring(name, p, 8)), "yyyyMMdd") for p in places])


def date_of(product: str, name: Column) -> Column:
    return day_at(name, DATE_AT[product])


def radar_date(name: Column) -> Column:
    """Token 3 of a radar name, like 05Jan2016."""
    return F.try_to_date(F.split_part(name, F.lit("_"), F.lit(4)), "ddMMMyyyy")


def touches(area: Sequence[tuple[float, float]]) -> Column:
    """Does the footprint (x_min, y_min, x_max, y_max) share a place with the polygon? True if an edge meets the box, or the box lies inside.

    An edge and a box are apart if their bounds are, or if all corners lie on one side of the edge's line.
    """
    corners = [(F.col(x), F.col(y)) for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
    edges = [(*p, *q) for p, q in zip(area, [*area[1:], area[0]], strict=True)]
    meets = F.lit(False)
    for x1, y1, x2, y2 in edges:
        side = [(x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) for x, y in corners]
        near = (F.col("x_max") >= min(x1, x2)) & (F.col("x_min") <= max(x1, x2)) & (F.col("y_max") >= min(y1, y2)) & (F.col("y_min") <= max(y1, y2))
        meets = meets | (near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0))
    x, y = corners[0]
    crossed = [F.when((y < max(y1, y2)) & (y >= min(y1, y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0) for x1, y1, x2, y2 in edges if y1 != y2]
    return meets | (sum(crossed, F.lit(0)) % 2 == 1)


def search(
    df: DataFrame, product: str | None = None, start: str | None = None, end: str | None = None, pattern: str | None = None, area: Sequence[tuple[float, float]] | None = None
) -> DataFrame:
    """Catalogue query: each condition that is given; the dates are inclusive, ``area`` is a polygon that the footprint has to touch."""
    if product is not None:
        df = df.where(F.col("product") == product)
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("time") <= F.lit(end).cast("date"))
    if area is not None:
        df = df.where(touches(area))
    return df if pattern is None else df.where(F.col("name").rlike(pattern))


def with_bands(df: DataFrame) -> DataFrame:
    """One row for each scene and band: the provider's band, the standard one and the file's name."""
    table = F.create_map(*[x for p, b in BANDS.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(k).alias("provider"), F.lit(v).alias("band")) for k, v in b.items()]))])
    rows = df.withColumn("b", F.explode(table[F.col("product")]))
    return rows.select(*df.columns, F.col("b.provider").alias("provider"), F.col("b.band").alias("band"), F.concat("name", F.lit("_"), F.col("b.provider"), F.lit(".tif")).alias("file"))


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """Consecutive groups of ``size`` rows."""
    return numbered(df, "cc_at", F.col(order)).withColumn("batch", F.floor((F.col("cc_at") - 1) / size).cast("int")).drop("cc_at")


def positions(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value with the places (from 0) that it has in the order."""
    at = numbered(df, "cc_at", F.col(order)).withColumn("at", (F.col("cc_at") - 1).cast("int"))
    return at.groupBy(value).agg(F.sort_array(F.collect_list("at")).alias("positions"))
