"""The driver's tables as cubes: pixels, scenes, series, tiles, lots and a catalogue of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.functions import bands as B

CLASS_DATES = ("19970115", "19980615", "19991215")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel cube: one row for each product, place, date and tile."""
    li = table(spark, sf_dir, "lineitem")
    qa_class = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(3)
    df = li.select(
        F.expr("l_partkey div 50").cast("double").alias("y"),
        (F.col("l_partkey") % 50).cast("double").alias("x"),
        F.col("l_shipdate").cast("date").alias("time"),
        F.when(F.col("l_linestatus") == "O", "S2").otherwise("LC08").alias("product"),
        F.when(F.col("l_linenumber") % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("orbit"),
        F.round(F.col("l_extendedprice") / 10).cast("int").alias("nir"),
        F.round(F.col("l_quantity") * 200).cast("int").alias("red"),
        F.round((F.col("l_tax") + 0.01) * 50000).cast("int").alias("swir1"),
        (F.col("l_discount") + 0.01).alias("vv"),
        F.col("l_linenumber").cast("int").alias("qa_cloud"),
        qa_class.alias("qa_class"),
        F.col("l_orderkey").alias("tile"),
        F.col("l_linenumber").cast("int").alias("part"),
    )
    return df.withColumn("mask", B.clear("qa_cloud", "qa_class", 6, (3,)))


def px_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear pixels by month: the first tile's values."""
    df = px(spark, sf_dir).where("mask").withColumn("time", F.trunc("time", "MM"))
    first = F.min_by(F.struct("nir", "red", "swir1", "vv"), F.struct("tile", "part"))
    return df.groupBy("product", "time", "y", "x").agg(first.alias("v")).select("product", "time", "y", "x", "v.*")


def scenes(spark: SparkSession, sf_dir: str, supplier: int) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") == supplier)
    orbit = F.when(F.col("l_linenumber") % 2 == 0, "ASCENDING").otherwise("DESCENDING")
    return li.select(orbit.alias("orbit"), F.col("l_shipdate").cast("date").alias("time")).distinct()


def scenes_all(spark: SparkSession, sf_dir: str, radar: bool) -> DataFrame:
    """Scenes of the whole table: the rows of one status are radar, those of the other optical."""
    orbit = F.when(F.col("l_linenumber") % 2 == 0, "ASCENDING").otherwise("DESCENDING")
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == ("F" if radar else "O"))
    return li.select(orbit.alias("orbit"), F.col("l_shipdate").cast("date").alias("time")).distinct()


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the bounds of each scene's clear pixels of one orbit."""
    day = px(spark, sf_dir).where("mask AND orbit = 'ASCENDING'").groupBy("product", "time")
    return day.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("pixel"), F.col("event_type").alias("band"), F.col("ts").cast("date").alias("time")).agg(F.avg("value").alias("value"))


def tiles8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles, row by row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").alias("data"))


def cells(tiles: DataFrame, width: int = 8) -> DataFrame:
    return tiles.select("id", "class", F.posexplode("data").alias("i", "v")).select(
        "id", "class", F.expr(f"i div {width}").cast("int").alias("r"), (F.col("i") % width).alias("c"), F.col("v").cast("double").alias("v")
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 lots in a lattice, quadrilaterals and triangles, with a class column for each date (0 is no class)."""
    top = table(spark, sf_dir, "lineitem").agg(((F.max(F.expr("l_partkey div 50")) + 1) / 5).alias("h"))
    n = table(spark, sf_dir, "nation").join(F.broadcast(top))
    k = F.col("n_nationkey")
    left, low, high = (k % 5) * 10.0, F.expr("n_nationkey div 5") * F.col("h") - 0.25, (F.expr("n_nationkey div 5") + 1) * F.col("h") - 0.25
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = point(left + 0.25, low), point(left + 9.25, low)
    quad = F.array(a, b, point(left + 9.25, high), point(left + 0.25, high))
    tri = F.array(a, b, point(left + 4.25, high), a)
    classes = [F.expr(f"nullif((n_regionkey + {j} + n_nationkey) % 6, 0)").cast("int").alias(f"X{d}") for j, d in enumerate(CLASS_DATES)]
    return n.select(k.alias("lot"), F.when(k % 2 == 0, quad).otherwise(tri).alias("ring"), *classes)


def lot_classes(lots_: DataFrame) -> DataFrame:
    """(lot, ring, time, vclass) of the lots with a class at a date: columns named X and a date become rows."""
    dated = [c for c in lots_.columns if c.startswith("X")]
    long = lots_.unpivot(["lot", "ring"], dated, "name", "vclass")
    return long.where("vclass IS NOT NULL").select("lot", "ring", F.to_date(F.substring("name", 2, 8), "yyyyMMdd").alias("time"), "vclass")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of scenes as their providers write them."""
    day = F.date_format("time", "yyyyMMdd")
    name = F.when(F.col("product") == "S2", F.concat(F.lit("S2A_MSIL2A_"), day, F.lit("T151709"))).otherwise(F.concat(F.lit("LC08008057"), day, F.lit("01T1")))
    return px(spark, sf_dir).select("product", "time").distinct().select("product", "time", name.alias("name"))


def px16(spark: SparkSession, sf_dir: str, doas: tuple[str, ...] = CLASS_DATES) -> DataFrame:
    """Clear pixels around each date of analysis at multiples of 16 days from -96 to 16; the first tile's values."""
    days = spark.createDataFrame([(f"{d[:4]}-{d[4:6]}-{d[6:]}",) for d in doas], "doa string").select(F.col("doa").cast("date"))
    df = px(spark, sf_dir).where("mask").join(F.broadcast(days), F.col("time").between(F.date_sub("doa", 96), F.date_add("doa", 31)))
    rel = (F.floor(F.datediff("time", "doa") / 16) * 16).cast("int")
    first = F.min_by(F.struct("nir", "red", "swir1", "vv"), F.struct("tile", "part"))
    df = df.groupBy("doa", "y", "x", rel.alias("rel")).agg(first.alias("v")).select("doa", "y", "x", "rel", "v.*")
    return df.withColumns({"NDVI": B.ndvi(), "LSWI": B.lswi()})


def labels_as_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"))


