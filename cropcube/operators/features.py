"""Feature tables of pixels, and splits of lots into training and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropcube.functions.bands import half_even_share, relative_names
from cropcube.operators.geometry import places_in_lots
from cropcube.operators.numbering import numbered

RELATIVE = tuple(range(-96, 17, 16))


def pivoted(df: DataFrame, by: list[str], variables: Sequence[str], days: Sequence[int] = RELATIVE, rel: str = "rel") -> DataFrame:
    """One row for each place; a column for each variable and relative day (``NDVI_n16``). Days are given, so no pass looks for them."""
    cols = [F.max(F.when(F.col(rel) == d, F.col(v))).alias(name) for v in variables for d, name in zip(days, relative_names(v, days), strict=True)]
    return df.where(F.col(rel).isin(*days)).groupBy(*by).agg(*cols)


def seeded(seed: Column | str, *parts: str) -> Column:
    """A reproducible order: the digest of the seed and the parts as text."""
    start = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws("|", start, *[F.col(p).cast("string") for p in parts]))


def stratified_split(df: DataFrame, by: str = "vclass", parts: tuple[str, ...] = ("time", "lot"), seed: Column | str = "33", share: float = 0.7, more: tuple[str, ...] = ()) -> DataFrame:
    """``tt``: train for the first share of each class in the seeded order (halves to the even number), else test."""
    k = F.row_number().over(Window.partitionBy(*more, by).orderBy(seeded(seed, *parts), *parts))
    n = F.count("*").over(Window.partitionBy(*more, by))
    return df.withColumn("tt", F.when(k <= half_even_share(n, share), "train").otherwise("test"))


def holdout_split(df: DataFrame, part: str = "lot", seed: str = "200", share: float = 0.7) -> DataFrame:
    """The same without classes: whole lots are held out."""
    n = df.select(F.count("*")).scalar()
    placed = numbered(df, "cc_at", seeded(seed, part), F.col(part))
    return placed.withColumn("tt", F.when(F.col("cc_at") <= half_even_share(n, share), "train").otherwise("test")).drop("cc_at")


def looked_up(df: DataFrame, split: DataFrame, on: list[str]) -> DataFrame:
    """``tt`` of each row's (date, lot); nd where there is none."""
    return df.join(split.select(*on, "tt"), on, "left").withColumn("tt", F.coalesce("tt", F.lit("nd")))


def class_tagged(places: DataFrame, lots: DataFrame, value: str) -> DataFrame:
    """The class of the lot a place lies in (the last of several), else 0."""
    hit = places_in_lots(places.select("y", "x").distinct(), lots.where(F.col(value).isNotNull())).groupBy("y", "x").agg(F.max_by(value, "lot").alias("vclass"))
    return places.join(hit, ["y", "x"], "left").withColumn("vclass", F.coalesce("vclass", F.lit(0)))


def lot_features(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Features of the places in lots that have a class at the date of analysis: one join for all lots and dates."""
    places = features.select("y", "x").distinct()
    shapes = classes.select("lot", "ring").dropDuplicates(["lot"])
    placed = places_in_lots(places, shapes).select("y", "x", "lot")
    dated = classes.select("lot", F.col("time").alias("doa"), "vclass")
    return features.join(placed, ["y", "x"]).join(dated, ["lot", "doa"])


def date_features(features: DataFrame, classes: DataFrame, seed: str = "33") -> DataFrame:
    """The training table: features, lot, class, date and split."""
    split = stratified_split(classes.select("lot", "time", "vclass"), seed=seed).select("lot", F.col("time").alias("doa"), "tt")
    return looked_up(lot_features(features, classes), split, ["lot", "doa"]).where("vclass > 0")
