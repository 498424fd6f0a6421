"""Operators over acquisition dates: quality, choice of dates, nearest radar date, trends, target dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clear_fraction(df: DataFrame, mask: str = "mask", by: list[str] | None = None) -> DataFrame:
    """Share of clear pixels of every date."""
    return df.groupBy(*(by or ["time"])).agg(F.avg(F.col(mask).cast("int").cast("double")).alias("fraction"))


def best_date(fractions: DataFrame) -> DataFrame:
    """The clearest date; the earliest of equal ones."""
    return fractions.orderBy(F.desc("fraction"), "time").limit(1)


def best_dates_spaced(fractions: DataFrame, max_cloud: float = 0.2, min_days: int = 5, strict: bool = False) -> DataFrame:
    """Dates clearer than 1 - max_cloud; of two closer than ``min_days`` the clearer one (the earlier of equal ones).

    Each date is held against the one before it. By default a date stays that lost against its successor only, as long as it
    stands for itself; ``strict`` drops it.
    """
    w = Window.orderBy("time")
    q = fractions.where(F.col("fraction") > 1 - max_cloud)
    q = q.withColumns({"t0": F.lag("time").over(w), "q0": F.lag("fraction").over(w), "t1": F.lead("time").over(w), "q1": F.lead("fraction").over(w)})
    close = F.datediff("time", "t0") < min_days
    out = q.withColumn("pick", F.when(close & (F.col("q0") >= F.col("fraction")), F.col("t0")).otherwise(F.col("time")))
    if strict:
        out = out.where(~F.coalesce((F.datediff("t1", "time") < min_days) & (F.col("q1") > F.col("fraction")), F.lit(False)) | (F.col("pick") != F.col("time")))
    return out.select(F.col("pick").alias("time")).distinct()


def nearest(left: DataFrame, right: DataFrame, tolerance: int, group: str = "orbit", time: str = "time") -> DataFrame:
    """As-of join: for each date of ``left`` and each group of ``right`` the nearest date within ``tolerance`` days (inclusive),
    the later one of a tie. Dates without a match are dropped.

    Dates meet by buckets of the tolerance's length (each right date in its own and both neighbours), an equi-join, so neither side
    is compared in full.
    """
    width = max(1, tolerance)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    l = left.select(F.col(time).alias("left_time")).distinct().withColumn("b", F.floor(day("left_time") / width))  # noqa: E741
    r = right.select(group, F.col(time).alias("right_time")).distinct()
    r = r.withColumn("b", F.explode(F.array(*[F.floor(day("right_time") / width) + k for k in (-1, 0, 1)])))
    gap = F.abs(F.datediff("left_time", "right_time"))
    near = l.join(r, "b").where(gap <= tolerance)
    best = F.min_by("right_time", F.struct(gap, -day("right_time")))
    return near.groupBy("left_time", group).agg(best.alias("right_time"))


def slope(value: Column, time: Column, w, lag: int = 1) -> Column:
    """Change a day against the value ``lag`` dates before; NULL if either is missing."""
    return F.try_divide(value - F.lag(value, lag).over(w), F.datediff(time, F.lag(time, lag).over(w)).cast("double"))


def trend(df: DataFrame, value: str, by: list[str], lag: int = 1) -> DataFrame:
    """Slope of every pixel against the scene date ``lag`` before its own; NULL if the pixel has no value there.

    Scene dates are those of the whole cube, in order of time; a date that a pixel lacks is counted all the same.
    """
    dates = df.select("time").distinct().withColumn("scene", F.row_number().over(Window.orderBy("time")))  # dates are few against pixels
    then = Window.partitionBy(*by).orderBy("scene").rangeBetween(-lag, -lag)
    before, day = F.max(F.col(value)).over(then), F.max("time").over(then)
    return df.join(dates, "time").withColumn("trend", F.try_divide(F.col(value) - before, F.datediff("time", day).cast("double"))).drop("scene")


def trend_between(df: DataFrame, value: str, by: list[str], position: int = -1, lag: int = 1) -> DataFrame:
    """Slope between two scene dates, the one at ``position`` (from the end) and the one ``lag`` before it, for pixels that have both."""
    dates = df.select("time").distinct().withColumn("back", -F.row_number().over(Window.orderBy(F.desc("time"))))
    pick = dates.where(F.col("back").isin(position, position - lag))
    rows = df.join(F.broadcast(pick), "time")
    now, then = F.col("back") == position, F.col("back") == position - lag
    one = lambda c, when: F.max(F.when(when, c))
    out = rows.groupBy(*by).agg(
        one(F.col(value), now).alias("v1"), one(F.col(value), then).alias("v0"), one(F.col("time"), now).alias("t1"), one(F.col("time"), then).alias("t0")
    )
    return out.select(*by, F.try_divide(F.col("v1") - F.col("v0"), F.datediff("t1", "t0").cast("double")).alias("trend")).where("trend IS NOT NULL")


def nearest_cube(cube: DataFrame, dates: DataFrame, values: list[str], orbits: list[str], tolerance: int = 10) -> DataFrame:
    """Radar pixels at optical dates: of each orbit those of the nearest radar date within ``tolerance`` days, the later of two.

    Variables get the orbit's name behind them, time is the optical date, and the orbits are merged by (time, y, x). Optical dates
    that no orbit has a date near are dropped.
    """
    match = nearest(dates, cube, tolerance).select("orbit", F.col("right_time").alias("time"), F.col("left_time").alias("to"))
    near = cube.join(match, ["orbit", "time"])
    one = [F.first(F.when(F.col("orbit") == o, F.col(v)), ignorenulls=True).alias(f"{v}_{o}") for o in orbits for v in values]
    return near.groupBy(F.col("to").alias("time"), "y", "x").agg(*one)


def target_dates(first: Column, doa: Column, step: int) -> Column:
    """Dates doa + step, doa, doa - step, ... that are after ``first``."""
    start = F.date_add(doa, step)
    n = F.floor(F.datediff(start, first) / step)
    days = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda k: F.date_sub(start, k * step))
    return F.filter(days, lambda d: d > first)
