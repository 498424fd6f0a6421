"""Selection, alignment and combination of pixel cubes. A cube is a DataFrame with time, y, x and band columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = ("y", "x")


def within(df: DataFrame, **ranges: tuple) -> DataFrame:
    """Closed ranges by label: ``within(df, x=(3, 9), time=("1998-01-01", "1998-03-31"))``; either end may come first."""
    for name, (a, b) in ranges.items():
        df = df.where(F.col(name).between(F.least(F.lit(a), F.lit(b)), F.greatest(F.lit(a), F.lit(b))))
    return df


def at(df: DataFrame, **labels) -> DataFrame:
    for name, value in labels.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def ranked_labels(df: DataFrame, dim: str) -> DataFrame:
    """(dim, position from 0, position from the end: -1 is the last). Labels are few against pixels."""
    labels = df.select(dim).distinct()
    return labels.withColumn("position", F.row_number().over(Window.orderBy(dim)) - 1).withColumn("back", -F.row_number().over(Window.orderBy(F.desc(dim))))


def by_position(df: DataFrame, dim: str, positions: Iterable[int]) -> DataFrame:
    """Rows whose label has one of the positions; negative ones count from the end."""
    wanted = list(positions)
    labels = ranked_labels(df, dim).where(F.col("position").isin(wanted) | F.col("back").isin(wanted)).select(dim)
    return df.join(F.broadcast(labels) if len(wanted) <= 10_000 else labels, dim, "left_semi")


def with_suffix(df: DataFrame, suffix: str, keep: Iterable[str], sep: str = "_") -> DataFrame:
    """Suffix all variables; dimensions stay."""
    keep = set(keep)
    return df.withColumnsRenamed({c: f"{c}{sep}{suffix}" for c in df.columns if c not in keep})


def bands_as_rows(df: DataFrame, dims: list[str], bands: list[str]) -> DataFrame:
    return df.unpivot(dims, bands, "band", "value")


def matching(df: DataFrame, pattern: str) -> list[str] | None:
    """Names that a pattern is found in; None if there are none."""
    return [c for c in df.columns if re.search(pattern, c)] or None


def align_inner(a: DataFrame, b: DataFrame, on: tuple[str, ...] = GRID) -> tuple[DataFrame, DataFrame]:
    """Both cubes on the places that both have; times stay."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi"), b.join(a.select(*on).distinct(), list(on), "left_semi")


def align_left(a: DataFrame, b: DataFrame, on: tuple[str, ...] = GRID, time: str = "time") -> DataFrame:
    """``b`` on the grid of ``a``: every date of ``b`` at every place of ``a``, NULL where ``b`` has none there.

    The result is dense by definition (dates of ``b`` times places of ``a``), so the dates, which are few, are dealt to
    the places as one array and unfolded there.
    """
    places = a.select(*on).distinct()
    days = b.select(time).distinct().agg(F.sort_array(F.collect_list(time)).alias("days"))
    full = places.withColumn("days", days.scalar()).select(*on, F.explode("days").alias(time))
    return full.join(b, [*on, time], "left")


def concat(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all parts; repeated dates stay."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge(a: DataFrame, b: DataFrame, on: list[str], on_conflict: str = "left") -> DataFrame:
    """Full outer merge; a variable that both have takes the value that is there.

    Where both have one and they differ, ``a``'s is taken, or the query fails if ``on_conflict`` is "raise"; ``conflicts`` finds these places.
    """
    if on_conflict not in ("raise", "left"):
        raise ValueError("on_conflict is raise or left")
    common = [c for c in a.columns if c in b.columns and c not in on]
    x, y = a.alias("x"), b.withColumnsRenamed({c: f"{c}__other" for c in common}).alias("y")
    out = x.join(y, on, "full_outer")
    either = {c: F.coalesce(F.col(c), F.col(f"{c}__other")) for c in common}
    if on_conflict == "raise":
        either = {c: F.when(F.col(c) != F.col(f"{c}__other"), F.raise_error(F.lit(f"both sides have {c} and differ"))).otherwise(e) for c, e in either.items()}
    return out.withColumns(either).drop(*(f"{c}__other" for c in common))


def conflicts(a: DataFrame, b: DataFrame, on: list[str], variable: str) -> DataFrame:
    """Places where both cubes have the variable and differ."""
    other = b.select(*on, F.col(variable).alias("other"))
    return a.select(*on, F.col(variable).alias("value")).join(other, on).where("value <> other")


def first_wins(df: DataFrame, by: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Mosaic of overlapping tiles: each variable's first value that is not missing, in the order of tiles."""
    key = F.struct(*order)
    return df.groupBy(*by).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), key)).alias(v) for v in values])


def mosaic_rows(df: DataFrame, by: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Mosaic that takes all variables of a place from one tile, the first."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*by, "v.*")


def grid_of(df: DataFrame) -> DataFrame:
    """The regular grid under a cube: origin, step and number of places of both axes."""
    axis = lambda n: [F.min(n).alias(f"{n}0"), F.max(n).alias(f"{n}1"), F.count_distinct(n).alias(f"n{n}")]
    g = df.agg(*axis("x"), *axis("y"))
    step = lambda n: F.try_divide(F.col(f"{n}1") - F.col(f"{n}0"), F.col(f"n{n}") - 1)
    return g.select("x0", step("x").alias("dx"), "nx", "y0", step("y").alias("dy"), "ny")


def nearest_cell(value: Column, origin: float, step: float) -> Column:
    """The number of the nearest grid line, halves up."""
    return F.floor((value - origin) / step + 0.5).cast("int")


def collocate(slave: DataFrame, origin: tuple[float, float], step: tuple[float, float], shape: tuple[int | Column, int | Column], values: list[str], keep: list[str]) -> DataFrame:
    """A cube on another grid by nearest place: master cell (row, col) has the slave's values, an equi-join on cell numbers
    if the slave is the finer one. Where several slave places fall on a cell the nearest to its centre wins, then the least y, x."""
    row, col = nearest_cell(F.col("y"), origin[0], step[0]), nearest_cell(F.col("x"), origin[1], step[1])
    df = slave.withColumns({"row": row, "col": col}).where((F.col("row") >= 0) & (F.col("row") < shape[0]) & (F.col("col") >= 0) & (F.col("col") < shape[1]))
    off = (F.col("y") - (F.lit(origin[0]) + F.col("row") * step[0])) ** 2 + (F.col("x") - (F.lit(origin[1]) + F.col("col") * step[1])) ** 2
    best = F.min_by(F.struct(*values), F.struct(off, "y", "x"))
    return df.groupBy(*keep, "row", "col").agg(best.alias("v")).select(*keep, "row", "col", "v.*")


def collocate_cells(
    slave: DataFrame,
    slave_origin: tuple[float, float],
    slave_step: tuple[float, float],
    origin: tuple[float, float],
    step: tuple[float, float],
    shape: tuple[int | Column, int | Column],
    values: list[str],
    keep: list[str],
) -> DataFrame:
    """A regular cube on another grid, coarser or finer: every master cell (row, col) looks up the slave's cell that its centre is nearest to.

    So a coarse slave's value is in all master cells around it. Rows and columns are looked up apart, by two equi-joins with an axis each.
    """
    spark = slave.sparkSession

    def axis(name: str, k: int) -> DataFrame:
        n = shape[k] if isinstance(shape[k], Column) else F.lit(shape[k])
        cells = spark.range(1).select(F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias(name))
        return cells.withColumn(f"of_{name}", nearest_cell(F.lit(float(origin[k])) + F.col(name) * step[k], slave_origin[k], slave_step[k]))

    df = slave.withColumns({"of_row": nearest_cell(F.col("y"), slave_origin[0], slave_step[0]), "of_col": nearest_cell(F.col("x"), slave_origin[1], slave_step[1])})
    return df.join(axis("row", 0), "of_row").join(axis("col", 1), "of_col").select(*keep, "row", "col", *values)


def refine(df: DataFrame, factor: int) -> DataFrame:
    """Every place becomes factor x factor places of the same value."""
    sub = F.array(*[F.struct(F.lit(i / factor).alias("dy"), F.lit(j / factor).alias("dx")) for i in range(factor) for j in range(factor)])
    return df.withColumn("s", F.explode(sub)).withColumn("y", F.col("y") + F.col("s.dy")).withColumn("x", F.col("x") + F.col("s.dx")).drop("s")


def translate(df: DataFrame, grid: DataFrame, dy: int | Column, dx: int | Column, values: list[str], keep: list[str]) -> DataFrame:
    """output[y, x] = input[y + dy, x + dx]; places that come from outside are 0."""
    moved = df.withColumns({"y": F.col("y") - dy, "x": F.col("x") - dx})
    out = grid.join(moved, [*keep, *GRID], "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})
