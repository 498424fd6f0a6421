"""Lots (polygons) and places. A polygon is an array of vertices (x, y); boundaries belong to no polygon for the horizontal test's half."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the tiles that lots and places meet by.
TILE = 10.0


def bounds(ring: str = "ring") -> list[Column]:
    pick = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return [pick(F.array_min, "x").alias("x_min"), pick(F.array_min, "y").alias("y_min"), pick(F.array_max, "x").alias("x_max"), pick(F.array_max, "y").alias("y_max")]


def inside(x: str, y: str, ring: str = "ring") -> Column:
    """Even-odd rule: an odd number of edges is crossed by a ray to larger x."""
    n = f"size({ring})"
    return F.expr(
        f"size(filter(transform({ring}, (p, i) -> named_struct('x1', p.x, 'y1', p.y, 'x2', {ring}[(i + 1) % {n}].x, 'y2', {ring}[(i + 1) % {n}].y)),"
        f" e -> (e.y1 > {y}) <> (e.y2 > {y}) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1"
    )


def tile_of(x: Column, y: Column, side: float = TILE) -> list[Column]:
    return [F.floor(x / side).cast("long").alias("tile_x"), F.floor(y / side).cast("long").alias("tile_y")]


def places_in_lots(places: DataFrame, lots: DataFrame, side: float = TILE) -> DataFrame:
    """Every place with every lot it lies in: lots are dealt to the tiles under their bounds, places meet them there (an equi-join)
    and are tested by bounds, then by edges."""
    boxed = lots.select("*", *bounds())
    axis = lambda k: F.sequence(F.floor(F.col(f"{k}_min") / side).cast("long"), F.floor(F.col(f"{k}_max") / side).cast("long"))
    boxed = boxed.withColumn("tile_x", F.explode(axis("x"))).withColumn("tile_y", F.explode(axis("y")))
    met = places.select("*", *tile_of(F.col("x"), F.col("y"), side)).join(boxed, ["tile_x", "tile_y"])
    near = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    return met.where(near).where(inside("x", "y")).drop("tile_x", "tile_y", "x_min", "y_min", "x_max", "y_max")


def rasterized(grid: DataFrame, lots: DataFrame, value: str, order: str = "lot") -> DataFrame:
    """The value of the lot at every place of the grid, the last lot's where several lie; 0 where none."""
    hit = places_in_lots(grid, lots.where(F.col(value).isNotNull())).groupBy("y", "x").agg(F.max_by(value, order).alias(value))
    return grid.join(hit, ["y", "x"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def utm(lon: Column, lat: Column, zone: int = 18) -> tuple[Column, Column]:
    """Transverse Mercator (Krueger's series to the third order, WGS 84): easting and northing in metres of a northern zone."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(6 * zone - 183)
    atanh = lambda z: F.log((1 + z) / (1 - z)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + 0.9996 * radius * east, 0.9996 * radius * north
