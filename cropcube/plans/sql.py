"""SQL of the views that queries read, as common table expressions for the oracle."""

from __future__ import annotations

VIEWS = {
    "px": """px AS (SELECT CAST(l_partkey // 50 AS DOUBLE) AS y, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_shipdate AS DATE) AS time,
  CASE WHEN l_linestatus = 'O' THEN 'S2' ELSE 'LC08' END AS product, CASE WHEN l_linenumber % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit,
  CAST(round(l_extendedprice / 10) AS INTEGER) AS nir, CAST(round(l_quantity * 200) AS INTEGER) AS red, CAST(round((l_tax + 0.01) * 50000) AS INTEGER) AS swir1,
  CAST(l_discount + 0.01 AS DOUBLE) AS vv, CAST(l_linenumber AS INTEGER) AS qa_cloud, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 3 END AS qa_class,
  NOT (l_linenumber > 6 OR l_returnflag NOT IN ('A', 'N')) AS mask, l_orderkey AS tile, CAST(l_linenumber AS INTEGER) AS part FROM lineitem)""",
    "px_month": """px_month AS (SELECT product, time, y, x, nir, red, swir1, vv FROM (SELECT product, CAST(date_trunc('month', time) AS DATE) AS time, y, x, nir, red, swir1, vv,
  row_number() OVER (PARTITION BY product, date_trunc('month', time), y, x ORDER BY tile, part) AS k FROM px WHERE mask) WHERE k = 1)""",
    "s1": """s1 AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit, CAST(l_shipdate AS DATE) AS time FROM lineitem WHERE l_suppkey = 1)""",
    "opt": """opt AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS time FROM lineitem WHERE l_suppkey = 2)""",
    "s1_all": """s1_all AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit, CAST(l_shipdate AS DATE) AS time FROM lineitem WHERE l_linestatus = 'F')""",
    "opt_all": """opt_all AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS time FROM lineitem WHERE l_linestatus = 'O')""",
    "footprints": """footprints AS (SELECT product, time, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM px WHERE mask AND orbit = 'ASCENDING' GROUP BY ALL)""",
    "series": """series AS (SELECT user_id AS pixel, event_type AS band, CAST(ts AS DATE) AS time, avg(value) AS value FROM events GROUP BY ALL)""",
    "ranked": """ranked AS (SELECT pixel, band, time, value, row_number() OVER (PARTITION BY pixel, band ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY pixel, band) AS n FROM series WHERE value IS NOT NULL)""",
    "cells": """cells AS (SELECT id, class, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id AS id, label AS class, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings))""",
    "levels": """q AS (SELECT id, r, c, CAST(16 * (rank() OVER (PARTITION BY id ORDER BY v) - 1) // count(*) OVER (PARTITION BY id) AS INTEGER) AS q FROM cells)""",
    "lots": """top AS (SELECT (max(l_partkey // 50) + 1) / 5.0::DOUBLE AS h FROM lineitem),
nk AS (SELECT n_nationkey AS lot, n_regionkey AS region, (n_nationkey % 5) * 10.0::DOUBLE AS x0, (n_nationkey // 5) * h - 0.25::DOUBLE AS lo, ((n_nationkey // 5) + 1) * h - 0.25::DOUBLE AS hi FROM nation, top),
lots AS (SELECT lot, CASE WHEN lot % 2 = 0 THEN [x0 + 0.25, x0 + 9.25, x0 + 9.25, x0 + 0.25] ELSE [x0 + 0.25, x0 + 9.25, x0 + 4.25, x0 + 0.25] END::DOUBLE[] AS xs,
  CASE WHEN lot % 2 = 0 THEN [lo, lo, hi, hi] ELSE [lo, lo, hi, lo] END::DOUBLE[] AS ys,
  nullif((region + 0 + lot) % 6, 0)::INTEGER AS X19970115, nullif((region + 1 + lot) % 6, 0)::INTEGER AS X19980615, nullif((region + 2 + lot) % 6, 0)::INTEGER AS X19991215 FROM nk)""",
    "classes": """classes AS (SELECT lot, DATE '1997-01-15' AS time, X19970115 AS vclass FROM lots WHERE X19970115 IS NOT NULL UNION ALL SELECT lot, DATE '1998-06-15', X19980615 FROM lots WHERE X19980615 IS NOT NULL
  UNION ALL SELECT lot, DATE '1999-12-15', X19991215 FROM lots WHERE X19991215 IS NOT NULL)""",
    "edges": """edges AS (SELECT lot, unnest(xs) AS x1, unnest(ys) AS y1, unnest([xs[2], xs[3], xs[4], xs[1]]) AS x2, unnest([ys[2], ys[3], ys[4], ys[1]]) AS y2 FROM lots)""",
    "places": """places AS (SELECT DISTINCT y, x FROM px)""",
    "inside": """inside AS (SELECT y, x, lot FROM places JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY y, x, lot HAVING count(*) % 2 = 1)""",
    "px16": """px16 AS (SELECT doa, y, x, rel, nir, red, swir1, vv, (nir::DOUBLE - red) / nullif(nir::DOUBLE + red, 0) AS "NDVI", (nir::DOUBLE - swir1) / nullif(nir::DOUBLE + swir1, 0) AS "LSWI" FROM (
  SELECT *, row_number() OVER (PARTITION BY doa, y, x, rel ORDER BY tile, part) AS k FROM (
  SELECT doa, px.*, CAST(floor(date_diff('day', doa, time) / 16.0) * 16 AS INTEGER) AS rel FROM px, (SELECT unnest([DATE '1997-01-15', DATE '1998-06-15', DATE '1999-12-15']) AS doa)
  WHERE mask AND time BETWEEN doa - 96 AND doa + 31)) WHERE k = 1)""",
    "catalog": """catalog AS (SELECT DISTINCT product, time, CASE WHEN product = 'S2' THEN 'S2A_MSIL2A_' || strftime(time, '%Y%m%d') || 'T151709' ELSE 'LC08008057' || strftime(time, '%Y%m%d') || '01T1' END AS name FROM px)""",
    "truth": """truth AS (SELECT quality AS truth, toxic AS pred FROM labels)""",
    "fractions": """fractions AS (SELECT time, avg(CAST(CAST(mask AS INTEGER) AS DOUBLE)) AS fraction FROM px WHERE product = 'S2' GROUP BY time)""",
}
NEEDS = {
    "levels": ["cells"], "footprints": ["px"], "px_month": ["px"], "ranked": ["series"], "classes": ["lots"], "edges": ["lots"], "places": ["px"], "inside": ["places", "edges"], "px16": ["px"], "catalog": ["px"], "fractions": ["px"],
}


def with_views(sql: str, *names: str) -> str:
    """A query behind the views it reads, each after those it needs itself."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(VIEWS[n] for n in order) + "\n" if order else "") + sql


def pivot_columns(variables: tuple[str, ...], days: tuple[int, ...]) -> str:
    return ", ".join(f"""max(CASE WHEN rel = {d} THEN round("{v}", 9) END) AS "{v}_{str(d).replace('-', 'n')}\"""" for v in variables for d in days)
