"""What larger and odder tables showed."""

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cropcube.llm import repeats as RP
from cropcube.operators import texture as TX
from cropcube.operators import timeseries as TS
from cropcube.plans import queries as Q
from tests.oracle import rows_of_spark, rows_of_sql


@pytest.fixture
def tables(small, tmp_path):
    """A folder of the small tables in which one can be replaced."""
    import os

    for name in os.listdir(small):
        (tmp_path / name).symlink_to(f"{small}/{name}")

    def replaced(name, df):
        path = tmp_path / f"{name}.parquet"
        path.unlink()
        df.write.parquet(str(path))
        return str(tmp_path)

    return replaced


def test_registration_broadcasts_no_cells(spark, small):
    plan = Q.QUERIES["coregistration_shift"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
    cells = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 7)], "id long, r int, c int, v long")
    assert "BroadcastHashJoin" not in TX.shift_scores(cells, cells, ["id"], 2)._jdf.queryExecution().executedPlan().toString()


def test_registration_of_odd_tiles_equals_sql(spark, tables):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=n)], 0) for i, n in enumerate((64, 64, 64, 20, 64, 70, 0, 64, 3, 64))] + [(10, None, 0), (11, [1.0] * 64, 0), (12, [None, 2.0] * 32, 0), (13, [1.0] * 64, 0)]
    folder = tables("embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert rows_of_spark(Q.QUERIES["coregistration_shift"](spark, folder)) == rows_of_sql(folder, Q.ORACLES["coregistration_shift"])


def test_scores_of_tiles_are_those_of_cells(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 12).tolist(), rng.integers(-9, 9, n).tolist()) for i, n in enumerate((12, 12, 8, 6, 1))]
    pairs = spark.createDataFrame(rows, "id long, a array<long>, b array<long>")
    cells = lambda c: pairs.select("id", F.posexplode(c).alias("i", "v")).select("id", F.expr("i div 4").cast("int").alias("r"), (F.col("i") % 4).alias("c"), "v")
    got = TX.tile_shift_scores(pairs, ["id"], 4, 3).where("score IS NOT NULL")
    assert rows_of_spark(got) == rows_of_spark(TX.shift_scores(cells("a"), cells("b"), ["id"], 3))


def test_rasters_keep_the_sign_of_zero_and_empty_tiles(spark, tables):
    rows = [(0, [-1e-7, 1e-7, -0.0, 0.0] * 16, 0), (1, [0.0078125, -0.0078125, 1e30, float("nan")] * 16, 0), (2, [], 0), (3, None, 0), (4, [None, -3e-7], 0)]
    folder = tables("embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    text = lambda rows: [repr(r) for r in rows]
    got, want = rows_of_spark(Q.QUERIES["rows_to_raster"](spark, folder)), rows_of_sql(folder, Q.ORACLES["rows_to_raster"])
    assert got[0] == want[0] and text(got[1]) == text(want[1])


def test_rounding_is_that_of_sql(spark):
    import duckdb

    rng = np.random.default_rng(7)
    values = [*rng.normal(scale=100, size=300).round(5).tolist(), *(rng.integers(-(10**6), 10**6, 300) / 32).tolist(), -1e-9, -0.0, 0.49999999999999994, 1e300, -1e307, 4503599627370497.5, 1.00005, -2.94375]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = df.orderBy("i").select(*[Q.rounded("v", k).alias(f"r{k}") for k in (0, 4, 9)]).collect()
    want = duckdb.connect().execute("SELECT round(v, 0), round(v, 4), round(v, 9) FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()
    assert [repr(tuple(r)) for r in got] == [repr(tuple(r)) for r in want]


def test_features_of_two_values_are_those_of_sql(spark, tables):
    rng = np.random.default_rng(8)
    rows = []
    for user in range(300):
        for k in range(2 if user < 250 else 3):
            rows.append((len(rows), datetime.datetime(2024, 1, 1 + 3 * k), user, "view", float(rng.integers(1, 30000)) / 100, "{}"))
    folder = tables("events", spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    text = lambda rows: [repr(r) for r in rows]
    got, want = rows_of_spark(Q.QUERIES["ts_features_ext"](spark, folder)), rows_of_sql(folder, Q.ORACLES["ts_features_ext"])
    assert got[0] == want[0] and text(got[1]) == text(want[1])


@pytest.mark.parametrize("name", ["interp_spline", "interp_spline_der"])
def test_splines_half_way_between_roundings_are_those_of_sql(spark, small, tables, name):
    first, days = datetime.date(1995, 12, 1), {2: (0, 800), 3: (0, 160, 800), 4: (0, 160, 320, 800)}
    rng = np.random.default_rng(9)
    rows = [(place, first + datetime.timedelta(d), float(rng.integers(9000, 1000000)) / 10) for place in range(600) for d in days[2 + place % 3]]
    found = spark.createDataFrame(rows, "l_partkey long, day date, price double")
    new = {"l_orderkey": "l_partkey", "l_partkey": "l_partkey", "l_shipdate": "cast(day AS timestamp_ntz)", "l_extendedprice": "price", "l_linestatus": "'O'", "l_returnflag": "'N'"}
    columns = spark.read.parquet(f"{small}/lineitem.parquet").schema.fields
    folder = tables("lineitem", found.selectExpr(*[f"cast({new.get(c.name, '1')} AS {c.dataType.simpleString()}) AS {c.name}" for c in columns]))
    text = lambda rows: [repr(r) for r in rows]
    got, want = rows_of_spark(Q.QUERIES[name](spark, folder)), rows_of_sql(folder, Q.ORACLES[name])
    assert got[0] == want[0] and text(got[1]) == text(want[1])


@pytest.mark.parametrize("knots", [2, 3, 4])
def test_sums_of_terms_are_the_spline(knots):
    rng = np.random.default_rng(knots)
    x, y = np.sort(rng.choice(2000, knots, replace=False)).astype(float), rng.normal(size=knots)
    at = np.linspace(x[0] - 1, x[-1] + 1, 50)
    for a, b in zip(TS.spline_at(x, y, at), TS.spline_at(x, y, at, 4), strict=True):
        assert np.isnan(a).any() and np.allclose(a, b, rtol=1e-6, atol=1e-7, equal_nan=True)


@pytest.mark.parametrize("unit", [RP.Unit(400, 64, 16), RP.Unit(50, 8, 4, True)])
def test_repeats_hold_little_of_a_batch(unit):
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1000, 500)) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    list(RP.runs_of(batch.slice(0, 10), unit))
    tracemalloc.start()
    try:
        for _, runs, _ in RP.runs_of(batch, unit):
            run, m, _ = runs.nodes()
            runs.common(run, m)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 3e6 and peak < 48e6, peak
