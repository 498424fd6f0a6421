import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cropcube.functions import bands as B
from cropcube.operators import cube as C
from cropcube.operators import dates as D
from cropcube.operators import features as FT
from cropcube.operators import geometry as G
from cropcube.operators import metrics as M
from cropcube.operators import texture as TX
from cropcube.operators import timeseries as TS
from cropcube.sources import catalog as CAT
from cropcube.sources import raster as R
from cropcube.stack import RegionStack
from cropcube.streaming import ingest as I

DAY0 = datetime.date(2015, 1, 1)


def day(n):
    return DAY0 + datetime.timedelta(days=n)


@given(st.lists(st.integers(0, 400), min_size=4, max_size=12, unique=True), st.tuples(*[st.floats(-3, 3)] * 4))
@settings(max_examples=60, deadline=None)
def test_spline_reproduces_cubics(days, c):
    x = np.array(sorted(days), float)
    f = lambda t: c[0] + c[1] * t / 100 + c[2] * (t / 100) ** 2 + c[3] * (t / 100) ** 3
    g = lambda t: c[1] / 100 + 2 * c[2] * t / 1e4 + 3 * c[3] * t**2 / 1e6
    at = np.linspace(x[0], x[-1], 9)
    v, s = TS.spline_at(x, f(x), at)
    assert np.allclose(v, f(at), rtol=1e-6, atol=1e-5) and np.allclose(s, g(at), rtol=1e-5, atol=1e-5)


def test_spline_edges():
    one = TS.spline_at(np.array([3.0]), np.array([1.0]), np.array([3.0]))
    twice = TS.spline_at(np.array([1.0, 1.0, 2.0]), np.array([1.0, 2.0, 3.0]), np.array([1.0]))
    out = TS.spline_at(np.array([0.0, 10.0]), np.array([0.0, 5.0]), np.array([-1.0, 4.0, 11.0]))
    assert np.isnan(one[0]).all() and np.isnan(twice[0]).all()
    assert np.isnan(out[0][[0, 2]]).all() and np.isclose(out[0][1], 2.0) and out[1][1] == 0.5


def test_interpolated_has_no_nan(spark):
    df = spark.createDataFrame([(1, day(0), 1.0), (1, day(10), None), (1, day(20), 3.0), (2, day(5), 7.0)], "p int, time date, value double")
    at = F.array(*[F.lit(day(k)) for k in (-1, 10, 20)])
    rows = {(r.p, r.time): (r.value, r.slope) for r in TS.interpolated(TS.as_arrays(df, ["p"]), at).collect()}
    assert rows[1, day(10)] == (2.0, 0.1) and rows[1, day(-1)] == (None, None) and rows[2, day(10)] == (None, None)


def test_gaussian_keeps_constants(spark):
    assert math.isclose(sum(TS.gaussian_weights()), 1) and len(TS.gaussian_weights()) == 17
    df = spark.createDataFrame([(1, day(k), 4.0) for k in range(5)], "p int, time date, value double")
    s = TS.as_arrays(df, ["p"]).select(TS.smoothed().alias("s")).first().s
    assert all(math.isclose(p.v, 4.0) for p in s)


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(day(100),), (day(300),)], "time date")
    right = spark.createDataFrame([("A", day(k)) for k in (89, 95, 105, 111)] + [("D", day(k)) for k in (90, 311)], "orbit string, time date")
    rows = {(r.left_time, r.orbit): r.right_time for r in D.nearest(left, right, 10).collect()}
    assert rows == {(day(100), "A"): day(105), (day(100), "D"): day(90)}


def test_best_dates(spark):
    q = spark.createDataFrame([(day(0), 0.9), (day(3), 0.95), (day(20), 0.7), (day(40), 0.85)], "time date, fraction double")
    got = {r.time for r in D.best_dates_spaced(q).collect()}
    assert got == {day(0), day(3), day(40)}
    assert {r.time for r in D.best_dates_spaced(q, strict=True).collect()} == {day(3), day(40)}
    assert D.best_date(q).first().time == day(3)


def test_mosaic_and_merge(spark):
    df = spark.createDataFrame([(1, 1, None, 5), (1, 2, 7, 6), (2, 9, 8, None)], "y int, tile int, a int, b int")
    assert {tuple(r) for r in C.first_wins(df, ["y"], ["a", "b"], ["tile"]).collect()} == {(1, 7, 5), (2, 8, None)}
    a = spark.createDataFrame([(1, 10), (2, 20)], "y int, v int")
    b = spark.createDataFrame([(2, 21), (3, 30)], "y int, v int")
    assert [tuple(r) for r in C.conflicts(a, b, ["y"], "v").collect()] == [(2, 20, 21)]
    assert sorted(tuple(r) for r in C.merge(a, b, ["y"]).collect()) == [(1, 10), (2, 20), (3, 30)]


def test_polygon_parity(spark):
    places = spark.range(0, 400).select((F.col("id") % 20 + 0.5).alias("x"), (F.floor(F.col("id") / 20) + 0.5).alias("y"))
    lots = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, [(10.0, 0.0), (14.0, 0.0), (12.0, 4.0)])], "lot int, ring array<struct<x: double, y: double>>")
    n = {r.lot: r["count"] for r in G.places_in_lots(places, lots, 3.0).groupBy("lot").count().collect()}
    assert n == {1: 16, 2: 8}


def test_utm(spark):
    east, north = G.utm(F.lit(-75.0), F.lit(0.0))
    e2, n2 = G.utm(F.lit(-74.0), F.lit(4.6))
    r = spark.range(1).select(east.alias("a"), north.alias("b"), e2.alias("c"), n2.alias("d")).first()
    assert abs(r.a - 500000) < 1e-6 and abs(r.b) < 1e-6
    assert abs(r.c - 610915.2) < 50 and abs(r.d - 508532) < 100


def test_translate_and_back(spark):
    grid = spark.range(25).select((F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    df = grid.withColumn("v", F.when((F.col("x") == 2) & (F.col("y") == 2), 9).otherwise(0))
    moved = C.translate(df, grid, 1, -2, ["v"], [])
    assert [(r.y, r.x) for r in moved.where("v = 9").collect()] == [(1.0, 4.0)]
    assert C.translate(moved, grid, -1, 2, ["v"], []).where("v = 9").count() == 1


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15 + [(None, 1)], "truth int, pred int")
    assert math.isclose(float(M.overall_accuracy(df).first()[0]), 70.0) and math.isclose(M.cohen_kappa(df).first()[0], 0.4)
    ua = {r["class"]: (round(r.user_accuracy, 4), r.producer_accuracy) for r in M.user_producer(df).collect()}
    assert ua == {0: (0.6667, 0.8), 1: (0.75, 0.6)}
    perfect = spark.createDataFrame([(0, 0), (1, 1)], "truth int, pred int")
    assert M.cohen_kappa(perfect).first()[0] == 1.0


def test_split_shares(spark):
    df = spark.range(100).select(F.col("id").alias("lot"), (F.col("id") % 3).alias("vclass"), F.lit(DAY0).alias("time"))
    n = {(r.vclass, r.tt): r["count"] for r in FT.stratified_split(df).groupBy("vclass", "tt").count().collect()}
    assert n[0, "train"] == 24 and n[1, "train"] == 23 and n[1, "test"] == 10


def test_scalars(spark):
    r = spark.range(1).select(
        B.clip(F.lit(70000), 0, 65535).alias("a"), B.relative_name("NDVI", F.lit(-16)).alias("b"), B.to_db(F.lit(0.0)).alias("c"), B.half_even_share(F.lit(15), 0.7).alias("d"), B.half_even_share(F.lit(35), 0.7).alias("e")
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (65535, "NDVI_n16", None, 10.0, 24.0)
    assert B.relative_names("LSWI", [-16, 0, 16]) == ["LSWI_n16", "LSWI_0", "LSWI_16"]
    z = spark.createDataFrame([(0, 0)], "nir int, red int").select(B.ndvi()).first()[0]
    assert z is None


def test_dates_in_names(spark):
    r = spark.range(1).select(
        CAT.date_of("S2", F.lit("S2A_MSIL2A_20151221T1")).alias("a"), CAT.date_of("S2", F.lit("x" * 47 + "20160107")).alias("b"), CAT.date_of("LC08", F.lit("LC080080572015122101T1")).alias("c"), CAT.radar_date(F.lit("S1_A_VV_05Jan2016_db")).alias("d")
    ).first()
    assert (r.a, r.b, r.c, r.d) == (datetime.date(2015, 12, 21), datetime.date(2016, 1, 7), datetime.date(2015, 12, 21), datetime.date(2016, 1, 5))


def test_tiff_round_trip(spark, tmp_path):
    a = np.arange(12, dtype="f4").reshape(3, 4)
    back, grid = R.decode(R.encode(a, 100.0, 10.0, 500.0, 10.0))
    assert (back == a).all() and grid == (100.0, 10.0, 500.0, 10.0)
    tiles = spark.createDataFrame([(day(0), 4, 100.0, 10.0, 500.0, 10.0, a.ravel().tolist())], "time date, width int, x0 double, dx double, y0 double, dy double, data array<float>")
    names = R.write_tiles(tiles, str(tmp_path), "ndvi")
    assert names == [str(tmp_path / "ndvi_2015-01-01.tif")]
    rows = {(r.y, r.x): r.v for r in R.pixels(R.read_tiles(spark, str(tmp_path)), 0.0).collect()}
    assert rows[500.0, 100.0] is None and rows[480.0, 130.0] == 11.0 and len(rows) == 12


def test_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("S2", day(k), float(k % 3), 0.0, k) for k in range(60)], "product string, time date, y double, x double, nir int")
    path = str(tmp_path / "store")
    assert I.append_months(df.where("nir < 31"), path) == 31
    assert I.append_months(df, path) == 29 and I.append_months(df, path) == 0
    stack = RegionStack(spark, path)
    assert stack.products() == ["S2"] and stack.between("S2", "2015-01-20", "2015-02-05").count() == 17


def test_stream_reads_each_file_once(spark, tmp_path):
    df = spark.createDataFrame([("S2", day(k), 0.0, 0.0, k % 2 == 0) for k in range(40)], "product string, time date, y double, x double, mask boolean")
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for part in (df.where(F.col("time") < day(20)), df.where(F.col("time") >= day(20))):
        part.write.mode("append").parquet(src)
        I.stream_months(spark, src, df.schema, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 40
    q = I.stream_monthly_fraction(spark, src, df.schema).writeStream.format("memory").queryName("fr").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fr").agg(F.sum("n")).first()[0] == 40


def test_registration_and_segments(spark):
    rng = np.random.default_rng(0)
    a = rng.random((16, 16))
    assert TX.fft_shift(np.roll(a, (2, -3), (0, 1)), a) == (2, -3)
    tiles = spark.createDataFrame([(1, [0.0] * 32 + [9.0] * 32)], "id long, data array<double>")
    seg = {(r.r, r.c): r.segment for r in TX.slic(tiles, 8, 4).collect()}
    assert len(seg) == 64 and seg[0, 0] != seg[7, 0]


@pytest.mark.parametrize("names", [["qa_cloud", "nir"], ["nir"]])
def test_projection(spark, names):
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert C.matching(df, "^qa") == (["qa_cloud"] if "qa_cloud" in names else None)


def test_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from cropcube.sources import archives as A

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/b1.tif", b"one")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("b2.tif")
        info.size = 3
        t.addfile(info, io.BytesIO(b"two"))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "note.txt").write_bytes(b"none")
    rows = {(r.archive, r.member): (bytes(r.content) if r.content else None, r.error) for r in A.members(spark, str(tmp_path)).collect()}
    assert rows == {("a.zip", "x/b1.tif"): (b"one", None), ("b.tar.gz", "b2.tif"): (b"two", None), ("broken.zip", None): (None, "BadZipFile")}
    done = spark.createDataFrame([("a.zip",), ("broken.zip",)], "archive string")
    assert [r.member for r in A.members(spark, str(tmp_path), done).collect()] == ["b2.tif"]


def test_lee_sigma(spark):
    rng = np.random.default_rng(3)
    noisy = 10 * rng.gamma(4, 0.25, 64)
    tiles = spark.createDataFrame([(1, [5.0] * 64), (2, noisy.tolist())], "id long, data array<double>")
    out = {r.id: np.array(r.data) for r in TX.lee_sigma(tiles, 8, looks=4).collect()}
    assert np.allclose(out[1], 5.0) and out[2].std() < 0.7 * noisy.std() and abs(out[2].mean() - noisy.mean()) < 1.5


def test_trend_counts_scene_dates(spark):
    rows = [(day(0), 1.0, 0.0, 10), (day(8), 1.0, 0.0, 18), (day(16), 1.0, 0.0, 50), (day(0), 2.0, 0.0, 1), (day(16), 2.0, 0.0, 33), (day(24), 2.0, 0.0, None), (day(32), 1.0, 0.0, 9)]
    cube = spark.createDataFrame(rows, "time date, y double, x double, v int")
    told = lambda lag: {(r.y, r.time): r.trend for r in D.trend(cube, "v", ["y", "x"], lag).collect()}
    assert told(1) == {(1.0, day(0)): None, (1.0, day(8)): 1.0, (1.0, day(16)): 4.0, (1.0, day(32)): None, (2.0, day(0)): None, (2.0, day(16)): None, (2.0, day(24)): None}
    assert told(2)[2.0, day(16)] == 2.0 and told(2)[1.0, day(16)] == 2.5


def test_merge_fails_on_conflicts(spark):
    a = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "y int, v int")
    b = spark.createDataFrame([(1, 11), (2, 20), (4, 40)], "y int, v int")
    with pytest.raises(Exception, match="differ"):
        C.merge(a, b, ["y"], on_conflict="raise").collect()
    assert sorted(map(tuple, C.merge(a, b, ["y"], on_conflict="left").collect())) == [(1, 10), (2, 20), (3, 30), (4, 40)]
    assert C.merge(a, b.where("y > 1"), ["y"], on_conflict="raise").count() == 4
    with pytest.raises(ValueError):
        C.merge(a, b, ["y"], on_conflict="right")


def test_collocate_takes_coarse_and_fine_slaves(spark):
    coarse = spark.createDataFrame([(4.0 * i, 4.0 * j, 10 * i + j) for i in range(2) for j in range(2)], "y double, x double, v int")
    got = {(r.row, r.col): r.v for r in C.collocate_cells(coarse, (0.0, 0.0), (4.0, 4.0), (0.0, 0.0), (1.0, 1.0), (6, 6), ["v"], []).collect()}
    assert got == {(r, c): 10 * (r >= 2) + (c >= 2) for r in range(6) for c in range(6)}
    fine = spark.createDataFrame([(float(i), float(j), 10 * i + j) for i in range(9) for j in range(9)], "y double, x double, v int")
    got = {(r.row, r.col): r.v for r in C.collocate_cells(fine, (0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (4.0, 4.0), (3, 3), ["v"], []).collect()}
    assert got == {(r, c): 40 * r + 4 * c for r in range(3) for c in range(3)}


def test_radar_pixels_stand_at_optical_dates(spark):
    radar = [("ASCENDING", day(95), 0.0, 1.0), ("ASCENDING", day(105), 0.0, 2.0), ("DESCENDING", day(90), 0.0, 3.0), ("DESCENDING", day(90), 1.0, 4.0), ("DESCENDING", day(140), 0.0, 5.0)]
    cube = spark.createDataFrame([(o, t, y, 0.0, v) for o, t, y, v in radar], "orbit string, time date, y double, x double, vv double")
    dates = spark.createDataFrame([(day(100),), (day(120),), (day(150),)], "time date")
    got = {(r.time, r.y): (r.vv_ASCENDING, r.vv_DESCENDING) for r in D.nearest_cube(cube, dates, ["vv"], ["ASCENDING", "DESCENDING"]).collect()}
    assert got == {(day(100), 0.0): (2.0, 3.0), (day(100), 1.0): (None, 4.0), (day(150), 0.0): (None, 5.0)}


def test_window_pairs_of_a_tile():
    a, b, real = TX.window_pairs(5, 5, 5, 4)
    centre = {tuple(sorted(p)) for p in zip(a[12][real[12]].tolist(), b[12][real[12]].tolist(), strict=True)}
    assert centre == {(5 * r, 5 * r + 4) for r in range(5)} | {(c, 20 + c) for c in range(5)} | {(0, 24), (4, 20)} and not real[0].any()
    m = TX.window_measures(np.array([[0.0] * 25, list(range(25))]), 5, 5, 4, 16)
    assert m[0, 12].tolist()[:7] == [0, 0, 1, 1, 1, 0, 0] and np.isnan(m[0, 12, 8]) and np.isnan(m[1, 0]).all() and m[1, 12, 3] > 0


def test_damaged_archives_are_rows(spark, tmp_path):
    import io
    import zipfile

    from cropcube.sources import archives as A

    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.txt", "some text that deflates " * 50)
    data = bytearray(blob.getvalue())
    data[45:60] = bytes(15)
    (tmp_path / "damaged.zip").write_bytes(bytes(data))
    rows = A.members(spark, str(tmp_path)).collect()
    assert [(r.archive, r.member) for r in rows] == [("damaged.zip", None)] and rows[0].error


def test_folder_has_one_slash(spark):
    df = spark.createDataFrame([("a",), ("a/",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(CAT.folder(F.col("p"))).collect()] == ["a/", "a/", "/", None]


def clusters(spark, n, seed):
    """Rows of three classes around three centres."""
    from cropcube.operators import models as ML

    rng = np.random.default_rng(seed)
    rows = [(i, i % 3, *(float(x) for x in rng.normal([(0, 0), (4, 1), (1, 5)][i % 3], 0.8))) for i in range(n)]
    return ML.assembled(spark.createDataFrame(rows, "id long, class int, u double, v double"), ["u", "v"], "class")


@pytest.mark.parametrize(("kind", "params"), [("rf", {"trees": 20, "depth": 5}), ("gbm", {"rounds": 3, "depth": 3}), ("bayes", {}), ("mlp", {"layers": [2, 6, 3], "rounds": 60}), ("logistic", {})])
def test_models_learn(spark, kind, params):
    from cropcube.operators import models as ML

    rows = ML.predicted(clusters(spark, 150, 1), clusters(spark, 90, 2), kind, **params).select("truth", "pred").collect()
    assert len(rows) == 90 and sum(r.truth == r.pred for r in rows) >= 81


def test_grid_ranks_its_combinations(spark, small):
    from cropcube.plans import queries as Q

    found = [r.accuracy for r in Q.QUERIES["model_grid"](spark, small).collect()]
    assert Q.QUERIES["model_gbm"](spark, small).count() > 0
    assert len(found) == 4 and found == sorted(found, reverse=True) and all(0 <= a <= 1 for a in found)


def test_water_meets_at_ridges_and_compact_segments_are_the_nearest_seeds(spark):
    ridge = np.zeros((7, 9))
    ridge[:, 4] = 5.0
    label = TX.flooded(ridge, [(3, 1), (3, 7)], 0.0)
    assert (label[:, :4] == 0).all() and (label[:, 5:] == 1).all()
    rng = np.random.default_rng(3)
    seeds = [(2, 3), (9, 1), (7, 10)]
    label = TX.flooded(rng.random((12, 13)), seeds, 1e6)
    for (r, c), k in np.ndenumerate(label):
        far = [math.hypot(r - i, c - j) for i, j in seeds]
        assert far[k] == min(far)
    tiles = spark.createDataFrame([(1, [0.0] * 32 + [9.0] * 32), (2, []), (3, None), (4, [float("nan")] * 8)], "id long, data array<double>")
    seg = {(r.id, r.r, r.c): r.segment for r in TX.watershed(tiles, 8, 4).collect()}
    assert len(seg) == 72 and seg[1, 0, 0] != seg[1, 7, 0] and min(seg.values()) == 0


def test_edges_of_tiles_are_those_of_cells(spark):
    t = np.random.default_rng(4).random((6, 8))
    cells = spark.createDataFrame([(1, int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(t)], "id int, r int, c int, v double")
    inner = {(r.r, r.c): r.edge for r in TX.sobel(cells, ["id"]).collect()}
    got = TX.edge_strength(t)
    assert len(inner) == 24 and all(math.isclose(got[k], v / 4 / math.sqrt(2)) for k, v in inner.items())


@pytest.mark.parametrize("by_band", [False, True])
def test_cube_to_rasters(spark, tmp_path, by_band):
    rows = [(day(t), 10.0 * y, 20.0 * x, float(t * 100 + y * 10 + x), 1) for t in (0, 3) for y in range(5) for x in range(4) if (y, x) != (2, 2)]
    cube = spark.createDataFrame(rows, "time date, y double, x double, nir double, red int")
    names = R.write_cube(cube, str(tmp_path), ["nir", "red"], 1, (10.0, 20.0), {"sum": F.col("nir") + F.col("red")}, by_band, side=3)
    assert len(names) == 4 * (3 if by_band else 1) and all("2015-01-04" in n for n in names)
    assert names == R.write_cube(cube, str(tmp_path), ["nir", "red"], day(3), (10.0, 20.0), {"sum": F.col("nir") + F.col("red")}, by_band, side=3)
    got = R.pixels(R.read_tiles(spark, str(tmp_path))).collect()
    nir = {(r.y, r.x): r.v for r in got if ("nir" in r.path if by_band else r.band == 1)}
    total = {(r.y, r.x): r.v for r in got if ("sum" in r.path if by_band else r.band == 3)}
    assert nir == {(10.0 * y, 20.0 * x): None if (y, x) == (2, 2) else 300.0 + y * 10 + x for y in range(5) for x in range(4)}
    assert total == {k: None if v is None else v + 1 for k, v in nir.items()}


def test_footprints_touch_an_area(spark):
    area = [(0.0, 0.0), (6.0, 1.0), (3.0, 2.0), (5.0, 6.0), (-1.0, 4.0)]
    rng = np.random.default_rng(5)
    boxes = [(float(x), float(x + w), float(y), float(y + h)) for x, y, w, h in zip(*rng.uniform(-4, 8, (2, 120)), *rng.uniform(0.05, 3, (2, 120)), strict=True)]
    boxes += [(-9.0, 9.0, -9.0, 9.0), (1.0, 1.2, 2.0, 2.2), (5.0, 5.0, 6.0, 6.0)]

    def inside(x, y):
        edges = zip(area, [*area[1:], area[0]], strict=True)
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in edges) % 2 == 1

    def brute(x0, x1, y0, y1):
        grid = any(inside(x, y) for x in np.linspace(x0, x1, 60) for y in np.linspace(y0, y1, 60))
        edge = any(x0 <= a + (c - a) * t <= x1 and y0 <= b + (d - b) * t <= y1 for (a, b), (c, d) in zip(area, [*area[1:], area[0]], strict=True) for t in np.linspace(0, 1, 2001))
        return grid or edge

    df = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "k int, x_min double, x_max double, y_min double, y_max double")
    assert {r.k for r in CAT.search(df, area=area).collect()} == {k for k, b in enumerate(boxes) if brute(*b)}


def test_numbering_is_the_order(spark):
    from cropcube.operators.numbering import numbered

    rng = np.random.default_rng(6)
    rows = [(int(k), "hot" if k % 3 == 0 else None if k % 50 == 1 else f"n{rng.integers(900):03}") for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(7)
    got = {r.k: r.n for r in numbered(df, "n", F.col("name"), F.col("k")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert got == {k: n for n, (k, _) in enumerate(want, 1)}
    assert numbered(df.limit(0), "n", F.col("name")).count() == 0


def test_operators_by_name(spark):
    from cropcube.registry import OPERATORS, Registry

    df = spark.createDataFrame([("S2", day(0), "a"), ("S2", day(9), "b"), ("LC08", day(9), "c")], "product string, time date, name string")
    steps = OPERATORS.pipeline(("search", {"product": "S2", "start": "2015-01-05"}), ("with_bands", {}))
    assert {r.name for r in df.transform(steps).collect()} == {"b"}
    assert {"time", "values"} & set(OPERATORS.parameters("translate")) and "watershed" in OPERATORS.names()
    with pytest.raises(KeyError):
        OPERATORS.pipeline(("nothing", {}))
    with pytest.raises(TypeError):
        OPERATORS.create("search", df, colour="red")
    own = Registry()
    own.add("top", lambda x, n: x.limit(n))
    assert own.create("top", df, n=1).count() == 1
    with pytest.raises(ValueError):
        own.add("top", lambda x: x)
