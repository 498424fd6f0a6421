"""Neighbourhood operators on tiles: rasters as rows, texture, edges, registration, segments."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropcube.session import ship


def raster_rows(tiles: DataFrame, width: int, origin: tuple[float, float], step: tuple[float, float], nodata: float | None = None) -> DataFrame:
    """Rows (id, y, x, v) of tiles; rows run from the first y downwards, missing values are NULL."""
    v = F.col("v").cast("double")
    v = v if nodata is None else F.nullif(v, F.lit(nodata))
    df = tiles.select("id", F.posexplode("data").alias("i", "v"))
    return df.select("id", (F.lit(origin[0]) - F.floor(F.col("i") / width) * step[0]).alias("y"), (F.lit(origin[1]) + F.pmod("i", F.lit(width)) * step[1]).alias("x"), v.alias("v"))


def rows_raster(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Tiles from rows: values by falling y, then x."""
    cell = F.struct((-F.col("y")).alias("y"), F.col("x"), F.col(value).alias("v"))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("data"))


def quantized(v: Column, low: Column, high: Column, levels: int) -> Column:
    """Level 0..levels-1 of a value between low and high."""
    return F.least(F.lit(levels - 1), F.floor(F.try_divide(v - low, high - low) * levels)).cast("int")


def glcm(cells: DataFrame, by: list[str], dr: int, dc: int, levels: int = 16) -> DataFrame:
    """Measures of the symmetric co-occurrence matrix of every tile at one displacement.

    Levels are equal parts of the tile's range; a flat tile is level 0. Pairs meet by an equi-join on the shifted place.
    """
    w = Window.partitionBy(*by)
    q = F.coalesce(quantized(F.col("v"), F.min("v").over(w), F.max("v").over(w), levels), F.lit(0))
    lv = cells.withColumn("q", q).select(*by, "r", "c", "q")
    a, b = lv.withColumnRenamed("q", "i"), lv.select(*by, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("q").alias("j"))
    pairs = a.join(b, [*by, "r", "c"]).select(*by, "i", "j")
    both = pairs.union(pairs.select(*by, F.col("j"), F.col("i")))
    p = both.groupBy(*by, "i", "j").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(w))
    d = F.col("i") - F.col("j")
    sums = p.groupBy(*by).agg(
        F.sum(F.col("p") * d * d).alias("contrast"),
        F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"),
        F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"),
        F.sum(F.col("p") * F.col("p")).alias("asm"),
        F.sum(-F.col("p") * F.log("p")).alias("entropy"),
        F.sum(F.col("p") * F.col("i")).alias("mean"),
        F.sum(F.col("p") * F.col("i") * F.col("i")).alias("ii"),
        F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"),
    )
    var = F.col("ii") - F.col("mean") * F.col("mean")
    return sums.select(
        *by, "contrast", "dissimilarity", "homogeneity", "asm", F.sqrt("asm").alias("energy"), "entropy", "mean", var.alias("variance"),
        F.when(var > 1e-12, (F.col("ij") - F.col("mean") * F.col("mean")) / var).alias("correlation"),
    )


MEASURES = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "entropy", "mean", "variance", "correlation")


def window_pairs(height: int, width: int, window: int, displacement: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every place's window (cut at the edge) the pairs of places ``displacement`` apart at 0, 45, 90 and 135 degrees: (first, second, is one)."""
    half, d = window // 2, displacement
    r, c = (x.ravel()[:, None] for x in np.indices((height, width)))
    i, j = (x.ravel()[None, :] for x in np.indices((window, window)))
    first, second, real = [], [], []
    for dr, dc in ((0, d), (d, -d), (d, 0), (d, d)):
        k = ((i + dr < window) & (j + dc >= 0) & (j + dc < window)).ravel()
        r0, c0 = r - half + i[:, k], c - half + j[:, k]
        r1, c1 = r0 + dr, c0 + dc
        ok = (np.minimum(r0, r1) >= 0) & (np.maximum(r0, r1) < height) & (np.minimum(c0, c1) >= 0) & (np.maximum(c0, c1) < width)
        first.append(np.where(ok, r0 * width + c0, 0))
        second.append(np.where(ok, r1 * width + c1, 0))
        real.append(ok)
    return np.concatenate(first, 1), np.concatenate(second, 1), np.concatenate(real, 1)


def window_measures(tiles: np.ndarray, width: int, window: int, displacement: int, levels: int) -> np.ndarray:
    """MEASURES of all windows of tiles of one shape: (tile, place, measure); NaN where a window has no pair (or, for the last, no variance)."""
    n = tiles.shape[1]
    below = (np.sort(tiles, axis=1)[:, None, :] < tiles[:, :, None]).sum(2)
    q = below * levels // n  # levels of equal probability; equal values have one level
    a, b, real = window_pairs(n // width, width, window, displacement)
    i, j = q[:, a], q[:, b]
    i, j = np.concatenate([i, j], 2), np.concatenate([j, i], 2)  # symmetric
    real = np.concatenate([real, real], 1)[None]
    count = real.sum(2)
    share = np.where(count > 0, 1 / np.maximum(count, 1), np.nan)
    mean_of = lambda x: np.where(real, x, 0).sum(2) * share
    code = np.where(real, i * levels + j, -1 - np.arange(real.shape[2]))
    p = (code[..., :, None] == code[..., None, :]).sum(3) * share[..., None]  # of each pair the probability of its levels
    d = i - j
    asm, mean = mean_of(p), mean_of(i)
    var = mean_of(i * i) - mean * mean
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -mean_of(np.log(p))
        corr = np.where(var > 1e-12, (mean_of(i * j) - mean * mean) / var, np.nan)
    return np.stack([mean_of(d * d), mean_of(np.abs(d)), mean_of(1 / (1 + d * d)), asm, np.sqrt(asm), entropy, mean, var, corr], axis=2)


def glcm_windows(tiles: DataFrame, width: int, window: int = 5, displacement: int = 4, levels: int = 16) -> DataFrame:
    """MEASURES of the symmetric co-occurrence matrix of every place's window, all four directions together: array operations over tiles.

    Levels are of equal probability in the tile. Windows are cut at the tile's edge; one without pairs has NULL measures, as has an
    empty tile or one with missing values.
    """
    ship(tiles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.asarray(x if x is not None else [], float) for x in pdf["data"]]
            for size in sorted({len(x) for x in data} - {0}):
                at = [k for k, x in enumerate(data) if len(x) == size]
                for part in (at[x : x + 64] for x in range(0, len(at), 64)):
                    t = np.stack([data[k] for k in part])
                    m = window_measures(t, width, window, displacement, levels)
                    m[np.isnan(t).any(1)] = np.nan
                    out = pd.DataFrame(m.reshape(-1, len(MEASURES)), columns=list(MEASURES)).astype(object)
                    out = out.where(out.notna(), None)
                    place = np.tile(np.arange(size), len(part))
                    out.insert(0, "id", np.repeat(pdf["id"].to_numpy()[part], size))
                    out.insert(1, "r", place // width)
                    out.insert(2, "c", place % width)
                    yield out

    return tiles.select("id", "data").mapInPandas(run, "id long, r int, c int, " + ", ".join(f"{m} double" for m in MEASURES))


def neighbours(cells: DataFrame, by: list[str], offsets: dict[str, list[tuple[int, int, float]]]) -> DataFrame:
    """Weighted sums over neighbours: for each name the sum of weight * v at (r + dr, c + dc); places whose neighbours lie outside are left out."""
    shifts = sorted({(dr, dc) for w in offsets.values() for dr, dc, _ in w})
    moved = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in shifts]))
    df = cells.withColumn("s", moved).select(*by, (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), "v")
    weight = lambda w: sum((F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("v") * k).otherwise(0.0) for dr, dc, k in w), F.lit(0.0))
    out = df.groupBy(*by, "r", "c").agg(F.count("*").alias("n"), *[F.sum(weight(w)).alias(name) for name, w in offsets.items()])
    return out.where(F.col("n") == len(shifts)).drop("n")


SOBEL = {
    "gx": [(-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)],
    "gy": [(-1, -1, -1.0), (-1, 0, -2.0), (-1, 1, -1.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)],
}


def sobel(cells: DataFrame, by: list[str]) -> DataFrame:
    """Strength of edges at inner places."""
    g = neighbours(cells, by, SOBEL)
    return g.select(*by, "r", "c", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("edge"))


def shift_scores(a: DataFrame, b: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Sum of products of two tiles for every shift of ``b`` up to ``reach`` places; cells meet by equi-join.

    ``b``'s cells are there once for each shift, which no estimate of sizes knows, so that side is never broadcast.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    moved = b.withColumn("s", shifts).select(*by, (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), F.col("v").alias("w"))
    return a.join(moved.hint("merge"), [*by, "r", "c"]).groupBy(*by, "dr", "dc").agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def tile_shift_scores(pairs: DataFrame, by: list[str], width: int, reach: int) -> DataFrame:
    """``shift_scores`` of small tiles: of each row the arrays of integers ``a`` and ``b``, row by row.

    Tiles meet whole and their cells are shifted by array operations, so no cell is joined. Missing cells have no product.
    """
    span = 2 * reach + 1
    shifts = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]

    def grids(column: pa.Array, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        values = column.take(pa.array(rows)).flatten()
        there = values.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((2, len(rows), -(-size // width) * width), np.int64)
        out[0, :, :size] = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        out[1, :, :size] = there.reshape(len(rows), size)
        v, there = out.reshape(2, len(rows), -1, width)
        return v, there.astype(bool)

    @F.arrow_udf("array<long>")
    def scores(a: pa.Array, b: pa.Array) -> pa.Array:
        sizes = np.stack([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b)])
        total, found = np.zeros((len(a), len(shifts)), np.int64), np.zeros((len(a), len(shifts)), bool)
        for na, nb in np.unique(sizes[:, (sizes > 0).all(0)], axis=1).T.tolist():
            of_size = np.flatnonzero((sizes[0] == na) & (sizes[1] == nb))
            step = max(1, (1 << 18) // max(na, nb))
            for rows in (of_size[k : k + step] for k in range(0, len(of_size), step)):
                (v, v_there), (w, w_there) = grids(a, rows, na), grids(b, rows, nb)
                for k, (dr, dc) in enumerate(shifts):
                    r, c = slice(max(0, -dr), max(0, min(v.shape[1], w.shape[1] - dr))), slice(max(0, -dc), max(0, width - max(0, dc)))
                    r1, c1 = slice(max(0, dr), max(0, r.stop + dr)), slice(max(0, dc), max(0, c.stop + dc))
                    total[rows, k] = (v[:, r, c] * w[:, r1, c1]).sum((1, 2))
                    found[rows, k] = (v_there[:, r, c] & w_there[:, r1, c1]).any((1, 2))
        offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * len(shifts))
        return pa.ListArray.from_arrays(offsets, pa.array(total.ravel(), mask=~found.ravel()))

    df = pairs.where((F.size("a") > 0) & (F.size("b") > 0)).select(*by, F.posexplode(scores("a", "b")).alias("k", "score"))
    df = df.select(*by, (F.expr(f"k div {span}").cast("int") - reach).alias("dr"), (F.col("k") % span - reach).alias("dc"), "score")
    return df.groupBy(*by, "dr", "dc").agg(F.sum("score").alias("score"))


def best_shift(scores: DataFrame, by: list[str]) -> DataFrame:
    """The shift with the highest score; of equal ones the smallest, then the least."""
    key = F.struct(F.col("score"), -(F.abs("dr") + F.abs("dc")), -F.col("dr"), -F.col("dc"))
    return scores.groupBy(*by).agg(F.max_by(F.struct("dr", "dc", "score"), key).alias("s")).select(*by, "s.*")


def fft_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Whole-place shift of ``b`` against ``a`` by the peak of their circular cross-correlation."""
    peak = np.fft.ifft2(np.fft.fft2(np.nan_to_num(a)) * np.conj(np.fft.fft2(np.nan_to_num(b)))).real
    at = np.array(np.unravel_index(np.argmax(np.round(peak, 9)), peak.shape))
    size = np.array(peak.shape)
    r, c = np.where(at > size // 2, at - size, at)
    return int(r), int(c)


def slic(tiles: DataFrame, width: int, segments: int = 4, rounds: int = 5, compactness: float = 1.0) -> DataFrame:
    """Superpixels: k-means of (place, value) in each tile from a regular lattice of centres; a tile is one row, so nothing is shuffled."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = max(1, round(segments**0.5))
        for pdf in batches:
            out = []
            for id_, data in zip(pdf["id"], pdf["data"], strict=True):
                t = np.asarray(data, float).reshape(-1, width)
                r, c = np.indices(t.shape)
                f = np.stack([r.ravel() / t.shape[0] * compactness, c.ravel() / width * compactness, (t.ravel() - t.mean()) / (t.std() or 1)], axis=1)
                at = [((2 * i + 1) * t.shape[0] // (2 * k), (2 * j + 1) * width // (2 * k)) for i in range(k) for j in range(k)]
                centre = f[[i * width + j for i, j in at]]
                for _ in range(rounds):
                    label = np.argmin(((f[:, None] - centre[None]) ** 2).sum(2), axis=1)
                    centre = np.stack([f[label == s].mean(0) if (label == s).any() else centre[s] for s in range(len(centre))])
                out.extend(zip([id_] * len(f), r.ravel().tolist(), c.ravel().tolist(), label.tolist(), strict=True))
            yield pd.DataFrame(out, columns=["id", "r", "c", "segment"])

    return tiles.select("id", "data").mapInPandas(run, "id long, r int, c int, segment int")


def edge_strength(t: np.ndarray) -> np.ndarray:
    """Sobel magnitude of a tile that is mirrored at its border; kernels weigh 1 in all, both directions are averaged."""
    p = np.pad(t, 1, mode="symmetric")
    down = (p[2:] - p[:-2]) / 4
    right = (p[:, 2:] - p[:, :-2]) / 4
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = right[:-2] + 2 * right[1:-1] + right[2:]
    return np.sqrt((gx * gx + gy * gy) / 2)


def flooded(surface: np.ndarray, seeds: list[tuple[int, int]], compactness: float) -> np.ndarray:
    """The seed that reaches each place when water rises over the surface; its distance adds ``compactness`` a place. Places without a
    value are reached last; of equal heights the one that was found first counts."""
    height, width = surface.shape
    surface = np.where(np.isnan(surface), np.inf, surface)
    label = np.full(surface.shape, -1)
    queue = [(surface[s], k, *s, k) for k, s in enumerate(seeds)]
    heapq.heapify(queue)
    found = len(queue)
    while queue:
        _, _, r, c, k = heapq.heappop(queue)
        if label[r, c] >= 0:
            continue
        label[r, c] = k
        for i, j in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= i < height and 0 <= j < width and label[i, j] < 0:
                far = math.hypot(i - seeds[k][0], j - seeds[k][1])
                heapq.heappush(queue, (surface[i, j] + compactness * far, found, i, j, k))
                found += 1
    return label


def watershed(tiles: DataFrame, width: int, segments: int = 4, compactness: float = 0.001) -> DataFrame:
    """Compact watershed of the edges of each tile, from a regular lattice of seeds; a tile is one row, so nothing is shuffled. Empty
    tiles give no rows."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = max(1, round(segments**0.5))
        for pdf in batches:
            out = []
            for id_, data in zip(pdf["id"], pdf["data"], strict=True):
                if data is None or not len(data):
                    continue
                t = np.asarray(data, float).reshape(-1, width)
                seeds = sorted({((2 * i + 1) * t.shape[0] // (2 * k), (2 * j + 1) * width // (2 * k)) for i in range(k) for j in range(k)})
                r, c = np.indices(t.shape)
                label = flooded(edge_strength(t), seeds, compactness)
                out.append(pd.DataFrame({"id": id_, "r": r.ravel(), "c": c.ravel(), "segment": label.ravel()}))
            if out:
                yield pd.concat(out)

    return tiles.select("id", "data").mapInPandas(run, "id long, r int, c int, segment int")


def lee_sigma(tiles: DataFrame, width: int, window: int = 5, looks: int = 1, sigma: float = 0.9) -> DataFrame:
    """Speckle filter of single tiles: the minimum-mean-square estimate from the neighbours within the sigma range of the place's own
    first estimate (all neighbours where that range is empty). ``sigma`` is the share of the range that counts, for positive values."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = window // 2
        noise = 1 / looks
        for pdf in batches:
            out = []
            for id_, data in zip(pdf["id"], pdf["data"], strict=True):
                t = np.asarray(data, float).reshape(-1, width)
                f = np.empty_like(t)
                for r, c in np.ndindex(t.shape):
                    part = t[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1].ravel()
                    prior = part.mean()
                    part = part[(part >= prior * (1 - sigma)) & (part <= prior * (1 + sigma))] if prior > 0 else part
                    part = part if len(part) else t[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1].ravel()
                    m, v = part.mean(), part.var()
                    real = max(0.0, (v - m * m * noise) / (1 + noise))
                    f[r, c] = m + (real / v if v > 0 else 0.0) * (t[r, c] - m)
                out.append((id_, f.ravel().tolist()))
            yield pd.DataFrame(out, columns=["id", "data"])

    return tiles.select("id", "data").mapInPandas(run, "id long, data array<double>")


def zonal_mean(df: DataFrame, zone: list[str], value: str = "v") -> DataFrame:
    """The mean of its zone at every place."""
    return df.withColumn("zonal_mean", F.avg(value).over(Window.partitionBy(*zone)))
