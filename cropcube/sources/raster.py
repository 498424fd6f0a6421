"""Rasters as a Spark data source: plain TIFF files (32-bit floats, one strip) written and read without other libraries.

Read: ``spark.read.format("cropcube_tiff").load(folder)`` gives (path, time, band, width, height, x0, dx, y0, dy, data), a row
for each band. Write: ``write_tiles``, ``write_cube``. The files a task reads or writes are its own; on a cluster the folder must be one that all machines mount.
"""

from __future__ import annotations

import datetime
import os
import re
import struct
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cropcube.operators.cube import by_position
from cropcube.session import ship

SCHEMA = "path string, time date, band int, width int, height int, x0 double, dx double, y0 double, dy double, data array<float>"


def encode(data: np.ndarray, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = 1.0) -> bytes:
    """A little-endian TIFF of one strip of floats, with the grid's step and origin in the usual tags; (bands, rows, columns) or one band."""
    a = np.asarray(data, "<f4")
    a = a[None] if a.ndim == 2 else a
    n, h, w = a.shape
    body = np.ascontiguousarray(a.transpose(1, 2, 0)).tobytes()  # the bands of a place stand together
    extra = struct.pack("<3d", dx, dy, 0.0) + struct.pack("<6d", 0.0, 0.0, 0.0, x0, y0, 0.0)
    each = len(extra) + 8
    extra += struct.pack(f"<{n}H", *[32] * n) + struct.pack(f"<{n}H", *[3] * n)
    extra += b"\0" * (-len(extra) % 4)
    strip = 8 + len(extra)
    # a value stands in its entry where it fits
    short = lambda v, at: at if n > 2 else v | (v << 16 if n == 2 else 0)
    entries = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, n, short(32, each)), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, strip), (277, 3, 1, n), (278, 4, 1, h),
        (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, n, short(3, each + 2 * n)), (33550, 12, 3, 8), (33922, 12, 6, 8 + 24),
    ]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", strip + len(body)) + extra + body + ifd


def decode(blob: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The values and (x0, dx, y0, dy) of a file that ``encode`` wrote; (bands, rows, columns) if it has several bands."""
    if blob[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack_from("<I", blob, 4)[0]
    tags = {e[0]: e for e in (struct.unpack_from("<HHII", blob, at + 2 + 12 * k) for k in range(struct.unpack_from("<H", blob, at)[0]))}
    w, h, n = tags[256][3], tags[257][3], tags[277][3]
    shorts = lambda e: struct.unpack_from(f"<{n}H", blob, e[3]) if n > 2 else ((e[3] & 0xFFFF,) * n)
    if tags[259][3] != 1 or set(shorts(tags[258])) != {32} or set(shorts(tags[339])) != {3}:
        raise ValueError("only plain 32-bit floats are read")
    data = np.frombuffer(blob, "<f4", w * h * n, tags[273][3]).reshape(h, w, n).transpose(2, 0, 1)
    dx, dy, _ = struct.unpack_from("<3d", blob, tags[33550][3])
    tie = struct.unpack_from("<6d", blob, tags[33922][3])
    return data[0] if n == 1 else data, (tie[3], dx, tie[4], dy)


class TiffSource(DataSource):
    """One partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "cropcube_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options["path"])


class TiffReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = (os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.endswith((".tif", ".tiff")))
        return [InputPartition(p) for p in sorted(found)] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            data, (x0, dx, y0, dy) = decode(f.read())
        m = re.search(r"(\d{4})-?(\d{2})-?(\d{2})", os.path.basename(partition.value))
        day = datetime.date(*map(int, m.groups())) if m else None
        for k, t in enumerate(data[None] if data.ndim == 2 else data):
            yield (partition.value, day, k + 1, t.shape[1], t.shape[0], x0, dx, y0, dy, t.ravel().tolist())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TiffSource)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("cropcube_tiff").load(folder)


def pixels(tiles: DataFrame, nodata: float | None = None) -> DataFrame:
    """Rows (path, time, band, y, x, v); y falls from y0, missing values are NULL."""
    v = F.col("v").cast("double")
    df = tiles.select("*", F.posexplode("data").alias("i", "v"))
    v = v if nodata is None else F.nullif(v, F.lit(nodata))
    return df.select("path", "time", "band", (F.col("y0") - F.floor(F.col("i") / F.col("width")) * F.col("dy")).alias("y"), (F.col("x0") + F.pmod("i", "width") * F.col("dx")).alias("x"), F.when(~F.isnan(v), v).alias("v"))


def write_tiles(tiles: DataFrame, folder: str, base: str = "band") -> list[str]:
    """A file for each row of (time, width, x0, dx, y0, dy, data), named by its date; returns the names."""
    ship(tiles.sparkSession)
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            names = []
            for r in pdf.itertuples():
                path = os.path.join(folder, f"{base}_{r.time:%Y-%m-%d}.tif")
                with open(path + ".part", "wb") as f:
                    f.write(encode(np.asarray(r.data, float).reshape(-1, r.width), r.x0, r.dx, r.y0, r.dy))
                os.replace(path + ".part", path)  # a task that runs again writes the same file
                names.append(path)
            yield pd.DataFrame({"path": names})

    return sorted(r.path for r in tiles.select("time", "width", "x0", "dx", "y0", "dy", "data").mapInPandas(run, "path string").collect())


def write_cube(
    df: DataFrame,
    folder: str,
    bands: Sequence[str],
    time: datetime.date | int,
    step: tuple[float, float] = (1.0, 1.0),
    more: Mapping[str, Column] | None = None,
    by_band: bool = False,
    base: str = "cube",
    side: int = 512,
) -> list[str]:
    """The bands of one date of a cube (time, y, x, bands), named by its label or counted by its place in the order of dates (from 0; from
    the end if negative), and ``more`` bands computed from its columns. Returns the names of the files.

    A file holds a block of at most ``side`` x ``side`` places of step (dy, dx), so no task gathers a scene; its rows run from the largest y
    down. All bands stand in one file, in the order given, or ``by_band`` each in its own. Places or values that are missing are NaN.
    """
    ship(df.sparkSession)
    os.makedirs(folder, exist_ok=True)
    df = by_position(df, "time", [time]) if isinstance(time, int) else df.where(F.col("time") == F.lit(time))
    dy, dx = step
    columns = [F.col(b).cast("float").alias(b) for b in bands] + [c.cast("float").alias(n) for n, c in (more or {}).items()]
    names = [*bands, *(more or {})]
    place = lambda c, d: F.round(F.col(c) / d).cast("long")
    cells = df.select("time", place("y", dy).alias("cc_i"), place("x", dx).alias("cc_j"), *columns)
    cells = cells.select("*", F.floor(F.col("cc_i") / side).alias("cc_r"), F.floor(F.col("cc_j") / side).alias("cc_c"))

    def run(key, pdf):
        import pandas as pd

        day, r, c = key
        i, j = pdf["cc_i"].to_numpy(), pdf["cc_j"].to_numpy()
        top, left = i.max(), j.min()
        t = np.full((len(names), top - i.min() + 1, j.max() - left + 1), np.nan, "f4")
        t[:, top - i, j - left] = pdf[names].to_numpy("f4").T
        paths = []
        for name, part in [(f"_{n}", t[k]) for k, n in enumerate(names)] if by_band else [("", t)]:
            path = os.path.join(folder, f"{base}{name}_{day:%Y-%m-%d}_{r}_{c}.tif")
            with open(path + ".part", "wb") as f:
                f.write(encode(part, left * dx, dx, top * dy, dy))
            os.replace(path + ".part", path)  # a task that runs again writes the same file
            paths.append(path)
        return pd.DataFrame({"path": paths})

    return sorted(r.path for r in cells.groupBy("time", "cc_r", "cc_c").applyInPandas(run, "path string").collect())
