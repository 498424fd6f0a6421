"""Folders, tables and fixed-size bitmaps that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one block of Spark's bitmap aggregates.
BLOCK_BITS = 32768


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset in a local session (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        found = getattr(spark, "_cropcube_dir", None)
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="cropcube-")
        spark._cropcube_dir = found
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cuts lineage and survives lost executors; ``drop`` removes one, the rest go with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cropcube/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:  # results may still read the tables, so they stay until the application ends
            root, files = self.files(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cropcube_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, files = self.files(t._cropcube_path)
            files.delete(path, True)

    def files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_of(df: DataFrame) -> int:
    """Ranges of keys that ``df`` is dealt into: two for each shuffle partition, and one for each input partition at least.

    An input partition has a bounded size, so a range has one too, however many rows there are.
    """
    return max(2 * partitions(df.sparkSession), df._jdf.queryExecution().toRdd().getNumPartitions())


class Sparse:
    """An array that travels compressed and is unpacked once in each process: tables here are mostly zeros."""

    def __init__(self, array: np.ndarray):
        self.size = array.nbytes
        self.packed = bytes(pa.compress(np.ascontiguousarray(array), "zstd", asbytes=True))
        self.array = None

    def __getstate__(self):
        return {"size": self.size, "packed": self.packed, "array": None}

    def get(self) -> np.ndarray:
        if self.array is None:
            self.array = np.frombuffer(pa.decompress(self.packed, self.size, "zstd", asbytes=True), np.uint8)
        return self.array


class Bitmap(Sparse):
    """A filter over 64-bit values: holds all those it was made of, and passes a few others by chance."""

    def __init__(self, array: np.ndarray, bits: int):
        super().__init__(array)
        self.bits = bits

    def __getstate__(self):
        return super().__getstate__() | {"bits": self.bits}

    def __contains__(self, value: int) -> bool:
        return bool(self.holds(np.array([value % (1 << 64)], np.uint64))[0])

    def holds(self, values: np.ndarray) -> np.ndarray:
        cell = cell_of(values, self.bits)
        return (self.get()[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(df: DataFrame, key: Column, most: int, per_value: int = 32) -> Bitmap:
    """A filter with ``per_value`` bits for each row of ``df``, but never more than ``2**most`` bits in all.

    So its size has a fixed bound, whatever the data. It only thins out rows: those that pass by chance are dropped by the
    join or the pass behind it. ``df`` is read twice, so it should be a written table.
    """
    bits = min(most, max(15, (df.count() * per_value).bit_length()))
    cell = F.shiftrightunsigned(F.xxhash64(key), 64 - bits) + 1  # Spark numbers buckets from 1 for cells from 1
    rows = (
        df.select(cell.alias("c"))
        .groupBy(F.expr("bitmap_bucket_number(c)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("m"))
        .collect()
    )
    out = np.zeros(max(1 << (bits - 3), BLOCK_BITS // 8), np.uint8)
    for r in rows:
        at = (r.b - 1) * (BLOCK_BITS // 8)
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(bytes(r.m), np.uint8)
    return Bitmap(out, bits)


def cell_of(value: np.ndarray, bits: int) -> np.ndarray:
    """The cell that ``bitmap`` gives a 64-bit value: the top bits of Spark's xxhash64 of the long, seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(value.shape, np.uint64(42) + p5 + np.uint64(8), np.uint64)
        h ^= rot(value.astype(np.uint64) * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
