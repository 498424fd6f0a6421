"""Archives of scenes (zip, tar, tar.gz) as rows of their members, so that what is there already is skipped by an anti join."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.session import ship

SCHEMA = "archive string, member string, size long, content binary, error string"


def members_of(name: str, blob: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, content) of the files in an archive."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(blob)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read()


def members(spark: SparkSession, folder: str, done: DataFrame | None = None) -> DataFrame:
    """Members of all archives in a folder but those named in ``done`` (column ``archive``). A broken archive is one row with its error."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("archive", F.element_at(F.split("path", "/"), -1))
    found = found.where(F.col("archive").rlike(r"\.(zip|tar|tar\.gz|tgz)$"))
    if done is not None:
        found = found.join(done.select("archive").distinct(), "archive", "left_anti")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, blob in zip(pdf["archive"], pdf["content"], strict=True):
                rows = []
                try:
                    rows.extend((name, m, len(c), c, None) for m, c in members_of(name, blob))
                except (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, NotImplementedError) as e:  # damaged, encrypted, or packed in an unknown way
                    rows = [(name, None, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "content", "error"])

    return found.select("archive", "content").mapInPandas(run, SCHEMA)
