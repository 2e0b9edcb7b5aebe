"""Outputs as parquet or CSV folders, and folders that appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExtractError

#: The file that a finished folder holds: what was written, and the counts of the run.
MANIFEST = "_MANIFEST.json"


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> str:
    """Write a frame to a new folder; the source of a run is never the target."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown output format {fmt!r}; use 'parquet' or 'csv'")
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


class Delivery:
    """Folders written beside their final places and moved there together at the end.

    Everything goes to ``<path>.part-<id>``, on the same file system as ``path``. ``commit``
    writes the manifest and renames; left by an exception, the working folder is removed and
    nothing has appeared. Where a rename is not one step (object stores), the manifest, which
    moves last, tells a finished folder from one that is still arriving.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        self.work = f"{self.path}.part-{uuid.uuid4().hex}"
        self._outputs = f"{self.work}/outputs"
        self._names: list[str] = []

    def __enter__(self) -> "Delivery":
        self._refuse_existing(self.path)
        return self

    def __exit__(self, *failure) -> None:
        self._fs(self.work).delete(self._hadoop(self.work), True)

    def write(self, name: str, df: DataFrame, fmt: str = "parquet") -> None:
        write_table(df, f"{self._outputs}/{name}", fmt)
        self._names.append(name)

    def scratch(self, name: str) -> str:
        """A folder that lives as long as the delivery, or until it is kept."""
        return f"{self.work}/{name}"

    def keep(self, name: str, path: str) -> None:
        """Move a scratch folder to a place of its own."""
        self._move(self.scratch(name), path)

    def commit(self, facts: dict) -> None:
        """Make all outputs appear at once."""
        text = json.dumps({"outputs": self._names, **facts}, indent=1, sort_keys=True)
        with_manifest = f"{self._outputs}/{MANIFEST}"
        stream = self._fs(with_manifest).create(self._hadoop(with_manifest), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._move(self._outputs, self.path)

    def _move(self, source: str, target: str) -> None:
        self._refuse_existing(target)
        parent = self._hadoop(target).getParent()
        if parent is not None:
            self._fs(target).mkdirs(parent)
        if not self._fs(source).rename(self._hadoop(source), self._hadoop(target)):
            raise ExtractError(f"{source} could not be moved to {target}")

    def _refuse_existing(self, path: str) -> None:
        # a rename onto a folder would land inside it
        if self._fs(path).exists(self._hadoop(path)):
            raise ExtractError(f"{path} exists already; outputs go to a new folder")

    def _hadoop(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop(path).getFileSystem(self._spark._jsc.hadoopConfiguration())
