"""Tables that are computed once: written layers that later queries read in place of their plan.

A kept layer's folder is named by what it was made of: the source files with their lengths and times, the parameters (a
filter, a list of settings) and a version of the code that makes it. Changed files or parameters make another layer; the
old one stays until someone clears it. A layer is written beside its place and moved there when it is whole, so a
reader never sees half of one, and of two writers one wins.

Everything lies in ``spark.checkpoint.dir``, the folder that driver and executors share, or in a folder given by the caller.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="lacuna-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class _Files:
    """A few calls of the file system that the session's paths are on."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext

    def at(self, path: str):
        where = self.sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.sc._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self.at(path)
        return fs.exists(where)

    def stamp(self, path: str) -> tuple[str, int, int]:
        fs, where = self.at(path)
        status = fs.getFileStatus(where)
        return path, status.getLen(), status.getModificationTime()

    def delete(self, path: str) -> None:
        fs, where = self.at(path)
        fs.delete(where, True)

    def move(self, source: str, target: str) -> bool:
        fs, where = self.at(source)
        return fs.rename(where, self.at(target)[1])


def key_of(spark: SparkSession, sources: Iterable[DataFrame], version: int, parameters: dict) -> str:
    """What a layer is made of, as a name: its source files, parameters and version."""
    files = _Files(spark)
    stamps = sorted({files.stamp(f) for df in sources for f in df.inputFiles()})
    return hashlib.sha256(json.dumps([stamps, version, parameters], sort_keys=True, default=str).encode()).hexdigest()[:24]


def kept(name: str, sources: list[DataFrame], build: Callable[[], DataFrame], version: int = 1, root: str | None = None, partition_by: tuple[str, ...] = (), **parameters) -> DataFrame:
    """The layer of this name over these sources, built and written if there is none yet."""
    spark = sources[0].sparkSession
    files = _Files(spark)
    path = f"{root or shared_dir(spark) + '/layers'}/{name}-{key_of(spark, sources, version, parameters)}"
    if not files.exists(f"{path}/_SUCCESS"):
        fresh = f"{path}.{uuid.uuid4().hex}"
        build().write.partitionBy(*partition_by).option("compression", "zstd").parquet(fresh)
        if files.exists(path) or not files.move(fresh, path):
            files.delete(fresh)  # another writer was first
    return spark.read.parquet(path)


_passing: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    while _passing:
        spark, path = _passing.pop()
        if spark.sparkContext._jsc is not None:
            try:
                _Files(spark).delete(path)
            except Exception:  # the JVM is gone: the folder is the cluster's to clear
                return


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame's rows as a table that goes at the end of the process: for frames that are read several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _passing.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
