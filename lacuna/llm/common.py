"""Helpers shared by the corpus operators: scratch tables, table readers, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship

#: Words are maximal runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
#: ``bytes.split()`` cuts at exactly these bytes, so Python code works on UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster gets an error, because a
    machine-local folder would not be seen by other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="lacuna-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive a lost executor.

    ``save`` writes and rereads a table, ``drop`` removes one that no later step reads; what is left
    goes at the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = ship(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _kept.append(self)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(f"{self.root}/{tag}")

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Deletes the folder; after the session's end it is the cluster's to clear."""
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)


#: Scratch folders in use; their tables may still be read lazily by a returned DataFrame.
_kept: list[Scratch] = []


@atexit.register
def _cleanup() -> None:
    while _kept:
        scratch = _kept.pop()
        try:
            scratch.close()
        except Exception:  # the JVM is gone: the folder is the cluster's to clear
            return


@contextmanager
def scratch_made(into: list[Scratch]) -> Iterator[None]:
    """Adds to ``into`` the scratch folders that are made within."""
    before = len(_kept)
    try:
        yield
    finally:
        into += _kept[before:]


def release(made: list[Scratch]) -> None:
    """Removes these folders' tables before the process ends: for callers that wrote what they read from them."""
    while made:
        scratch = made.pop()
        scratch.close()
        _kept.remove(scratch)


def numbered(docs: DataFrame, scratch: Scratch, **columns: str) -> DataFrame:
    """The rows of ``docs`` as a struct (_row), a number of each row's own (row) and some of their columns under given names.

    The table is written once, so the numbers hold; a text stands in it once, and scans read only the fields that are named.
    """
    rows = scratch.save(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("row")), "rows")
    return rows.select("_row", "row", *(F.col("_row").getField(c).alias(name) for name, c in columns.items()))


def in_order(df: DataFrame, order: list[str], scratch: Scratch, tag: str) -> DataFrame:
    """Adds ``k``, a row's place from 0 in this order, by a sort by ranges: no task has more than a range.

    How many rows the ranges before hold comes from a table with a row for each range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    saved = scratch.save(ranged, tag).withColumn("_part", F.shiftright("_row", 33))
    parts = saved.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first")).alias("_shift"))
    # a row for each range: a few numbers times the shuffle partitions
    return saved.join(F.broadcast(parts), "_part").withColumn("k", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
