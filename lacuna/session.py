"""Sessions with stated limits, and timed stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(cores: int | str = "*", memory: str | None = None, partitions: int | None = None, spill_dir: str | None = None, shared_dir: str | None = None, **settings: str) -> SparkSession:
    """A local session, or the running one with these settings: threads, driver memory, shuffle partitions, the folder that shuffles and sorts
    spill to and the one that executors share. On a cluster the master comes from spark-submit and these are left out."""
    own = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": partitions,
        "spark.local.dir": spill_dir,
        "spark.checkpoint.dir": shared_dir,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **settings,
    }
    builder = SparkSession.builder.master(f"local[{cores}]")
    for k, v in own.items():
        if v is not None:
            builder = builder.config(k, str(v))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(stages: Iterable[tuple[str, Callable[[], DataFrame]]]) -> Iterator[tuple[str, int, float]]:
    """(stage, rows, seconds) of each frame, which is planned and computed whole, every column, and not kept."""
    for name, make in stages:
        began, rows = time.perf_counter(), Observation()
        make().observe(rows, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        yield name, rows.get["n"], time.perf_counter() - began
