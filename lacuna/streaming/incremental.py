"""Incremental coverage: counts of places per tract and window over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import planar


def windowed_gap(pois: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, kind, mapped, ref, gap) of each event-time window; rows later than ``late`` are left out.

    ``pois``: a stream or table of ts, kind, in_mapped, in_ref. State is one row per open window and kind.
    """
    seen = pois.withWatermark("ts", late) if pois.isStreaming else pois
    counts = seen.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count_if("in_mapped").alias("mapped"), F.count_if("in_ref").alias("ref"))
    return counts.select(F.col("w.start").alias("start"), "kind", "mapped", "ref", planar.ratio_gap(F.col("mapped"), F.col("ref")).alias("gap"))
