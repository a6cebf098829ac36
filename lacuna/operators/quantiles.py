"""Exact quantiles without a task that holds all values.

An aggregate like ``percentile`` keeps a map of all distinct values of a group in one task. Here the values that can hold a
quantile's rank are narrowed down: a range is cut into ``BINS`` equal parts, one aggregation counts them (per task first, so
that BINS rows a range leave a task) and notes the least and greatest value in each, and the part with the rank is the next range.
A round divides a range by BINS at least, and shrinks it to values that occur. It ends when a range holds ``FEW`` values or a
single one; what it holds then is sorted as one array. Quantiles are interpolated between neighbours, as ``percentile`` does.

The values are written once and each round reads them; groups are rows of a table, so there may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layers import written

BINS, FEW = 1024, 20_000


def _part(low: str = "low", high: str = "high") -> Column:
    """The number of a value's part of its range."""
    at = F.floor((F.col("v") - F.col(low)) / (F.col(high) - F.col(low)) * BINS)
    return F.when(F.col(high) > F.col(low), F.least(F.lit(BINS - 1), F.greatest(F.lit(0), at.cast("int")))).otherwise(0)


def _within(values: DataFrame, ranges: DataFrame, grouped: bool) -> DataFrame:
    """Values beside each range of their group that holds them."""
    # without groups there is one row for each rank
    own = values.join(ranges, "g") if grouped else values.join(F.broadcast(ranges.drop("g")))
    return own.where("v >= low AND v <= high")


def exact_quantiles(df: DataFrame, value: str | Column, shares: Sequence[float], by: str | None = None, few: int = FEW, held: bool = False) -> DataFrame:
    """(by, n, q0, q1, ...): of each group the number of values that aren't NULL and, for each share, the interpolated quantile;
    NULL quantiles of a group without values. Without ``by`` one row. ``held``: the frame is a written table already. NaN isn't expected."""
    v = F.col(value) if isinstance(value, str) else value
    values = df.select((F.col(by) if by else F.lit(0)).alias("g"), v.cast("double").alias("v"))
    values = values if held else written(values, "quantiles")
    # NULL is a group of its own; joins need a key that isn't NULL
    values = values.select(F.struct(F.col("g").isNull().alias("none"), F.coalesce("g", F.lit(0).cast(values.schema["g"].dataType)).alias("key")).alias("g"), "v")
    sums = values.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    sums = written(sums, "quantile-groups")
    at = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    ranks = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(at(s)) if up else F.floor(at(s))).alias("rank")) for k, s in enumerate(shares) for up in (False, True))))
    ranges = sums.where("n > 0").select("g", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("held"), ranks.alias("r")).select("g", "low", "high", "before", "held", "r.*")
    while (ranges.where("high > low").agg(F.max("held")).first()[0] or 0) > few:
        own = _within(values, ranges.where("high > low"), by is not None)
        own = own if by else own.withColumn("g", F.lit(None).cast(ranges.schema["g"].dataType))
        parts = own.groupBy("g", "k", "up", "rank", "before", _part().alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        # a range's parts are BINS rows at most
        sorted_parts = F.sort_array(F.collect_list(F.struct("part", "c", "low", "high")))
        step = lambda s, p: F.when(s["low"].isNotNull() | (s["before"] + p["c"] <= F.col("rank")), F.struct(F.when(s["low"].isNotNull(), s["before"]).otherwise(s["before"] + p["c"]).alias("before"), s["held"].alias("held"), s["low"].alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["before"].alias("before"), p["c"].alias("held"), p["low"].alias("low"), p["high"].alias("high")))  # noqa: E731, E501
        start = F.struct(F.col("before").alias("before"), F.lit(0).cast("long").alias("held"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        next_ = parts.groupBy("g", "k", "up", "rank", "before").agg(sorted_parts.alias("parts")).select("g", "k", "up", "rank", F.aggregate("parts", start, step).alias("s"))
        next_ = next_.select("g", "k", "up", "rank", "s.before", "s.held", "s.low", "s.high")
        if not by:
            next_ = next_.withColumn("g", F.struct(F.lit(False).alias("none"), F.lit(0).alias("key")))
        ranges = written(next_.unionByName(ranges.where("high = low").select(next_.columns)), "quantile-ranges")
    found = ranges.where("high = low").select("g", "k", "up", F.col("low").alias("at"))
    open_ = _within(values, ranges.where("high > low"), by is not None)
    open_ = open_ if by else open_.withColumn("g", F.struct(F.lit(False).alias("none"), F.lit(0).alias("key")))
    picked = F.element_at(F.sort_array(F.collect_list("v")), (F.col("rank") - F.col("before") + 1).cast("int"))
    found = found.unionByName(open_.groupBy("g", "k", "up", "rank", "before").agg(picked.alias("at")).select("g", "k", "up", "at"))
    wide = found.groupBy("g").agg(*(F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("at"))).alias(f"{'u' if up else 'd'}{k}") for k in range(len(shares)) for up in (False, True)))
    out = sums.join(wide, "g", "left") if by else sums.join(F.broadcast(wide.drop("g")), how="left")  # one row each
    share = lambda s: at(s) - F.floor(at(s))
    quantiles = [(F.col(f"d{k}") + (F.col(f"u{k}") - F.col(f"d{k}")) * share(s)).alias(f"q{k}") for k, s in enumerate(shares)]
    key = [F.when(~F.col("g.none"), F.col("g.key")).alias(by)] if by else []
    if by:
        return out.select(*key, "n", *quantiles)
    # a table without rows has no group: one row all the same
    return out.select("n", *quantiles).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(F.max(f"q{k}").alias(f"q{k}") for k in range(len(shares))))
