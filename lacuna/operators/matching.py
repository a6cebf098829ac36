"""Roads against roads: how far a reference road lies from the mapped ones along its whole length, and which roads are the same.

Segments are straight: (ax, ay) by (dx, dy). All candidates come of grid joins within a reach, so a road is compared with
its neighbours only, and minima and maxima are aggregated per task before anything is shuffled by road.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar
from ..sources.layers import written
from .gaps import SEGMENT
from .spatial_join import grid_join

#: A reference road is looked at in so many places first, and in so many within a stretch that may matter.
STEPS = (8, 8)


def apart(px: Column, py: Column, ax: Column, ay: Column, dx: Column, dy: Column) -> Column:
    """The distance of a point from a segment."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return planar.length(px - ax - t * dx, py - ay - t * dy)


def _distances(points: DataFrame, roads: DataFrame, reach: float) -> DataFrame:
    """(ref_id, k, d) of points (ref_id, k, px, py): the distance to the nearest road, or ``reach`` if none is nearer."""
    # a place has one cell, and a road all that its box meets when widened by the reach: nothing is shuffled but both sides once
    cell = 4 * reach
    ax, ay, dx, dy = (F.col(c) for c in SEGMENT)
    at = lambda low, high: F.explode(F.sequence(planar.cell(low - reach, cell), planar.cell(high + reach, cell)))
    spread = roads.select(*SEGMENT, at(F.least(ax, ax + dx), F.greatest(ax, ax + dx)).alias("ci"))
    spread = spread.select("ci", *SEGMENT, at(F.least(ay, ay + dy), F.greatest(ay, ay + dy)).alias("cj"))
    placed = points.select("ref_id", "k", "px", "py", planar.cell(F.col("px"), cell).alias("ci"), planar.cell(F.col("py"), cell).alias("cj"))
    near = placed.join(spread, ["ci", "cj"], "left").groupBy("ci", "cj", "ref_id", "k").agg(F.min(apart(*(F.col(c) for c in ("px", "py", *SEGMENT)))).alias("d"))
    return near.select("ref_id", "k", F.least(F.coalesce("d", F.lit(float(reach))), F.lit(float(reach))).alias("d"))


def _at(refs: DataFrame, k: Column, parts: int, *more: str) -> DataFrame:
    t = F.col("k") / F.lit(float(parts))
    return refs.withColumn("k", k).select("ref_id", "k", *more, (F.col("ax") + F.col("dx") * t).alias("px"), (F.col("ay") + F.col("dy") * t).alias("py"))


def coverage_distance(refs: DataFrame, roads: DataFrame, reach: float, steps: tuple[int, int] = STEPS) -> DataFrame:
    """(ref_id, distance): the directed Hausdorff distance of each reference road (ref_id, ax, ay, dx, dy) from the union of the roads,
    ``reach`` where some place has no road within it.

    The distance to the nearest road is the lower envelope of the distances to each; its greatest value is looked for in two rounds. The
    envelope changes by no more than one moves, so over a stretch it can't pass the mean of its values at both ends and the stretch's
    length; only stretches that may pass the greatest value so far are looked at closely. The result is that of all steps[0] * steps[1]
    + 1 places, and half the distance of two of them from the exact value at most.
    """
    first, second = steps
    all_places = first * second
    refs = refs.select("ref_id", *SEGMENT)
    coarse = _distances(_at(refs, F.explode(F.sequence(F.lit(0), F.lit(all_places), F.lit(second))), all_places), roads, reach)
    # first + 1 places of each road
    seen = coarse.groupBy("ref_id").agg(F.max("d").alias("best"), F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda p: p["d"]).alias("at"))
    seen = written(refs.join(seen, "ref_id"), "coverage")
    stretch = planar.length(F.col("dx"), F.col("dy")) / first
    one = seen.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(first - 1)))).withColumn("most", (F.get("at", "i") + F.get("at", F.col("i") + 1) + stretch) / 2)
    fine = _at(one.where((F.col("most") > F.col("best")) & (F.col("best") < reach)), F.explode(F.sequence(F.col("i") * second + 1, F.col("i") * second + second - 1)), all_places)
    inner = _distances(fine, roads, reach).groupBy("ref_id").agg(F.max("d").alias("inner"))
    return seen.select("ref_id", "best").join(inner, "ref_id", "left").select("ref_id", F.greatest("best", F.coalesce("inner", "best")).alias("distance"))


def matched_pairs(refs: DataFrame, roads: DataFrame, reach: float, bearing: float) -> DataFrame:
    """Pairs (r_*, m_*) of a reference road and a mapped one that are each other's nearest, by their middles, among those within ``reach``
    whose bearings differ by no more than ``bearing`` degrees, whichever way they are drawn. Both sides have the columns ax, ay, dx,
    dy and class; rows that are alike stand for one road. Ties go to the lesser (ax, ay, dx, dy, class), so the pairs are well defined.
    """
    import math

    names = (*SEGMENT, "class")

    def side(df: DataFrame, lead: str) -> DataFrame:
        own = df.select(*(F.col(c).alias(f"{lead}_{c}") for c in names)).distinct()
        return own.withColumns({f"{lead}_x": F.col(f"{lead}_ax") + F.col(f"{lead}_dx") / 2, f"{lead}_y": F.col(f"{lead}_ay") + F.col(f"{lead}_dy") / 2})

    r, m = side(refs, "r"), side(roads, "m")
    r = r.withColumns({"b0": F.col("r_x") - reach, "b1": F.col("r_x") + reach, "c0": F.col("r_y") - reach, "c1": F.col("r_y") + reach})
    c = F.col
    square = (c("r_x") - c("m_x")) * (c("r_x") - c("m_x")) + (c("r_y") - c("m_y")) * (c("r_y") - c("m_y"))
    cross, dot = c("r_dx") * c("m_dy") - c("r_dy") * c("m_dx"), c("r_dx") * c("m_dx") + c("r_dy") * c("m_dy")
    alike = (F.abs(cross) <= F.abs(dot) * math.tan(math.radians(bearing))) & ((c("r_dx") != 0) | (c("r_dy") != 0)) & ((c("m_dx") != 0) | (c("m_dy") != 0))
    pairs = grid_join(m, r, ("m_x", "m_x", "m_y", "m_y"), ("b0", "b1", "c0", "c1"), 2 * reach).withColumn("square", square).where((c("square") <= float(reach) * reach) & alike)
    of = lambda lead: F.struct(*(f"{lead}_{n}" for n in names))
    ids = pairs.select("square", of("r").alias("r"), of("m").alias("m"))
    best = lambda own, other: ids.groupBy(own).agg(F.min(F.struct("square", other)).alias("n")).select(F.col(own), F.col(f"n.{other}").alias(other))
    both = best("r", "m").join(best("m", "r"), ["r", "m"])
    return both.select(*(F.col(f"{lead}.{lead}_{n}").alias(f"{lead}_{n}") for lead in ("r", "m") for n in names))
