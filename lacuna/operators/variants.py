"""Variant sweeps: the same measure under other precisions, projections and datums, as one tagged table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, planar
from . import gaps
from .spatial_join import grid_join

#: Micro-degrees to degrees, with an origin in the conterminous US.
ORIGIN = (-100.0, 30.0)


@dataclass(frozen=True)
class Variant:
    """How roads and tracts are treated before clipping. Lengths in map units."""

    name: str
    snap_roads: float | None = None
    snap_tracts: float | None = None
    longest: float | None = None
    round_lengths: int | None = None


SWEEP = (
    Variant("base"),
    Variant("snap_10", snap_roads=10, snap_tracts=10),
    Variant("snap_1000", snap_roads=1000, snap_tracts=1000),
    Variant("roads_500", snap_roads=500),
    Variant("densify_5000", longest=5000),
    Variant("len_int", round_lengths=0),
    Variant("len_2dp", round_lengths=2),
)


def segmentize(roads: DataFrame, longest: float | Column) -> DataFrame:
    """Segments cut into equal parts no longer than ``longest`` (whole where it is NULL), with their number ``part``."""
    return planar.segmentized(roads, longest)


def snap_roads(roads: DataFrame, grid: float | Column) -> DataFrame:
    """Both ends on the grid (as they are where it is NULL); segments that vanish are dropped."""
    s = lambda c: planar.snap(c, grid)
    bx, by = s(F.col("ax") + F.col("dx")), s(F.col("ay") + F.col("dy"))
    ax, ay = s(F.col("ax")), s(F.col("ay"))
    return roads.withColumns({"ax": ax, "ay": ay, "dx": bx - ax, "dy": by - ay}).where("dx <> 0 OR dy <> 0")


def snap_tracts(tracts: DataFrame, grid: float | Column) -> DataFrame:
    return tracts.withColumns({c: planar.snap(F.col(c), grid) for c in ("x0", "x1", "y0", "y1")})


def transport(tracts: DataFrame, roads: DataFrame, v: Variant, classes: tuple[str, ...] = ("primary",)) -> DataFrame:
    r = roads.where(F.col("class").isin(*classes))
    if v.longest:
        r = segmentize(r, v.longest)
    if v.snap_roads:
        r = snap_roads(r, v.snap_roads)
    t = snap_tracts(tracts, v.snap_tracts) if v.snap_tracts else tracts
    lengths = gaps.road_lengths(t, r)
    digits = 3 if v.round_lengths is None else v.round_lengths
    lengths = lengths.select("tid", *(F.round(c, digits).alias(c) for c in ("ov_len", "tiger_len")))
    return gaps.with_gap(tracts, lengths, "ov_len", "tiger_len", "transport_gap").select("tid", "region", "ov_len", "tiger_len", "transport_gap")


def sweep(tracts: DataFrame, roads: DataFrame, variants: tuple[Variant, ...] = SWEEP, classes: tuple[str, ...] = ("primary",)) -> DataFrame:
    """All variants in one plan, tagged by name: one scan of each layer makes a row for each geometry (variants that only round
    lengths share one), one join on (geometry, cell) clips them all, and lengths are then rounded for each variant."""
    shape = lambda v: (v.snap_roads, v.snap_tracts, v.longest)
    shapes = list(dict.fromkeys(map(shape, variants)))
    kind = "struct<geom:int,snap_roads:double,snap_tracts:double,longest:double>"
    each = F.explode(F.array(*(F.struct(F.lit(k), *(F.lit(x).cast("double") for x in s)).cast(kind) for k, s in enumerate(shapes))))
    spread_ = lambda df: df.withColumn("_g", each).select("*", "_g.*").drop("_g")
    r = spread_(roads.where(F.col("class").isin(*classes)).select("ax", "ay", "dx", "dy", "mapped"))
    r = snap_roads(segmentize(r, F.col("longest")), F.col("snap_roads")).select("geom", "ax", "ay", "dx", "dy", "mapped")
    t = snap_tracts(spread_(tracts.select("tid", "x0", "x1", "y0", "y1")), F.col("snap_tracts")).select("geom", "tid", "x0", "x1", "y0", "y1")
    lengths = gaps.road_lengths(t, r, by=("geom",), shared=True)
    named = lambda v: F.struct(F.lit(v.name).alias("variant"), F.lit(shapes.index(shape(v))).alias("geom"), F.lit(3 if v.round_lengths is None else v.round_lengths).alias("digits"))
    every = tracts.select("tid", "region").withColumn("_v", F.explode(F.array(*map(named, variants)))).select("tid", "region", "_v.*").join(lengths, ["geom", "tid"], "left")
    rounded = lambda c: F.coalesce(F.coalesce(*(F.when(F.col("digits") == n, F.round(c, n)) for n in sorted({3 if v.round_lengths is None else v.round_lengths for v in variants}))), F.lit(0.0))
    every = every.withColumns({c: rounded(c) for c in ("ov_len", "tiger_len")})
    every = every.withColumn("transport_gap", planar.ratio_gap(F.col("ov_len"), F.col("tiger_len")))
    return every.select("tid", "region", "ov_len", "tiger_len", "transport_gap", "variant")


def isolated(tracts: DataFrame, roads: DataFrame, variants: tuple[Variant, ...], write: Callable[[DataFrame, str], None]) -> dict[str, str]:
    """Runs each variant's action by itself: a failing one is reported and doesn't stop the others."""
    told = {}
    for v in variants:
        try:
            write(transport(tracts, roads, v), v.name)
            told[v.name] = "done"
        except Exception as e:
            told[v.name] = f"failed: {type(e).__name__}: {e}"[:300]
    return told


def totals(swept: DataFrame) -> DataFrame:
    """(variant, n_defined, total, diff): each variant's sum of gaps and how far it is from the base's."""
    # sums of whole millionths are the same in any order
    micro = F.round(F.col("transport_gap") * 1e6).cast("long")
    sums = swept.groupBy("variant").agg(F.count("transport_gap").alias("n_defined"), F.coalesce(F.sum(micro), F.lit(0)).alias("total"))
    base = sums.where("variant = 'base'").select(F.col("total").alias("base_total"))
    return sums.join(F.broadcast(base)).select("variant", "n_defined", (F.col("total") / 1e6).alias("total"), ((F.col("total") - F.col("base_total")) / 1e6).alias("diff"))


def spread(swept: DataFrame, n: int = 10) -> DataFrame:
    """The tracts whose gap differs most between variants."""
    gap = F.round("transport_gap", 6)
    out = swept.groupBy("tid").agg(F.round(F.max(gap) - F.min(gap), 6).alias("spread"), F.count("transport_gap").alias("n_defined"))
    return out.where("spread IS NOT NULL").orderBy(F.desc("spread"), "tid").limit(n)


def pivot(swept: DataFrame, names: tuple[str, ...] = tuple(v.name for v in SWEEP)) -> DataFrame:
    """One column of gaps per variant; the names are given, so no job looks for them."""
    return swept.groupBy("tid").pivot("variant", list(names)).agg(F.first(F.round("transport_gap", 6)))


def hits(swept: DataFrame, known: dict[int, float], within: float = 0.002) -> DataFrame:
    """Variants whose gap comes near known values, nearest first."""
    cases = F.coalesce(*(F.when(F.col("tid") == k, F.lit(v)) for k, v in known.items()))
    out = swept.withColumn("known", cases).where("known IS NOT NULL").withColumn("diff", F.col("transport_gap") - F.col("known"))
    return out.where(F.abs("diff") < within).orderBy(F.abs("diff"), "variant", "tid")


# ---- projected lengths


def degrees(roads: DataFrame) -> DataFrame:
    """Ends in degrees of longitude and latitude."""
    lon = lambda x: F.lit(ORIGIN[0]) + x / 1e6
    lat = lambda y: F.lit(ORIGIN[1]) + y / 1e6
    return roads.withColumns({"lon1": lon(F.col("ax")), "lat1": lat(F.col("ay")), "lon2": lon(F.col("ax") + F.col("dx")), "lat2": lat(F.col("ay") + F.col("dy"))})


def projected(roads: DataFrame, projection: Callable[[str, str], tuple[str, str]], lead: str = "p") -> DataFrame:
    """Adds both ends in map metres: projected once per vertex, before any join."""
    out = roads
    for k in (1, 2):
        x, y = projection(f"lon{k}", f"lat{k}")
        out = out.withColumns({f"{lead}x{k}": F.expr(x), f"{lead}y{k}": F.expr(y)})
    return out


def clipped_then_projected(tracts: DataFrame, roads: DataFrame, projection: Callable[[str, str], tuple[str, str]], cell: float = gaps.CELL) -> DataFrame:
    """(tid, ov_len, tiger_len) in map metres with the clip in degrees, before projecting: the ends of the clipped part are projected."""
    box = ("x0", "x1", "y0", "y1")
    pairs = grid_join(gaps.road_boxes(roads), tracts.select("tid", *box), gaps.ROAD_BOX, box, cell, segment=gaps.SEGMENT)
    enter, leave = planar.clip_interval(*(F.col(c) for c in ("ax", "ay", "dx", "dy", *box)))
    pairs = pairs.withColumns({"t0": enter, "t1": leave}).where("t1 > t0")
    part = {"ax": F.col("ax") + F.col("t0") * F.col("dx"), "ay": F.col("ay") + F.col("t0") * F.col("dy")}
    pairs = pairs.withColumns({**part, "dx": (F.col("t1") - F.col("t0")) * F.col("dx"), "dy": (F.col("t1") - F.col("t0")) * F.col("dy")})
    p = projected(degrees(pairs), projection).withColumn("len", planar.length(F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")))
    return p.groupBy("tid").agg(F.sum(F.when(F.col("mapped"), F.col("len")).otherwise(0.0)).alias("ov_len"), F.sum(F.when(~F.col("mapped"), F.col("len")).otherwise(0.0)).alias("tiger_len"))


def geodesic(df: DataFrame, columns: tuple[str, str, str, str] = ("lon1", "lat1", "lon2", "lat2")) -> DataFrame:
    """Adds the ellipsoidal distance ``metres``."""
    for name, expression in crs.geodesic(columns):
        df = df.withColumn(name, F.expr(expression))
    return df.drop(*(n for n, _ in crs.geodesic(columns) if n != "metres"))
