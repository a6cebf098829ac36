"""Road gaps in map metres: vertices are rounded, shifted to another datum, projected and snapped before anything is clipped.

Many settings run as one plan. What a setting does to a layer's vertices is a treatment: a row of numbers (grids, shift,
the cone's constants) that joins the geometry by one scan, so that one generated expression serves all settings.
Settings whose treatments of both layers have equal numbers share a geometry; candidates of all geometries come of one
join on (geometry, cell), and lengths go back to settings per tract.

Steps that are made from the steps before them must stay steps. Catalyst copies a projection's expression into each filter
above it, so a filter on a projected coordinate would write out the whole chain many times over. ``settled`` puts a
generator between the chain and whatever filters or joins come above it: nothing is pushed below a generator's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, planar
from ..sources.layers import written
from . import gaps, variants

#: A cell's width in metres, some two tracts: with narrower cells a tract has more of them, and more is shuffled.
CELL = 5000.0


@dataclass(frozen=True)
class Setting:
    """``degrees``: grid of rounding before projecting, on ``rounded`` (both, roads or tracts); ``shift``: a datum operation; ``snap``:
    grid in metres after projecting; ``longest``: roads are cut into parts of so many metres."""

    name: str
    crs: str = "5070"
    degrees: float | None = None
    rounded: str = "both"
    shift: str | None = None
    snap: float | None = None
    longest: float | None = None

    def treatment(self, layer: str) -> tuple[float | None, ...]:
        """The numbers that say what happens to a layer's vertices, in the order of ``_FIELDS``."""
        degrees = self.degrees if self.rounded in ("both", layer) else None
        return (degrees, *(crs.SHIFTS[self.shift] if self.shift else (None,) * 3), *crs.CONES[self.crs], self.snap, self.longest if layer == "roads" else None)


_FIELDS = ("degrees", "tx", "ty", "tz", "cone_n", "cone_c", "cone_rho", "snap", "longest")
BASE = Setting("base")
TRANSPORT = (
    Setting("r6_both", degrees=1e-6), Setting("r7_both", degrees=1e-7), Setting("seg100", longest=100), Setting("r7_roads", degrees=1e-7, rounded="roads"),
    Setting("r7_tracts", degrees=1e-7, rounded="tracts"), Setting("snap1m", snap=1), Setting("e3857", crs="3857"), Setting("seg1000", longest=1000),
    Setting("r6_roads", degrees=1e-6, rounded="roads"), Setting("r6_tracts", degrees=1e-6, rounded="tracts"), Setting("e6350", crs="6350"), Setting("e102003", crs="102003"),
    Setting("r5_roads", degrees=1e-5, rounded="roads"), Setting("r8_roads", degrees=1e-8, rounded="roads"),
)
DATUM = (BASE, Setting("op3", shift="op3"), Setting("op2", shift="op2"))
PRECISION = (BASE, *(Setting(f"m{x:g}", snap=x) for x in (0.001, 0.005, 0.01, 0.02, 0.05)), Setting("deg1e-07", degrees=1e-7), Setting("deg1e-06", degrees=1e-6))


@dataclass(frozen=True)
class Geometries:
    """Treatments of each layer and the pairs of them that settings use."""

    roads: tuple[tuple, ...]
    tracts: tuple[tuple, ...]
    pairs: tuple[tuple[int, int], ...]
    of_setting: dict[str, int]

    @classmethod
    def of(cls, settings: tuple[Setting, ...]) -> Geometries:
        roads, tracts = (tuple(dict.fromkeys(s.treatment(layer) for s in settings)) for layer in ("roads", "tracts"))
        pair = lambda s: (roads.index(s.treatment("roads")), tracts.index(s.treatment("tracts")))
        pairs = tuple(dict.fromkeys(map(pair, settings)))
        return cls(roads, tracts, pairs, {s.name: pairs.index(pair(s)) for s in settings})

    def users(self, side: int, k: int) -> list[int]:
        """The geometries that use treatment ``k`` of a side (0: roads, 1: tracts)."""
        return [g for g, pair in enumerate(self.pairs) if pair[side] == k]


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; filters on these columns stay above this step, so their expressions are computed once and never copied."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_one")).select(*rest, "_one.*")


def _treated(df: DataFrame, treatments: tuple[tuple, ...], users: list[list[int]]) -> DataFrame:
    """A row for each treatment, with its numbers and the geometries that use it."""
    one = lambda k, t: F.struct(*(F.lit(v).cast("double").alias(n) for n, v in zip(_FIELDS, t, strict=True)), F.array(*map(F.lit, users[k])).alias("_geoms"))
    return df.select("*", F.explode(F.array(*(one(k, t) for k, t in enumerate(treatments)))).alias("_t")).select(*df.columns, "_t.*")


def _steps(treatments: tuple[tuple, ...], lon: str, lat: str) -> list[tuple[str, str]]:
    """From ``lon`` and ``lat`` to ``p_x`` and ``p_y``; steps that no treatment needs are left out."""
    used = {n for t in treatments for n, v in zip(_FIELDS, t, strict=True) if v is not None}
    on = lambda c, grid: (c, f"CASE WHEN {grid} IS NULL THEN {c} ELSE rint({c} / {grid}) * {grid} END")
    out = [on(lon, "degrees"), on(lat, "degrees")] if "degrees" in used else []
    out += crs.shift_steps(lon, lat, "tx", "ty", "tz") if "tx" in used else []
    out += crs.conic_steps(lon, lat, "cone_n", "cone_c", "cone_rho")
    return out + ([on("p_x", "snap"), on("p_y", "snap")] if "snap" in used else [])


def roads_in_metres(roads: DataFrame, geometries: Geometries) -> DataFrame:
    """(geom, ax, ay, dx, dy, mapped, longest) of roads in degrees (lon1, lat1, lon2, lat2); those that vanish are dropped. Roads stay whole:
    into parts no longer than ``longest`` they are cut beside a tract, so that parts aren't shuffled."""
    out = _treated(roads.select("mapped", "lon1", "lat1", "lon2", "lat2"), geometries.roads, [geometries.users(0, k) for k in range(len(geometries.roads))])
    for k in (1, 2):
        for name, step in _steps(geometries.roads, f"lon{k}", f"lat{k}"):
            out = out.withColumn(name, F.expr(step))
        out = out.withColumnsRenamed({"p_x": f"x{k}", "p_y": f"y{k}"})
    ends = out.select("mapped", "longest", "_geoms", F.col("x1").alias("ax"), F.col("y1").alias("ay"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    ends = settled(ends, "ax", "ay", "dx", "dy").where("dx <> 0 OR dy <> 0")
    return ends.select("mapped", "ax", "ay", "dx", "dy", "longest", F.explode("_geoms").alias("geom"))


def tracts_in_metres(tracts: DataFrame, geometries: Geometries) -> DataFrame:
    """(geom, tid, edges, box) of tracts with rings in degrees; every vertex is mapped, none is added, and what snapping makes equal or
    folds back is taken out."""
    # a file of tracts is small and may be one task's, but their vertices are work
    tasks = int(tracts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _treated(tracts.select("tid", "rings").repartition(tasks, "tid"), geometries.tracts, [geometries.users(1, k) for k in range(len(geometries.tracts))])
    steps = _steps(geometries.tracts, "x", "y")
    out = out.withColumn("rings", planar.map_vertices("rings", steps, ("p_x", "p_y")))
    if any(t[_FIELDS.index(n)] is not None for t in geometries.tracts for n in ("degrees", "snap")):
        out = out.withColumn("rings", planar.repaired(F.col("rings")))
    out = gaps.with_edges(settled(out.select("tid", "_geoms", "rings"), "rings"))
    return out.select("tid", "edges", "x0", "x1", "y0", "y1", F.explode("_geoms").alias("geom"))


#: Parts of a degree in the tables' unit here: a prime, so that vertices lie on no decimal grid and rounding them does something.
PARTS = 999_983.0


def _degrees(c: Column, axis: int) -> Column:
    return F.lit(variants.ORIGIN[axis]) + c / PARTS


def degree_rings(tracts: DataFrame) -> DataFrame:
    """Square tracts with their rings in degrees."""
    x0, x1, y0, y1 = (_degrees(F.col(c), "xy".index(c[0])) for c in ("x0", "x1", "y0", "y1"))
    return tracts.withColumn("rings", planar.rectangle(x0, x1, y0, y1))


def degree_ends(roads: DataFrame) -> DataFrame:
    """Roads with both ends in degrees."""
    ends = {f"{name}{k}": _degrees(F.col(a) + F.col(d) * (k - 1), axis) for k in (1, 2) for axis, (name, a, d) in enumerate((("lon", "ax", "dx"), ("lat", "ay", "dy")))}
    return roads.withColumns(ends)


def transport(tracts: DataFrame, roads: DataFrame, settings: tuple[Setting, ...] = (BASE,), classes: tuple[str, ...] = ("primary",), digits: int = 3) -> DataFrame:
    """(variant, tid, region, ov_len, tiger_len, transport_gap) for each tract (with rings in degrees) and setting; roads have both ends in
    degrees. ``digits``: of the lengths, so that a road that only touches a tract has the length 0."""
    geometries = Geometries.of(settings)
    codes = {s.crs for s in settings}
    code = codes.pop() if len(codes) == 1 else "metres"
    some = roads.where(F.col("class").isin(*classes))
    shapes, lines = crs.tagged(tracts_in_metres(tracts, geometries), ("x0", "x1", "y0", "y1"), code), crs.tagged(roads_in_metres(some, geometries), ("ax",), code)
    # vertices are mapped once for all uses
    shapes = written(shapes, "metre-tracts")
    cut = "longest" if any(t[-1] for t in geometries.roads) else None
    lengths = gaps.polygon_lengths(shapes, lines, CELL, ("geom",), cut, not shapes.where(gaps.is_wide(CELL)).isEmpty())
    lengths = lengths.select("geom", "tid", *(F.round(c, digits).alias(c) for c in ("ov_len", "tiger_len")))
    named = F.explode(F.array(*(F.struct(F.lit(s.name).alias("variant"), F.lit(geometries.of_setting[s.name]).alias("geom")) for s in settings)))
    every = tracts.select("tid", "region", named.alias("_s")).select("tid", "region", "_s.*").join(lengths, ["geom", "tid"], "left")
    every = every.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ov_len", "tiger_len")})
    return every.select("variant", "tid", "region", "ov_len", "tiger_len", planar.ratio_gap(F.col("ov_len"), F.col("tiger_len")).alias("transport_gap"))


def _micro() -> Column:
    # sums of whole millionths are the same in any order
    return F.round(F.col("transport_gap") * 1e6).cast("long")


def ranked(swept: DataFrame, mean: float, within: float = 0.5e-6) -> DataFrame:
    """Settings by how near their total comes to a mean over all tracts, and whether it is as near as ``within`` a tract."""
    out = swept.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("transport_gap").alias("n_defined"), (F.coalesce(F.sum(_micro()), F.lit(0)) / 1e6).alias("total"))
    out = out.withColumn("diff", F.round(F.col("total") - F.lit(mean) * F.col("n"), 6)).withColumn("hit", F.abs("diff") < F.lit(within) * F.col("n"))
    return out.orderBy(F.abs("diff"), "variant")


def deltas(swept: DataFrame, base: str = "base", eps: float = 1e-6) -> DataFrame:
    """(variant, total, n_changed, max_delta): tracts whose gap differs from the base's by more than ``eps``.

    A tract's settings are bounded, so one aggregation brings each beside the base.
    """
    one = F.struct("variant", "transport_gap")
    sides = swept.groupBy("tid").agg(F.max(F.when(F.col("variant") == base, F.col("transport_gap"))).alias("base"), F.collect_list(one).alias("own"))
    each = sides.select("base", F.explode("own").alias("o")).select("base", "o.*").withColumn("delta", F.abs(F.col("transport_gap") - F.col("base")))
    return each.groupBy("variant").agg((F.coalesce(F.sum(_micro()), F.lit(0)) / 1e6).alias("total"), F.count_if(F.col("delta") > eps).alias("n_changed"), F.max("delta").alias("max_delta"))
