"""Coverage gaps: how much of a reference layer a mapped layer lacks, per tract.

Every gap keeps the tracts' rows (a left join from the tracts) and is NULL where the reference has nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, planar
from .spatial_join import grid_join

CELL = 20_000
_TRACT_BOX = ("x0", "x1", "y0", "y1")
FACILITIES = ("fire", "ems", "schools")


def _inside() -> Column:
    c = F.col
    return (c("cx") > c("x0")) & (c("cx") < c("x1")) & (c("cy") > c("y0")) & (c("cy") < c("y1"))


def _half_open() -> Column:
    c = F.col
    return (c("cx") >= c("x0")) & (c("cx") < c("x1")) & (c("cy") >= c("y0")) & (c("cy") < c("y1"))


def _within() -> Column:
    c = F.col
    return (c("bx0") >= c("x0")) & (c("bx1") <= c("x1")) & (c("by0") >= c("y0")) & (c("by1") <= c("y1"))


#: How a building belongs to a tract: centre in half-open tract (so that tracts share none), centre off the tract's boundary,
#: closed overlap, or closed containment.
PREDICATES = {"centroid": _half_open, "centroid_inside": _inside, "intersects": lambda: F.lit(True), "within": _within}


def building_pairs(tracts: DataFrame, buildings: DataFrame, how: str = "centroid", cell: float = CELL) -> DataFrame:
    """(tid, bid, in_mapped, in_ref) of buildings in tracts."""
    t = tracts.select("tid", *_TRACT_BOX)
    if how.startswith("centroid"):
        return grid_join(buildings, t, ("cx", "cx", "cy", "cy"), _TRACT_BOX, cell, PREDICATES[how]()).select("tid", "bid", "in_mapped", "in_ref")
    half = F.col("half")
    boxed = buildings.select("bid", "in_mapped", "in_ref", (F.col("cx") - half).alias("bx0"), (F.col("cx") + half).alias("bx1"), (F.col("cy") - half).alias("by0"), (F.col("cy") + half).alias("by1"))
    return grid_join(boxed, t, ("bx0", "bx1", "by0", "by1"), _TRACT_BOX, cell, PREDICATES[how]()).select("tid", "bid", "in_mapped", "in_ref")


def with_gap(tracts: DataFrame, measures: DataFrame, mapped: str, ref: str, gap: str) -> DataFrame:
    """The tracts with both measures (0 where there is none) and the gap."""
    out = tracts.join(measures, "tid", "left")
    out = out.withColumns({mapped: F.coalesce(mapped, F.lit(0)), ref: F.coalesce(ref, F.lit(0))})
    return out.withColumn(gap, planar.ratio_gap(F.col(mapped), F.col(ref)))


def building_gap(tracts: DataFrame, buildings: DataFrame, how: str = "centroid", cell: float = CELL) -> DataFrame:
    counts = building_pairs(tracts, buildings, how, cell).groupBy("tid").agg(F.count_if("in_mapped").alias("ov_cnt"), F.count_if("in_ref").alias("ms_cnt"))
    return with_gap(tracts, counts, "ov_cnt", "ms_cnt", "building_gap")


def building_gaps(tracts: DataFrame, buildings: DataFrame, hows: tuple[str, ...], cell: float = CELL) -> DataFrame:
    """The gap under several rules, a row for each tract and rule (``variant``), from one join: each rule implies that the boxes overlap."""
    half = F.col("half")
    boxed = buildings.withColumns({"bx0": F.col("cx") - half, "bx1": F.col("cx") + half, "by0": F.col("cy") - half, "by1": F.col("cy") + half})
    pairs = grid_join(boxed, tracts.select("tid", *_TRACT_BOX), ("bx0", "bx1", "by0", "by1"), _TRACT_BOX, cell)
    sides = (("ov_cnt", "in_mapped"), ("ms_cnt", "in_ref"))
    counts = pairs.groupBy("tid").agg(*(F.count_if(PREDICATES[h]() & F.col(c)).alias(f"{h}_{n}") for h in hows for n, c in sides))
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = lambda h: F.struct(F.lit(h).alias("variant"), *(zero(f"{h}_{n}").alias(n) for n, _ in sides))
    out = tracts.join(counts, "tid", "left").select(*tracts.columns, F.explode(F.array(*map(one, hows))).alias("_v")).select(*tracts.columns, "_v.*")
    return out.withColumn("building_gap", planar.ratio_gap(F.col("ov_cnt"), F.col("ms_cnt")))


SEGMENT = ("ax", "ay", "dx", "dy")
ROAD_BOX = ("rx0", "rx1", "ry0", "ry1")


def road_boxes(roads: DataFrame) -> DataFrame:
    """Segments with their boxes, which are in the reference system of their ends."""
    ax, ay, dx, dy = (F.col(c) for c in SEGMENT)
    out = roads.withColumns({"rx0": F.least(ax, ax + dx), "rx1": F.greatest(ax, ax + dx), "ry0": F.least(ay, ay + dy), "ry1": F.greatest(ay, ay + dy)})
    return crs.like(out, "ax", ROAD_BOX)


def road_lengths(tracts: DataFrame, roads: DataFrame, cell: float = CELL, by: tuple[str, ...] = (), shared: bool = False, touched: bool = False) -> DataFrame:
    """(tid, ov_len, tiger_len): lengths of both sides' roads clipped to closed tracts; ``by``: further columns of roads to group by,
    which tracts have too and must be equal if they are ``shared``. ``touched``: also tracts that only roads' boxes overlap, with 0.

    The share that is clipped is summed before anything is shuffled by tract.
    """
    common = by if shared else ()
    pairs = grid_join(road_boxes(roads), tracts.select(*common, "tid", *_TRACT_BOX), ROAD_BOX, _TRACT_BOX, cell, by=common, segment=None if touched else SEGMENT)
    share = planar.clip_to_box(*(F.col(c) for c in ("ax", "ay", "dx", "dy", "x0", "x1", "y0", "y1")))
    pairs = pairs.withColumn("len", share * planar.length(F.col("dx"), F.col("dy")))
    return pairs.groupBy("tid", *by).agg(F.sum(F.when(F.col("mapped"), F.col("len")).otherwise(0.0)).alias("ov_len"), F.sum(F.when(~F.col("mapped"), F.col("len")).otherwise(0.0)).alias("tiger_len"))


#: A polygon whose box has more cells than this is joined on a grid of so much wider cells.
MANY, WIDER = 64, 64


def is_wide(cell: float) -> Column:
    """Whether a polygon's box has very many cells."""
    x0, x1, y0, y1 = (planar.cell(F.col(c), cell) for c in _TRACT_BOX)
    return ((x1 - x0 + 1) * (y1 - y0 + 1)) > MANY


def polygon_lengths(polygons: DataFrame, roads: DataFrame, cell: float = CELL, by: tuple[str, ...] = (), longest: str | None = None, wide: bool = False) -> DataFrame:
    """The same for polygons (tid, edges, box) of oriented rings, as ``with_edges`` makes them. Candidates are pairs of a road and a polygon's
    box in a cell, to which the polygon brings its edges: pairs are many more than polygons where layers lie upon each other, so no pair
    is shuffled. What each edge adds to a road's share is a row's arithmetic and is summed per polygon where it is made, so the clip
    runs in generated code and nothing is grouped by pair. ``by``: keys that roads and polygons share, as a variant; ``longest``: a
    column of roads by which each is cut into parts no longer, once it is beside a polygon (whole where it is NULL); ``wide``: there are
    polygons of very many cells (see ``is_wide``), as one about a pole has on a map, to be joined on a grid of their own."""
    keys = [*by, "tid"]
    more = [longest] if longest else []
    boxed, shapes = road_boxes(roads.select(*by, *SEGMENT, "mapped", *more)), polygons.select(*keys, *_TRACT_BOX, "edges")
    joined = lambda some, size: grid_join(boxed, some, ROAD_BOX, _TRACT_BOX, size, by=by, segment=SEGMENT)
    pairs = joined(shapes.where(~is_wide(cell)), cell).unionByName(joined(shapes.where(is_wide(cell)), cell * WIDER)) if wide else joined(shapes, cell)
    segment = [F.col(c) for c in SEGMENT]
    pairs = pairs.where(planar.clip_to_box(*segment, *(F.col(c) for c in _TRACT_BOX)) > 0).select(*keys, *SEGMENT, "mapped", "edges", *more)
    if longest:
        pairs = planar.segmentized(pairs, F.col(longest))
    each = pairs.select(*keys, *SEGMENT, "mapped", F.explode("edges").alias("_e"))
    each = each.withColumn("len", planar.edge_share(*segment, *(F.col(f"_e.{c}") for c in "xyuv")) * planar.length(F.col("dx"), F.col("dy")))
    return each.groupBy(*keys).agg(F.sum(F.when(F.col("mapped"), F.col("len")).otherwise(0.0)).alias("ov_len"), F.sum(F.when(~F.col("mapped"), F.col("len")).otherwise(0.0)).alias("tiger_len"))


def with_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons with the edges of their oriented rings and their box in place of rings."""
    out = polygons.withColumns({"edges": planar.edges(planar.oriented(F.col(rings))), "_box": planar.box_of_rings(F.col(rings))})
    out = out.withColumns({c: F.col(f"_box.{n}") for c, n in zip(_TRACT_BOX, ("xmin", "xmax", "ymin", "ymax"), strict=True)})
    return crs.like(out, rings, _TRACT_BOX).drop("_box", rings)


def snapped_polygons(polygons: DataFrame, grid: float) -> DataFrame:
    """(tid, edges, n_rings) of polygons (tid, rings) with vertices on a grid: spikes and rings that collapsed are gone, and so are edges that
    occur an even number of times, as parts that snapping made adjacent share them.

    Edges are counted per polygon by one aggregation, not by comparing all of them; a polygon without edges left is kept with none.
    """
    rings = planar.repaired(planar.map_vertices("rings", [("x", f"rint(x / {float(grid)!r}D) * {float(grid)!r}D"), ("y", f"rint(y / {float(grid)!r}D) * {float(grid)!r}D")], ("x", "y")))
    out = polygons.select("tid", rings.alias("rings")).withColumns({"n_rings": F.size("rings"), "edges": planar.edges(F.col("rings"))})
    e = F.col("e")
    ends = lambda x, y: F.struct(e[x].alias("x"), e[y].alias("y"))
    each = out.select("tid", F.explode("edges").alias("e")).groupBy("tid", F.least(ends("x", "y"), ends("u", "v")).alias("low"), F.greatest(ends("x", "y"), ends("u", "v")).alias("high"))
    odd = each.agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e")).where("n % 2 = 1").groupBy("tid").agg(F.collect_list("e").alias("edges"))
    none = F.slice(F.array(F.struct(*(F.lit(0.0).alias(c) for c in "xyuv"))), 1, 0)
    return out.select("tid", "n_rings").join(odd, "tid", "left").select("tid", F.coalesce("edges", none).alias("edges"), "n_rings")


#: How a footprint belongs to a polygon.
SHAPES = {"intersects": planar.polygons_intersect, "covers": planar.polygon_covers}


def footprint_counts(polygons: DataFrame, footprints: DataFrame, how: str, cell: float = CELL) -> DataFrame:
    """(tid, ov_cnt, ms_cnt) of footprints (bid, edges, box, in_mapped, in_ref) in polygons (tid, edges, box).

    Candidates carry ids and boxes only; both geometries join them by id, since most of a geometry's candidates fall to its box.
    """
    names = dict(zip(_TRACT_BOX, ("bx0", "bx1", "by0", "by1"), strict=True))
    small = footprints.select("bid", *(F.col(c).alias(n) for c, n in names.items()))
    pairs = grid_join(small, polygons.select("tid", *_TRACT_BOX), tuple(names.values()), _TRACT_BOX, cell).select("bid", "tid")
    both = pairs.join(footprints.select("bid", F.col("edges").alias("part"), "in_mapped", "in_ref"), "bid").join(polygons.select("tid", "edges"), "tid")
    return both.where(SHAPES[how](F.col("edges"), F.col("part"))).groupBy("tid").agg(F.count_if("in_mapped").alias("ov_cnt"), F.count_if("in_ref").alias("ms_cnt"))


#: Kinds of places by their primary category (fixed values).
CATEGORIES = {"fire": ("fire_department",), "ems": ("ambulance_and_ems_services",), "schools": ("elementary_school", "middle_school", "high_school", "school", "private_school", "public_school")}


def kind_of(category: Column) -> Column:
    """A place's kind; NULL for categories that count as establishments only."""
    out = F.lit(None).cast("string")
    for kind, names in CATEGORIES.items():
        out = F.when(category.isin(*names), F.lit(kind)).otherwise(out)
    return out


def placed(polygons: DataFrame, places: DataFrame, cell: float = CELL) -> DataFrame:
    """Places (px, py and others) with the polygon that contains them; those in none or on a boundary are left out."""
    pairs = grid_join(places, polygons.select("tid", "edges", *_TRACT_BOX), ("px", "px", "py", "py"), _TRACT_BOX, cell)
    return pairs.where(planar.contains(F.col("px"), F.col("py"), F.col("edges"))).select("tid", *places.columns)


def transport_gap(tracts: DataFrame, roads: DataFrame, classes: tuple[str, ...] | None = ("primary",), cell: float = CELL, digits: int | None = 3) -> DataFrame:
    """Road gap of the given classes; lengths are rounded before the ratio unless ``digits`` is None."""
    lengths = road_lengths(tracts, roads if classes is None else roads.where(F.col("class").isin(*classes)), cell)
    if digits is not None:
        lengths = lengths.select("tid", F.round("ov_len", digits).alias("ov_len"), F.round("tiger_len", digits).alias("tiger_len"))
    return with_gap(tracts, lengths, "ov_len", "tiger_len", "transport_gap")


def transport_gap_by_class(tracts: DataFrame, roads: DataFrame, classes: tuple[str, ...], cell: float = CELL, digits: int = 3) -> DataFrame:
    """The road gap of each class by itself, a row for each tract and class, from one join."""
    lengths = road_lengths(tracts, roads.where(F.col("class").isin(*classes)), cell, ("class",))
    lengths = lengths.withColumns({c: F.round(c, digits) for c in ("ov_len", "tiger_len")})
    every = tracts.withColumn("class", F.explode(F.array(*map(F.lit, classes)))).join(lengths, ["tid", "class"], "left")
    every = every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ov_len", "tiger_len")})
    return every.withColumn("transport_gap", planar.ratio_gap(F.col("ov_len"), F.col("tiger_len")))


def poi_counts(pois: DataFrame) -> DataFrame:
    """(tid, kind, mapped, ref) for each kind that occurs."""
    return pois.groupBy("tid", "kind").agg(F.count_if("in_mapped").alias("mapped"), F.count_if("in_ref").alias("ref"))


def poi_gap(tracts: DataFrame, pois: DataFrame, kinds: tuple[str, ...] = FACILITIES) -> DataFrame:
    """Gaps by kind, their mean (the facilities' half), the establishments' half, and the mean of both halves.

    Kinds left out of ``kinds`` don't count as facilities, but all places count as establishments.
    """
    sums = [F.count_if(F.col(c) & (F.col("kind") == k)).alias(f"{k}_{c[3:]}") for k in kinds for c in ("in_mapped", "in_ref")]
    wide = pois.groupBy("tid").agg(*sums, F.count_if("in_mapped").alias("places"))
    out = tracts.join(wide, "tid", "left")
    out = out.withColumns({f"poi_gap_{k}": planar.ratio_gap(F.col(f"{k}_mapped"), F.col(f"{k}_ref")) for k in kinds})
    out = out.withColumn("facilities_half", planar.mean_of_defined(*(F.col(f"poi_gap_{k}") for k in kinds)))
    out = out.withColumn("establishments_half", planar.ratio_gap(F.col("places"), F.col("cbp_estab")))
    return out.withColumn("poi_gap", planar.mean_of_defined(F.col("facilities_half"), F.col("establishments_half")))


def composite(tracts: DataFrame, buildings: DataFrame, roads: DataFrame, pois: DataFrame, classes: tuple[str, ...] = ("primary",)) -> DataFrame:
    """Tracts with three gaps, their number k and their mean.

    The three measures are aggregated to one row per tract first, so the joins carry tracts only.
    """
    out = tracts
    for part, column in ((transport_gap(tracts, roads, classes), "transport_gap"), (building_gap(tracts, buildings), "building_gap"), (poi_gap(tracts, pois), "poi_gap")):
        out = out.join(part.select("tid", column), "tid", "left")
    parts = [F.col(c) for c in ("transport_gap", "building_gap", "poi_gap")]
    return out.withColumns({"k": planar.count_defined(*parts), "coverage_gap_score": planar.mean_of_defined(*parts)})


def checked(scores: DataFrame) -> DataFrame:
    """Fails at run time if a tract has no defined component."""
    ok = F.assert_true(F.col("k") >= 1, F.concat(F.lit("no component is defined for tract "), F.col("tid").cast("string")))
    return scores.where(F.coalesce(ok.isNull(), F.lit(True)))


def nearest_road(roads: DataFrame, refs: DataFrame, reach: float) -> DataFrame:
    """(ref_id, distance) from each reference road's middle to the nearest mapped road within ``reach``, NULL beyond it.

    Only cells within reach are joined; the minimum is aggregated before the shuffle.
    """
    mid = refs.select("ref_id", (F.col("ax") + F.col("dx") / 2).alias("mx"), (F.col("ay") + F.col("dy") / 2).alias("my"))
    near = mid.withColumns({"m0": F.col("mx") - reach, "m1": F.col("mx") + reach, "n0": F.col("my") - reach, "n1": F.col("my") + reach})
    pairs = grid_join(near, road_boxes(roads), ("m0", "m1", "n0", "n1"), ROAD_BOX, 2 * reach)
    ax, ay, dx, dy = (F.col(c) for c in ("ax", "ay", "dx", "dy"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("mx") - ax) * dx + (F.col("my") - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    apart = planar.length(F.col("mx") - ax - t * dx, F.col("my") - ay - t * dy)
    found = pairs.withColumn("distance", apart).where(F.col("distance") <= reach).groupBy("ref_id").agg(F.min("distance").alias("distance"))
    return refs.select("ref_id").join(found, "ref_id", "left")
