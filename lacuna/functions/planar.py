"""Planar geometry as column expressions: everything stays in generated code or array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- gaps and means


def defined(ref: Column) -> Column:
    """Whether there is anything to compare with."""
    return F.coalesce(ref, F.lit(0)) > 0


def ratio_gap(mapped: Column, ref: Column) -> Column:
    """1 - min(1, mapped / ref), NULL where ref is not positive."""
    return F.when(defined(ref), 1 - F.least(F.lit(1.0), F.coalesce(mapped, F.lit(0)) / ref))


def mean_of_defined(*values: Column) -> Column:
    """The mean of the values that are not NULL; NULL if there is none."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    return F.try_divide(total, count_defined(*values))


def count_defined(*values: Column) -> Column:
    return sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))


# ---- boxes and cells


def cell(value: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((value - origin) / size)


def boxes_overlap(a: str, b: str) -> Column:
    """Closed overlap of structs with xmin, xmax, ymin, ymax."""
    c = F.col
    return (c(f"{a}.xmin") <= c(f"{b}.xmax")) & (c(f"{a}.xmax") >= c(f"{b}.xmin")) & (c(f"{a}.ymin") <= c(f"{b}.ymax")) & (c(f"{a}.ymax") >= c(f"{b}.ymin"))


def box(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), xmax.alias("xmax"), ymin.alias("ymin"), ymax.alias("ymax"))


def box_of_rings(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys))


# ---- segments


def clip_interval(ax: Column, ay: Column, dx: Column, dy: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> tuple[Column, Column]:
    """Where a segment enters and leaves a closed box, as shares of its length (Liang and Barsky); it misses if it leaves first."""

    def inside(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        still = (p >= low) & (p <= high)
        enter = F.when(d > 0, (low - p) / d).when(d < 0, (high - p) / d).when(still, F.lit(0.0)).otherwise(F.lit(2.0))
        leave = F.when(d > 0, (high - p) / d).when(d < 0, (low - p) / d).otherwise(F.lit(1.0))
        return enter, leave

    (ex, lx), (ey, ly) = inside(ax, dx, x0, x1), inside(ay, dy, y0, y1)
    return F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)


def clip_to_box(ax: Column, ay: Column, dx: Column, dy: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The share of a segment that lies in a closed box."""
    enter, leave = clip_interval(ax, ay, dx, dy, x0, x1, y0, y1)
    return F.greatest(F.lit(0.0), leave - enter)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def edges(rings: Column) -> Column:
    """Edges (x, y, u, v) of closed rings."""
    one = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda k: F.struct(F.get(r, k - 1)["x"].alias("x"), F.get(r, k - 1)["y"].alias("y"), F.get(r, k)["x"].alias("u"), F.get(r, k)["y"].alias("v")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), one))


def on_edge(px: Column, py: Column, e: Column, within: float = 0.0) -> Column:
    """Whether a point lies on an edge, by its cross product and box."""
    cross = (e["u"] - e["x"]) * (py - e["y"]) - (e["v"] - e["y"]) * (px - e["x"])
    return (F.abs(cross) <= within) & (px >= F.least(e["x"], e["u"])) & (px <= F.greatest(e["x"], e["u"])) & (py >= F.least(e["y"], e["v"])) & (py <= F.greatest(e["y"], e["v"]))


def odd_crossings(px: Column, py: Column, edge_list: Column) -> Column:
    """Even-odd rule: whether a ray to the right meets an odd number of edges. Holes and parts need no care."""
    meets = lambda e: ((e["y"] > py) != (e["v"] > py)) & (px < e["x"] + (py - e["y"]) * F.try_divide(e["u"] - e["x"], e["v"] - e["y"]))
    return F.size(F.filter(edge_list, meets)) % 2 == 1


def contains(px: Column, py: Column, edge_list: Column) -> Column:
    """Interior containment: a point on the boundary is outside."""
    return odd_crossings(px, py, edge_list) & ~F.exists(edge_list, lambda e: on_edge(px, py, e))


def covers_point(px: Column, py: Column, edge_list: Column) -> Column:
    """Closed containment: a point on the boundary is inside."""
    return odd_crossings(px, py, edge_list) | F.exists(edge_list, lambda e: on_edge(px, py, e))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def segments_meet(a: Column, b: Column) -> Column:
    """Closed intersection of two edges, touching and collinear ones included."""
    d = lambda e, x, y: _cross(e["u"] - e["x"], e["v"] - e["y"], x - e["x"], y - e["y"])
    d1, d2, d3, d4 = d(b, a["x"], a["y"]), d(b, a["u"], a["v"]), d(a, b["x"], b["y"]), d(a, b["u"], b["v"])
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    return proper | on_edge(a["x"], a["y"], b) | on_edge(a["u"], a["v"], b) | on_edge(b["x"], b["y"], a) | on_edge(b["u"], b["v"], a)


def polygons_intersect(a: Column, b: Column) -> Column:
    """Closed intersection of two polygons given as edges."""
    touch = F.exists(a, lambda e: F.exists(b, lambda f: segments_meet(e, f)))
    return touch | covers_point(F.get(a, F.lit(0))["x"], F.get(a, F.lit(0))["y"], b) | covers_point(F.get(b, F.lit(0))["x"], F.get(b, F.lit(0))["y"], a)


def polygon_covers(outer: Column, inner: Column) -> Column:
    """Closed containment: all corners and edge middles of inner in outer, and no edge crosses."""
    crosses = lambda e, f: (F.signum(_cross(f["u"] - f["x"], f["v"] - f["y"], e["x"] - f["x"], e["y"] - f["y"])) * F.signum(_cross(f["u"] - f["x"], f["v"] - f["y"], e["u"] - f["x"], e["v"] - f["y"])) < 0) & (F.signum(_cross(e["u"] - e["x"], e["v"] - e["y"], f["x"] - e["x"], f["y"] - e["y"])) * F.signum(_cross(e["u"] - e["x"], e["v"] - e["y"], f["u"] - e["x"], f["v"] - e["y"])) < 0)
    corners = F.forall(inner, lambda e: covers_point(e["x"], e["y"], outer) & covers_point((e["x"] + e["u"]) / 2, (e["y"] + e["v"]) / 2, outer))
    return corners & ~F.exists(inner, lambda e: F.exists(outer, lambda f: crosses(e, f)))


def crossings(ax: Column, ay: Column, dx: Column, dy: Column, edge_list: Column) -> Column:
    """Where a segment's whole line crosses edges, as sorted multiples of the segment: it enters at the first, leaves at the second,
    and so on. A corner belongs to the edge that leaves the line's right side, so that each passage counts once."""
    side = lambda x, y: dx * (y - ay) - dy * (x - ax)
    at = lambda e: ((e["x"] - ax) * (e["v"] - e["y"]) - (e["y"] - ay) * (e["u"] - e["x"])) / (dx * (e["v"] - e["y"]) - dy * (e["u"] - e["x"]))
    met = F.filter(edge_list, lambda e: (side(e["x"], e["y"]) >= 0) != (side(e["u"], e["v"]) >= 0))
    return F.sort_array(F.transform(met, at))


def share_inside(ax: Column, ay: Column, dx: Column, dy: Column, edge_list: Column, crossed: Column) -> Column:
    """The share of a segment in a closed polygon. ``crossed`` (see ``crossings``) should be a column, since it is read often.

    The clipped multiples are summed with alternating signs. Stretches along an edge lie on one side or the other by the rule
    for corners; those on the outer side are added, since the boundary belongs to the polygon.
    """
    clip = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("sign"))
    inner = F.aggregate(crossed, start, lambda s, t: F.struct((s["sum"] + s["sign"] * clip(t)).alias("sum"), (-s["sign"]).alias("sign")), lambda s: s["sum"])
    on_line = lambda x, y: dx * (y - ay) - dy * (x - ax) == 0
    run = dx * dx + dy * dy
    along = lambda x, y: F.try_divide((x - ax) * dx + (y - ay) * dy, run)
    stretches = F.transform(F.filter(edge_list, lambda e: on_line(e["x"], e["y"]) & on_line(e["u"], e["v"])), lambda e: F.struct(along(e["x"], e["y"]).alias("t"), along(e["u"], e["v"]).alias("u")))
    outer = F.filter(stretches, lambda p: F.size(F.filter(crossed, lambda t: t > (p["t"] + p["u"]) / 2)) % 2 == 0)
    return inner + F.coalesce(F.aggregate(outer, F.lit(0.0), lambda s, p: s + F.abs(clip(p["u"]) - clip(p["t"]))), F.lit(0.0))


def clip_share(ax: Column, ay: Column, dx: Column, dy: Column, edge_list: Column) -> Column:
    """The share of a segment in a closed polygon."""
    return share_inside(ax, ay, dx, dy, edge_list, crossings(ax, ay, dx, dy, edge_list))


def signed_area(ring: Column) -> Column:
    """Twice the area of a closed ring, above 0 if it runs counterclockwise."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, k: s + F.get(ring, k - 1)["x"] * F.get(ring, k)["y"] - F.get(ring, k)["x"] * F.get(ring, k - 1)["y"])


def oriented(rings: Column) -> Column:
    """Rings with what they enclose by the even-odd rule on their left: counterclockwise where an even number of others holds them.

    Rings of a valid polygon don't cross, so a ring's first vertex stands for it.
    """
    short = lambda r: F.size(r) < 4
    around = lambda r, k: F.size(F.filter(rings, lambda o, j: (j != k) & ~short(o) & contains(F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"], edges(F.array(o))))) % 2 == 0
    left = lambda r, k: F.when(F.size(rings) == 1, F.lit(True)).otherwise(around(r, k))
    return F.transform(rings, lambda r, k: F.when(short(r) | ((signed_area(r) > 0) == left(r, k)), r).otherwise(F.reverse(r)))


def edge_share(ax: Column, ay: Column, dx: Column, dy: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """What an edge (x, y) to (u, v) of oriented rings adds to the share of a segment inside them: summed over all edges it is the share in
    the closed polygon. No edge needs to know of the others, so the sum can be made by any aggregation.

    Where the segment's line leaves over an edge, the place counts, cut to the segment; where it enters, it counts negative. A corner
    on the line belongs to the line's left, so a stretch along an edge with the inside on the left counts as outside and is added.
    """
    clip = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    side = lambda px, py: dx * (py - ay) - dy * (px - ax)
    first, last = side(x, y), side(u, v)
    at = clip(((x - ax) * (v - y) - (y - ay) * (u - x)) / F.nullif(dx * (v - y) - dy * (u - x), F.lit(0.0)))
    along = lambda px, py: clip(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))
    same_way = (u - x) * dx + (v - y) * dy > 0
    return F.when((first >= 0) & (last < 0), -at).when((first < 0) & (last >= 0), at).when((first == 0) & (last == 0) & same_way, along(u, v) - along(x, y)).otherwise(F.lit(0.0))


def map_vertices(rings: str, steps: list[tuple[str, str]], result: tuple[str, str]) -> Column:
    """The column of rings with every vertex changed by steps (name, SQL), each from ``x``, ``y`` and the names before it and from other
    columns of the row; ``result`` names the new coordinates. A step is computed once a vertex, however often later ones use it."""
    names = lambda sql, among: set(re.findall(r"\b(?:" + "|".join(sorted(among, key=len, reverse=True)) + r")\b", sql))
    every = {"x", "y", *(name for name, _ in steps)}
    # what each step's points must hold: names that steps after it or the result use
    later, needed = set(result), []
    for name, sql in reversed(steps):
        needed.append(later)
        later = (later - {name}) | names(sql, every)
    out, known = rings, ["x", "y"]
    for k, ((name, sql), keep) in enumerate(zip(steps, reversed(needed), strict=True)):
        own = f"_p{k}"
        held = re.sub(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b", lambda m, own=own: f"{own}.{m[1]}", sql)
        known = [*(c for c in known if c != name and c in keep), name]
        fields = ", ".join(f"'{c}', {held if c == name else f'{own}.{c}'}" for c in known)
        out = f"transform({out}, _r{k} -> transform(_r{k}, {own} -> named_struct({fields})))"
    x, y = result
    return F.expr(f"transform({out}, _r -> transform(_r, _p -> named_struct('x', _p.{x}, 'y', _p.{y})))")


def _same_point(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def _without_folds(ring: Column) -> Column:
    """An open ring's vertices, each put on a stack; one that equals the top is left out, and one that equals the vertex below the
    top, or goes back along the edge to it, takes the top off: a spike's tip."""

    def add(stack: Column, p: Column) -> Column:
        n = F.size(stack)
        top, below = F.get(stack, n - 1), F.get(stack, n - 2)
        ux, uy, vx, vy = top["x"] - below["x"], top["y"] - below["y"], p["x"] - top["x"], p["y"] - top["y"]
        back = (ux * vy - uy * vx == 0) & (ux * vx + uy * vy < 0)
        popped = F.slice(stack, 1, n - 1)
        under = F.get(popped, F.size(popped) - 1)
        return (
            F.when((n > 0) & _same_point(top, p), stack)
            .when((n > 1) & back, F.when(_same_point(under, p), popped).otherwise(F.array_append(popped, p)))
            .otherwise(F.array_append(stack, p))
        )

    return F.aggregate(ring, F.slice(ring, 1, 0), add)


def repaired(rings: Column) -> Column:
    """Closed rings after snapping: repeated vertices, spikes (also across a ring's start) and rings without area are taken out.

    Spikes may be nested; two passes, the second from another start, find those across the start. Crossing edges stay: the
    even-odd rule of the predicates here has a meaning for them.
    """
    turned = lambda r: F.concat(F.slice(r, F.floor(F.size(r) / 2).cast("int") + 1, F.size(r)), F.slice(r, 1, F.floor(F.size(r) / 2).cast("int")))
    opened = F.transform(rings, lambda r: F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))
    once = F.transform(opened, _without_folds)
    twice = F.transform(F.transform(once, turned), _without_folds)
    closed = F.transform(twice, lambda r: F.when(F.size(r) > 2, F.concat(r, F.slice(r, 1, 1))).otherwise(F.slice(r, 1, 0)))
    return F.filter(closed, lambda r: (F.size(r) > 3) & (F.when(F.size(r) > 3, signed_area(r)).otherwise(F.lit(0.0)) != 0))


def rectangle(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """A box's rings, counterclockwise."""
    return F.array(F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))))


def centroid(edge_list: Column) -> Column:
    """Area centroid (shoelace), as a struct x, y, area; NULL coordinates for an area of zero."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        c = e["x"] * e["v"] - e["u"] * e["y"]
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (e["x"] + e["u"]) * c).alias("x"), (acc["y"] + (e["y"] + e["v"]) * c).alias("y"))

    return F.aggregate(edge_list, zero, add, lambda s: F.struct(F.try_divide(s["x"], 3 * s["a"]).alias("x"), F.try_divide(s["y"], 3 * s["a"]).alias("y"), (s["a"] / 2).alias("area")))


# ---- precision and density


def snap(value: Column, grid: float | Column) -> Column:
    """A coordinate rounded to a grid, half to even; as it is where the grid is NULL. Vertices only: topology is not repaired."""
    on = F.bround(value / grid) * grid
    return F.coalesce(on, value) if isinstance(grid, Column) else on


def pieces(dx: Column, dy: Column, longest: float | Column) -> Column:
    """Into how many equal parts a segment is cut so that none is longer; one where ``longest`` is NULL."""
    return F.greatest(F.lit(1), F.ceil(length(dx, dy) / longest)).cast("int")


def segmentized(segments: DataFrame, longest: float | Column) -> DataFrame:
    """Segments (ax, ay, dx, dy) cut into equal parts no longer than ``longest`` (whole where it is NULL), with their number ``part``."""
    out = segments.withColumn("_n", pieces(F.col("dx"), F.col("dy"), longest)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = {c: F.col(c) / F.col("_n") for c in ("dx", "dy")}
    return out.withColumns({"ax": F.col("ax") + F.col("part") * step["dx"], "ay": F.col("ay") + F.col("part") * step["dy"], **step}).drop("_n")
