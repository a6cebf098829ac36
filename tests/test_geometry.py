"""Geometry on small shapes with known answers, joins against all pairs, and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import crs, planar
from lacuna.operators import gaps, variants
from lacuna.operators.spatial_join import grid_join, naive_join
from lacuna.sources import wkb

SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]
ELL = [[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]]
HOLE = [*SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]
TWO = [*SQUARE, [(6, 0), (8, 0), (8, 4), (6, 4), (6, 0)]]


def shape(rings):
    return planar.edges(F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r)) for r in rings)))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.mark.parametrize(
    "rings,segment,want",
    [
        (SQUARE, (-1, 2, 6, 0), 4), (SQUARE, (-1, 0, 6, 0), 4), (SQUARE, (-1, 5, 6, 0), 0), (SQUARE, (1, 1, 0, 0), 0), (SQUARE, (-1, 1, 2, 0), 1),
        (SQUARE, (4, 5, 2, -2), 0), (ELL, (-1, 3, 6, 0), 2), (ELL, (-1, 2, 6, 0), 4), (ELL, (3, -1, 0, 6), 2), (ELL, (2, -1, 0, 6), 4),
        (HOLE, (-1, 2, 6, 0), 2), (HOLE, (-1, 1, 6, 0), 4), (TWO, (-1, 2, 10, 0), 6), (SQUARE, (-1, -1, 6, 6), 4 * math.sqrt(2)), (ELL, (0, 4, 4, -4), 4 * math.sqrt(2)),
    ],
)
def test_clip(spark, rings, segment, want):
    _, _, dx, dy = segment
    got = one(spark, planar.clip_share(*lits(*segment), shape(rings))) * math.hypot(dx, dy)
    assert got == pytest.approx(want, abs=1e-9)
    if rings is SQUARE:
        assert one(spark, planar.clip_to_box(*lits(*segment), *lits(0, 4, 0, 4))) * math.hypot(dx, dy) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("rings,point,inside,covered", [(SQUARE, (2, 2), True, True), (SQUARE, (0, 2), False, True), (SQUARE, (4, 4), False, True), (SQUARE, (5, 2), False, False), (ELL, (3, 3), False, False), (ELL, (2, 3), False, True), (HOLE, (2, 2), False, False), (HOLE, (0.5, 2), True, True), (TWO, (7, 1), True, True), (TWO, (5, 1), False, False), (ELL, (1, 2), True, True)])
def test_containment(spark, rings, point, inside, covered):
    assert one(spark, planar.contains(*lits(*point), shape(rings))) == inside
    assert one(spark, planar.covers_point(*lits(*point), shape(rings))) == covered


@pytest.mark.parametrize("rings,x,y,area", [(SQUARE, 2, 2, 16), (ELL, 5 / 3, 5 / 3, 12)])
def test_centroid(spark, rings, x, y, area):
    c = one(spark, planar.centroid(shape(rings)))
    assert (c.x, c.y, c.area) == (pytest.approx(x), pytest.approx(y), pytest.approx(area))


def moved(x, y, size=1):
    return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]


@pytest.mark.parametrize("other,meets,within", [(moved(1, 1), True, True), (moved(4, 1), True, False), (moved(4, 4), True, False), (moved(5, 1), False, False), (moved(3, 3, 2), True, False), (moved(-1, -1, 9), True, False), (moved(0, 0, 4), True, True)])
def test_polygon_relations(spark, other, meets, within):
    assert one(spark, planar.polygons_intersect(shape(SQUARE), shape(other))) == meets
    assert one(spark, planar.polygon_covers(shape(SQUARE), shape(other))) == within


def test_ell_does_not_cover_its_notch(spark):
    assert not one(spark, planar.polygon_covers(shape(ELL), shape(moved(1, 1, 2))))


def test_gap_algebra(spark):
    rows = spark.createDataFrame([(None, 2.0), (1.0, 2.0), (5.0, 2.0), (1.0, 0.0), (1.0, None)], "m double, r double")
    got = [r.g for r in rows.select(planar.ratio_gap(F.col("m"), F.col("r")).alias("g")).collect()]
    assert got == [1.0, 0.5, 0.0, None, None]
    cols = (F.col("m"), F.col("r"))
    assert [r.v for r in rows.select(planar.mean_of_defined(*cols).alias("v")).collect()] == [2.0, 1.5, 3.5, 0.5, 1.0]
    none = spark.createDataFrame([(7, 0, None)], "tid int, k int, coverage_gap_score double")
    with pytest.raises(Exception, match="tract 7"):
        gaps.checked(none).collect()


def boxes(spark, r, n, lead, size):
    rows = []
    for i in range(n):
        x, y = r.randrange(-200, 200), r.randrange(-200, 200)
        rows.append((i, x, x + r.randrange(size), y, y + r.randrange(size)))
    return spark.createDataFrame([*rows, (n, 5, 1, 0, 0), (n + 1, None, 1, 0, 0), (n + 2, 0, 40, -40, 0)], f"{lead}id int, {lead}0 int, {lead}1 int, {lead}2 int, {lead}3 int")


@pytest.mark.parametrize("cell", [7, 40, 1000])
def test_grid_join_is_the_naive_join(spark, cell):
    r = random.Random(cell)
    a, b = boxes(spark, r, 150, "a", 60), boxes(spark, r, 100, "b", 90)
    box = lambda lead: tuple(f"{lead}{k}" for k in range(4))
    right_way = lambda df, lead: df.where(f"{lead}0 <= {lead}1")
    want = sorted((x.aid, x.bid) for x in naive_join(right_way(a, "a"), right_way(b, "b"), box("a"), box("b")).collect())
    joined = grid_join(a, b, box("a"), box("b"), cell)
    assert sorted((x.aid, x.bid) for x in joined.collect()) == want and len(want) > 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        grid_join(a, a, box("a"), box("a"), cell)


def test_tiles_sum_to_the_whole(spark):
    r = random.Random(8)
    tiles = spark.createDataFrame([(i * 4 + j, i * 100.0, i * 100.0 + 100, j * 100.0, j * 100.0 + 100) for i in range(4) for j in range(4)], "tid int, x0 double, x1 double, y0 double, y1 double")
    segments = [(x := r.uniform(0, 400), y := r.uniform(0, 400), r.uniform(0, 400) - x, r.uniform(0, 400) - y, True) for _ in range(60)]
    roads = spark.createDataFrame(segments, "ax double, ay double, dx double, dy double, mapped boolean")
    got = gaps.road_lengths(tiles, roads, 100).agg(F.sum("ov_len")).first()[0]
    assert got == pytest.approx(sum(math.hypot(s[2], s[3]) for s in segments))
    parts = variants.segmentize(roads, 30.0).collect()
    assert max(math.hypot(p.dx, p.dy) for p in parts) <= 30.0 + 1e-9
    assert sum(math.hypot(p.dx, p.dy) for p in parts) == pytest.approx(got)


def test_projections(spark):
    xy = lambda e, lon, lat: spark.range(1).selectExpr(f"{e('CAST(%r AS DOUBLE)' % lon, 'CAST(%r AS DOUBLE)' % lat)[0]} AS x", f"{e('CAST(%r AS DOUBLE)' % lon, 'CAST(%r AS DOUBLE)' % lat)[1]} AS y").first()  # noqa: E731, UP031
    assert tuple(xy(crs.EPSG5070.expressions, -96.0, 23.0)) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
    # a published worked example: Clarke 1866, 35 N 75 W
    snyder = crs.Albers(ellipsoid=crs.CLARKE66)
    assert tuple(xy(snyder.expressions, -75.0, 35.0)) == (pytest.approx(1885472.7, abs=0.1), pytest.approx(1535925.0, abs=0.1))
    assert tuple(xy(crs.mercator, 180.0, 0.0)) == (pytest.approx(20037508.342789, abs=1e-5), pytest.approx(0, abs=1e-6))
    back = xy(lambda lon, lat: crs.shifted(lon, lat, (0.0, 0.0, 0.0), crs.GRS80, crs.GRS80), -96.5, 40.25)
    assert tuple(back) == (pytest.approx(-96.5, abs=1e-10), pytest.approx(40.25, abs=1e-9))
    line = spark.createDataFrame([(-100.0, 30.0, -100.0, 31.0), (-100.0, 0.0, -99.0, 0.0), (1.0, 2.0, 1.0, 2.0)], "lon1 double, lat1 double, lon2 double, lat2 double")
    metres = [r.metres for r in variants.geodesic(line).collect()]
    assert metres == [pytest.approx(110861.1, abs=5), pytest.approx(111319.491, abs=0.01), 0]


def test_wkb_round_trip(spark):
    for rings, kind in ((HOLE, 3), ([[(1.5, -2.0)]], 1), ([[(0, 0), (1, 1), (2, 0)]], 2)):
        assert wkb.decode(wkb.encode(rings, kind)) == [[tuple(map(float, p)) for p in r] for r in rings]
    import struct

    multi = struct.pack("<BII", 1, 6, 2) + wkb.encode(SQUARE) + wkb.encode(ELL)
    assert len(wkb.decode(multi)) == 2
    big = struct.pack(">BIIddddd", 0, 0x80000002, 1, 3.0, 4.0, 9.0, 0, 0)[: 1 + 4 + 4 + 24]
    assert wkb.decode(big) == [[(3.0, 4.0)]]
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BI", 1, 99) + b"\0" * 8)
    df = spark.createDataFrame([(1, bytearray(wkb.encode(HOLE))), (2, None)], "id int, geometry binary")
    got = wkb.with_rings(df).withColumn("box", planar.box_of_rings(F.col("geometry"))).orderBy("id").collect()
    assert len(got[0].geometry) == 2 and tuple(got[0].box) == (0, 4, 0, 4) and got[1].geometry is None


def test_boxes_overlap(spark):
    s = lambda *v: planar.box(*lits(*v))
    df = spark.range(1).select(s(0, 2, 0, 2).alias("a"), s(2, 3, 2, 3).alias("b"), s(2.1, 3, 0, 1).alias("c"))
    assert df.select(planar.boxes_overlap("a", "b")).first()[0] and not df.select(planar.boxes_overlap("a", "c")).first()[0]


def turned(rings):
    return [r[::-1] for r in rings]


NESTED = [*HOLE, [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5), (1.5, 1.5)]]


@pytest.mark.parametrize("rings", [SQUARE, ELL, HOLE, TWO, NESTED])
def test_edges_sum_to_the_share_however_rings_are_drawn(spark, rings):
    r = random.Random(len(rings))
    segments = [(r.uniform(-1, 9), r.uniform(-1, 5), r.uniform(-8, 8), r.uniform(-6, 6)) for _ in range(60)]
    segments += [(r.randrange(-1, 9), r.randrange(-1, 6), r.randrange(-4, 5), r.randrange(-4, 5)) for _ in range(60)]
    segments += [(-1, 2, 6, 0), (0, -1, 0, 6), (-1, 0, 6, 0), (5, 4, -6, 0), (1, 1, 0, 0), (4, 5, 0, -6)]
    rows = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(segments)], "k int, ax double, ay double, dx double, dy double").coalesce(1)
    segment = [F.col(c) for c in ("ax", "ay", "dx", "dy")]

    def drawn(own):
        data = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in own]
        return spark.createDataFrame([(data,)], "rings array<array<struct<x:double,y:double>>>").coalesce(1)

    plain = drawn(rings).select(planar.edges(F.col("rings")).alias("edges"))
    share = planar.clip_share(*segment, F.col("edges"))
    want = {x.k: x.s for x in rows.crossJoin(plain).select("k", F.when((F.col("dx") != 0) | (F.col("dy") != 0), share).otherwise(0.0).alias("s")).collect()}
    for own in (rings, turned(rings), [rings[0], *turned(rings[1:])]):
        edges = drawn(own).select(F.explode(planar.edges(planar.oriented(F.col("rings")))).alias("e"))
        got = {x.k: x.s for x in rows.crossJoin(edges).groupBy("k").agg(F.sum(planar.edge_share(*segment, *(F.col(f"e.{c}") for c in "xyuv"))).alias("s")).collect()}
        assert [got[k] for k in range(len(segments))] == [pytest.approx(want[k], abs=1e-9) for k in range(len(segments))]


def test_mercator_has_a_value_beyond_the_poles(spark):
    """As the inverse hyperbolic sine of the latitude's tangent, at which the SQL has it too; the same in the steps of the sweeps."""
    lat = [-300.0, -90.5, -60.0, 0.0, 30.0, 89.999, 90.001, 179.0, 181.0, 269.5, 390.0]
    df = spark.createDataFrame([(-99.5, x) for x in lat], "lon double, lat double")
    x, y = crs.mercator("lon", "lat")
    want = [(-99.5 * 20037508.342789244 / 180, 6378137.0 * math.asinh(math.tan(math.radians(v)))) for v in lat]
    assert [tuple(r) for r in df.select(F.expr(x), F.expr(y)).collect()] == [(u, pytest.approx(v, abs=1e-7)) for u, v in want]
    steps = df.withColumns({c: F.lit(None).cast("double") for c in ("n", "c", "rho")})
    for name, step in crs.conic_steps("lon", "lat", "n", "c", "rho"):
        steps = steps.withColumn(name, F.expr(step))
    assert [tuple(r) for r in steps.select("p_x", "p_y").collect()] == [(u, pytest.approx(v, abs=1e-7)) for u, v in want]


def test_a_total_keeps_its_cents(spark):
    from lacuna.plans.queries import _total

    df = spark.range(0, 400_000, 1, 1).select(F.when(F.col("id") == 0, F.lit(9e12)).otherwise(F.lit(0.0004)).alias("m"))
    assert df.select(F.round(_total(F.col("m")), 2)).first()[0] == pytest.approx(9e12 + 160.0, abs=0.01)
    assert df.select(_total(F.col("m"))).where("false").count() == 0 and df.where("false").select(_total(F.col("m"))).first()[0] is None


def test_conic_coordinates_are_exact_to_the_last_places(spark):
    """Against the same formula in decimals of 40 places: within two of a coordinate's last bits, so that few fall to another place of a grid."""
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    n, c, rho0 = map(Decimal, crs.CONES["5070"])
    e2 = Decimal(2) / Decimal("298.257222101") - 1 / Decimal("298.257222101") ** 2
    e = e2.sqrt()
    r = random.Random(4)
    lats = [r.uniform(30, 60) for _ in range(200)]
    # on the projection's middle meridian y is the cone's radius taken from the origin's
    df = spark.createDataFrame([(-96.0, v) for v in lats], "lon double, lat double").withColumns({k: F.lit(float(v)) for k, v in (("n", n), ("c", c), ("rho", rho0))})
    for name, step in crs.conic_steps("lon", "lat", "n", "c", "rho"):
        df = df.withColumn(name, F.expr(step))
    off = []
    for v, got in zip(lats, (row.p_y for row in df.collect()), strict=True):
        s = Decimal(math.sin(math.radians(v)))
        q = (1 - e2) * (s / (1 - e2 * s * s) + ((1 + e * s) / (1 - e * s)).ln() / (2 * e))
        off.append(abs(Decimal(got) - (rho0 - Decimal(6378137) * (c - n * q).sqrt() / n)))
    assert max(off) < Decimal("6e-9") and sum(off) / len(off) < Decimal("2e-9")
