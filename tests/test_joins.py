"""Grid joins by segment cells and by levels, reference systems, and plans that must not grow."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import crs, planar
from lacuna.operators import gaps, metres, variants
from lacuna.operators.spatial_join import grid_join, naive_join, with_levels, with_segment_cells
from lacuna.sources import tables

ROOT = "/root/testdata/sf0.001"
BOX = ("x0", "x1", "y0", "y1")


def squares(spark, r, n, sizes, span=400):
    rows = []
    for k in range(n):
        x, y, s = r.randrange(-span, span), r.randrange(-span, span), r.choice(sizes)
        rows.append((k, float(x), float(x + s), float(y), float(y + r.choice(sizes))))
    return spark.createDataFrame(rows, "tid int, x0 double, x1 double, y0 double, y1 double")


def lines(spark, r, n, longest=300):
    rows = [(k, float(r.randrange(-400, 400)), float(r.randrange(-400, 400)), float(r.choice([0, r.randrange(-longest, longest)])), float(r.choice([0, r.randrange(-longest, longest)]))) for k in range(n)]
    return gaps.road_boxes(spark.createDataFrame(rows, "rid int, ax double, ay double, dx double, dy double"))


def share():
    return planar.clip_interval(*(F.col(c) for c in (*gaps.SEGMENT, *BOX)))


@pytest.mark.parametrize("cell", [5, 40, 1000])
def test_segment_cells_lose_no_pair(spark, cell):
    r = random.Random(cell)
    a, b = lines(spark, r, 120), squares(spark, r, 80, [0, 3, 40, 120])
    low, high = share()
    want = sorted((x.rid, x.tid) for x in naive_join(a, b, gaps.ROAD_BOX, BOX, low <= high).collect())
    joined = grid_join(a, b, gaps.ROAD_BOX, BOX, cell, segment=gaps.SEGMENT)
    got = sorted((x.rid, x.tid) for x in joined.collect())
    assert len(set(got)) == len(got) and set(want) <= set(got) and len(want) > 50
    assert sorted((x.rid, x.tid) for x in joined.where(low <= high).collect()) == want
    assert joined.columns == [*a.columns, *b.columns]


def test_a_long_diagonal_names_few_cells(spark):
    one = gaps.road_boxes(spark.createDataFrame([(1, 0.5, 0.25, 1000.0, 999.0)], "rid int, ax double, ay double, dx double, dy double"))
    assert 1000 < with_segment_cells(one, gaps.SEGMENT, 1.0, "_l").count() <= 3 * 1001
    none = one.withColumn("ax", F.lit(None).cast("double"))
    assert with_segment_cells(none, gaps.SEGMENT, 1.0, "_l").count() == 0


@pytest.mark.parametrize("levels", [2, 5])
def test_levels_give_the_naive_join(spark, levels):
    r = random.Random(levels)
    a = squares(spark, r, 90, [0, 1, 9, 200, 700]).toDF("aid", "a0", "a1", "a2", "a3")
    b = squares(spark, r, 90, [0, 2, 30, 500])
    box = ("a0", "a1", "a2", "a3")
    want = sorted((x.aid, x.tid) for x in naive_join(a, b, box, BOX).collect())
    assert sorted((x.aid, x.tid) for x in grid_join(a, b, box, BOX, 4, levels=levels).collect()) == want and len(want) > 500
    points = a.select("aid", F.col("a0").alias("px"), F.col("a2").alias("py"))
    at = ("px", "px", "py", "py")
    want = sorted((x.aid, x.tid) for x in naive_join(points, b, at, BOX).collect())
    assert sorted((x.aid, x.tid) for x in grid_join(points, b, at, BOX, 4, levels=levels).collect()) == want


def test_levels_bound_the_cells_of_a_wide_box(spark):
    wide = spark.createDataFrame([(1, 0.0, 1e6, 0.0, 1e6), (2, 0.0, 1.0, 0.0, 1.0)], "tid int, x0 double, x1 double, y0 double, y1 double")
    counts = {x.tid: x["count"] for x in with_levels(wide, BOX, 1.0, 11, "_l").groupBy("tid").count().collect()}
    assert max(counts.values()) <= 4 * 11 + 5


def test_reference_systems_must_agree(spark, tmp_path):
    r = random.Random(3)
    a, b = lines(spark, r, 5), squares(spark, r, 5, [300])
    roads = gaps.road_boxes(crs.tagged(a.drop(*gaps.ROAD_BOX), ("ax",), "5070"))
    assert crs.code_of(roads, "rx1") == "5070"
    metric, degrees = crs.tagged(b, BOX, "5070"), crs.tagged(b, BOX, "4326")
    grid_join(roads, metric, gaps.ROAD_BOX, BOX, 40)
    grid_join(roads, b, gaps.ROAD_BOX, BOX, 40)
    with pytest.raises(ValueError, match="5070.*4326"):
        grid_join(roads, degrees, gaps.ROAD_BOX, BOX, 40)
    degrees.select("tid", *BOX).where("tid > 0").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        grid_join(roads, spark.read.parquet(str(tmp_path / "t")), gaps.ROAD_BOX, BOX, 40)


def size_of(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_projected_plans_stay_small(spark):
    t, r = tables.tracts(spark, ROOT), tables.roads(spark, ROOT)
    one, many = (metres.transport(metres.degree_rings(t), metres.degree_ends(r), s) for s in ((metres.BASE,), metres.TRANSPORT + metres.DATUM[1:]))
    assert size_of(one) < 120_000 and size_of(many) < 3 * size_of(one)


def test_settings_of_equal_numbers_share_a_geometry():
    g = metres.Geometries.of(metres.TRANSPORT)
    assert g.of_setting["e6350"] != g.of_setting["e102003"] and len(g.roads) == 10 and len(g.tracts) == 6
    same = metres.Geometries.of((metres.BASE, metres.Setting("e6350", crs="6350")))
    assert len(same.pairs) == 1 and set(same.of_setting.values()) == {0}


def test_cut_roads_have_the_length_of_whole_ones(spark):
    t, r = metres.degree_rings(tables.tracts(spark, ROOT).limit(20)), metres.degree_ends(tables.roads(spark, ROOT).limit(300))
    got = metres.transport(t, r, (metres.BASE, metres.Setting("cut", longest=500)), ("primary", "secondary")).collect()
    by = {(x.variant, x.tid): (x.ov_len, x.tiger_len) for x in got}
    assert len(by) == 40 and any(v[0] for v in by.values())
    for tid in {k[1] for k in by}:
        assert by["base", tid] == pytest.approx(by["cut", tid], abs=0.002)


@pytest.mark.parametrize("name", list(crs.SHIFTS))
def test_steps_are_the_closed_forms(spark, name):
    """Vertices mapped in steps inside rings and in columns against the one-expression forms."""
    shift = crs.SHIFTS[name]
    setting = metres.Setting("s", shift=name)
    pts = spark.createDataFrame([(-100.25, 31.5), (-96.0, 23.0), (-80.1, 45.9)], "lon double, lat double")
    lon2, lat2 = crs.shifted("lon", "lat", shift)
    want = pts.select(F.expr(lon2).alias("lon"), F.expr(lat2).alias("lat")).select(*(F.expr(e).alias(n) for n, e in zip("xy", crs.EPSG5070.expressions("lon", "lat"), strict=True))).collect()
    ring = F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    g = metres.Geometries.of((setting,))
    treated = metres._treated(pts.withColumn("rings", ring), g.tracts, [[0]])
    got = treated.select(planar.map_vertices("rings", metres._steps(g.tracts, "x", "y"), ("p_x", "p_y")).alias("r")).select("r").collect()
    for a, b in zip(got, want, strict=True):
        assert (a.r[0][0].x, a.r[0][0].y) == (pytest.approx(b.x, abs=1e-6), pytest.approx(b.y, abs=1e-6))


def ring(*points):
    return [[(float(x), float(y)) for x, y in points]]


@pytest.mark.parametrize(
    "rings,want",
    [
        (ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((4, 4), (0, 4), (0, 0), (4, 0), (4, 4))),
        (ring((0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((4, 4), (0, 4), (0, 0), (4, 0), (4, 4))),
        (ring((0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((4, 4), (0, 4), (0, 0), (4, 0), (4, 4))),
        (ring((9, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (9, 0)), 4),
        (ring((0, 0), (4, 0), (0, 0)), None),
        (ring((0, 0), (4, 0), (8, 0), (0, 0)), None),
        (ring((1, 1), (1, 1), (1, 1), (1, 1)), None),
        ([], None),
    ],
)
def test_repair(spark, rings, want):
    data = [[{"x": x, "y": y} for x, y in r] for r in rings]
    got = spark.createDataFrame([(data,)], "r array<array<struct<x:double,y:double>>>").select(planar.repaired(F.col("r")).alias("r")).first().r
    got = [[(p.x, p.y) for p in r] for r in got]
    if want is None:
        assert got == []
    elif isinstance(want, int):
        assert len(got[0]) == want + 1 and (9.0, 0.0) not in got[0]
    else:
        assert got == want


def test_degrees_of_roads_and_tracts_agree(spark):
    t = metres.degree_rings(spark.createDataFrame([(1, 0, 20000, 0, 20000)], "tid int, x0 int, x1 int, y0 int, y1 int")).first()
    r = metres.degree_ends(spark.createDataFrame([(0.0, 0.0, 20000.0, 20000.0)], "ax double, ay double, dx double, dy double")).first()
    assert (r.lon1, r.lat1, r.lon2, r.lat2) == (t.rings[0][0].x, t.rings[0][0].y, t.rings[0][2].x, t.rings[0][2].y) and r.lon1 == variants.ORIGIN[0]


def test_very_wide_polygons_name_few_cells(spark):
    """A polygon about a pole has millions of a tract's cells: it is joined on a grid of its own, and no pair is shuffled."""
    ring = lambda x, y, s: [{"x": a, "y": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    shapes = gaps.with_edges(spark.createDataFrame([(1, [ring(0.0, 0.0, 10.0)]), (2, [ring(-1e4, -1e4, 2e4)])], "tid int, rings array<array<struct<x:double,y:double>>>"))
    assert [r.wide for r in shapes.select("tid", gaps.is_wide(5.0).alias("wide")).orderBy("tid").collect()] == [False, True]
    roads = spark.createDataFrame([(2.0, 2.0, 3.0, 4.0, True), (5.0, 5.0, 10.0, 0.0, False), (9_997.0, 0.0, 6.0, 8.0, True)], "ax double, ay double, dx double, dy double, mapped boolean")
    out = gaps.polygon_lengths(shapes, roads, 5.0, wide=True)
    got = {r.tid: (r.ov_len, r.tiger_len) for r in out.collect()}
    assert got == {1: (pytest.approx(5.0), pytest.approx(5.0)), 2: (pytest.approx(10.0), pytest.approx(10.0))}
    cut = gaps.polygon_lengths(shapes, roads.withColumn("longest", F.lit(1.5)), 5.0, longest="longest", wide=True)
    assert {r.tid: (pytest.approx(r.ov_len), pytest.approx(r.tiger_len)) for r in cut.collect()} == {1: (5.0, 5.0), 2: (10.0, 10.0)}


def test_pairs_of_roads_and_polygons_are_not_shuffled(spark):
    t, r = metres.degree_rings(tables.tracts(spark, ROOT)), metres.degree_ends(tables.roads(spark, ROOT))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = metres.transport(t, r, (metres.BASE, metres.Setting("cut", longest=100)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # candidates by cell, and sums by tract: nothing joins pairs with polygons, and roads are shuffled whole
    assert plan.count("SortMergeJoin") == 2
