"""Coverage distance and matched pairs against all pairs; snapped polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import planar
from lacuna.operators import gaps, matching

SCHEMA = "class string, ax double, ay double, dx double, dy double"


def made(r, n, span=300):
    rows = [(r.choice("pqr"), float(r.randrange(span)), float(r.randrange(span)), float(r.randrange(-60, 60)), float(r.randrange(-60, 60))) for _ in range(n)]
    return [*rows, ("p", 5.0, 5.0, 0.0, 0.0), rows[0], rows[0]]


def apart(px, py, s):
    _, ax, ay, dx, dy = s
    run = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / run)) if run else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


@pytest.mark.parametrize("steps", [(8, 8), (1, 16), (16, 2)])
@pytest.mark.parametrize("reach", [20.0, 120.0])
def test_coverage_distance_is_that_of_all_places(spark, steps, reach):
    r = random.Random(int(reach) + steps[0])
    refs, roads = made(r, 40), made(r, 60)
    parts = steps[0] * steps[1]
    want = [max(min([reach, *(apart(a + dx * (k / parts), b + dy * (k / parts), s) for s in roads)]) for k in range(parts + 1)) for _, a, b, dx, dy in refs]
    given = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(refs)], "ref_id int, ax double, ay double, dx double, dy double")
    got = {x.ref_id: x.distance for x in matching.coverage_distance(given, spark.createDataFrame(roads, SCHEMA), reach, steps).collect()}
    assert [got[k] for k in range(len(refs))] == [pytest.approx(w, abs=1e-9) for w in want]
    assert any(w < reach for w in want)


def test_no_roads_at_all(spark):
    given = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], "ref_id int, ax double, ay double, dx double, dy double")
    assert matching.coverage_distance(given, spark.createDataFrame([], SCHEMA), 7.0).first().distance == 7.0
    assert matching.coverage_distance(given.where("false"), given, 7.0).count() == 0


def test_few_places_are_looked_at_closely(spark, monkeypatch):
    """Roads that lie on mapped ones all along are settled by the first round."""
    r = random.Random(5)
    roads = made(r, 50)
    given = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(roads)], "ref_id int, ax double, ay double, dx double, dy double")
    asked = []
    plain = matching._distances
    monkeypatch.setattr(matching, "_distances", lambda points, *rest: asked.append(points) or plain(points, *rest))
    got = matching.coverage_distance(given, spark.createDataFrame(roads, SCHEMA), 100.0, (16, 16))
    assert got.agg(F.max("distance")).first()[0] < 1e-9
    assert asked[0].count() == len(roads) * 17


def test_places_are_shuffled_once_each(spark):
    """Places have one cell each, and nothing is joined to the places a second time."""
    given = spark.createDataFrame([(k, 7.0 * k, 0.0) for k in range(50)], "k int, px double, py double").withColumn("ref_id", F.lit(1))
    near = matching._distances(given, spark.createDataFrame([("p", 100.0, 3.0, 50.0, 0.0)], SCHEMA), 5.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {r.k: r.d for r in near.collect()} == {k: pytest.approx(min(5.0, apart(7.0 * k, 0.0, ("p", 100.0, 3.0, 50.0, 0.0)))) for k in range(50)}


@pytest.mark.parametrize("reach,bearing", [(40.0, 30.0), (90.0, 5.0)])
def test_matched_pairs_are_mutual_nearest(spark, reach, bearing):
    r = random.Random(int(reach))
    refs, roads = made(r, 60, 150), made(r, 60, 150)
    a, b = sorted(set(refs)), sorted(set(roads))
    key = lambda s: (*s[1:], s[0])
    mid = lambda s: (s[1] + s[3] / 2, s[2] + s[4] / 2)

    def rank(s, t):
        (x, y), (u, v) = mid(s), mid(t)
        q = (x - u) ** 2 + (y - v) ** 2
        cross, dot = s[3] * t[4] - s[4] * t[3], s[3] * t[3] + s[4] * t[4]
        return q if q <= reach * reach and abs(cross) <= abs(dot) * math.tan(math.radians(bearing)) and any(s[3:]) and any(t[3:]) else None

    nearest = lambda s, others, flip: min(((rank(*((t, s) if flip else (s, t))), key(t), t) for t in others if rank(*((t, s) if flip else (s, t))) is not None), default=(None, None, None))[2]
    want = sorted((s, t) for s in a if (t := nearest(s, b, False)) and nearest(t, a, True) == s)
    got = matching.matched_pairs(spark.createDataFrame(refs, SCHEMA), spark.createDataFrame(roads, SCHEMA), reach, bearing)
    names = ("class", *gaps.SEGMENT)
    assert sorted((tuple(x[f"r_{n}"] for n in names), tuple(x[f"m_{n}"] for n in names)) for x in got.collect()) == want and len(want) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def polygons(spark, *shapes):
    data = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in enumerate(shapes)]
    return spark.createDataFrame(data, "tid int, rings array<array<struct<x:double,y:double>>>")


def box(x0, x1, y0, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_snapped_parts_share_no_edge(spark):
    got = {
        x.tid: (x.area, x.n, x.n_rings)
        for x in gaps.snapped_polygons(polygons(spark, [box(0, 10, 0, 10), box(12, 20, 0, 10)], [box(0, 2, 0, 2)], [box(0, 20, 0, 20), box(0, 20, 0, 20)], []), 10)
        .select("tid", "n_rings", F.size("edges").alias("n"), planar.centroid(F.col("edges"))["area"].alias("area"))
        .collect()
    }
    assert got[0] == (200.0, 6, 2)  # the edge between both parts is gone
    assert got[1][1:] == (0, 0) and got[2] == (0.0, 0, 2) and got[3][1:] == (0, 0)
