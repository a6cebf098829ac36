"""The engine's queries over a data folder, each beside its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, planar
from ..operators import gaps, matching, metres, reports, variants
from ..operators.spatial_join import grid_join
from ..sources import layers, tables, wkb
from ..streaming.incremental import windowed_gap
from . import oracles
from .oracles import gap, lengths, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def _layers(spark: SparkSession, root: str) -> tuple[DataFrame, ...]:
    return tuple(f(spark, root) for f in (tables.tracts, tables.buildings, tables.roads, tables.pois))


def _scores(spark: SparkSession, root: str) -> DataFrame:
    t, b, r, p = _layers(spark, root)
    return gaps.composite(t, b, r, p)


# ---- buildings

_BUILDING = "SELECT tid, region, coalesce(ov_cnt, 0) AS ov_cnt, coalesce(ms_cnt, 0) AS ms_cnt, round({gap}, 6) AS building_gap FROM tract LEFT JOIN c USING (tid)".format(gap=gap("ov_cnt", "ms_cnt"))


def _building(how: str, name: str) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        t, b, *_ = _layers(spark, root)
        return gaps.building_gap(t, b, how).select("tid", "region", "ov_cnt", "ms_cnt", r6("building_gap"))

    run.__name__ = name
    query(over(_BUILDING, f"c AS ({oracles.counts(how)})"))(run)


for _how in ("centroid", "centroid_inside", "intersects", "within"):
    _building(_how, f"building_gap_{_how}")


@query(over("SELECT tid, count(*) AS n_candidates FROM building JOIN tract ON cx - half <= x1 AND cx + half >= x0 AND cy - half <= y1 AND cy + half >= y0 GROUP BY tid"))
def grid_candidate_pairs(spark, root):
    t, b, *_ = _layers(spark, root)
    return gaps.building_pairs(t, b, "intersects").groupBy("tid").agg(F.count(F.lit(1)).alias("n_candidates"))


# ---- roads


@query(over("SELECT tid, coalesce(ov_len, 0) AS ov_len, coalesce(tiger_len, 0) AS tiger_len FROM l", f"l AS ({lengths()})"))
def transport_lengths_rect(spark, root):
    t, _, r, _ = _layers(spark, root)
    return gaps.road_lengths(t, r, touched=True).select("tid", F.round("ov_len", 3).alias("ov_len"), F.round("tiger_len", 3).alias("tiger_len"))


def _l_rings(t: DataFrame) -> DataFrame:
    """A concave polygon in each tract: the square without its upper right quarter."""
    x0, x1, y0, y1 = (F.col(c).cast("double") for c in ("x0", "x1", "y0", "y1"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0))))
    return t.withColumn("rings", F.array(ring))


def _l_shapes(t: DataFrame) -> DataFrame:
    """The same as edges; the ring is counterclockwise."""
    return _l_rings(t).withColumn("edges", planar.edges(F.col("rings"))).drop("rings")


_TWO = f"""half AS (SELECT *, x0 + 10000 AS xm, y0 + 10000 AS ym FROM tract),
both_ AS (({lengths(tracts="half", box=("x0", "x1", "y0", "ym"), digits=9)}) UNION ALL ({lengths(tracts="half", box=("x0", "xm", "ym", "y1"), digits=9, keep="NOT (dy = 0 AND ay = ym)")}))"""


@query(over("SELECT tid, round(sum(ov_len), 2) AS ov_len, round(sum(tiger_len), 2) AS tiger_len FROM both_ GROUP BY tid HAVING sum(ov_len) + sum(tiger_len) > 0", _TWO))
def transport_lengths_polygon(spark, root):
    t, _, r, _ = _layers(spark, root)
    out = gaps.polygon_lengths(_l_shapes(t), r).where(F.col("ov_len") + F.col("tiger_len") > 0)
    return out.select("tid", F.round("ov_len", 2).alias("ov_len"), F.round("tiger_len", 2).alias("tiger_len"))


_TRANSPORT = "SELECT tid, region, coalesce(ov_len, 0) AS ov_len, coalesce(tiger_len, 0) AS tiger_len, coalesce(tiger_len, 0) > 0 AS transport_defined, round({gap}, 6) AS transport_gap FROM tract LEFT JOIN l USING (tid)".format(gap=gap("ov_len", "tiger_len"))


@query(over(_TRANSPORT, f"l AS ({lengths()})"))
def transport_gap(spark, root):
    t, _, r, _ = _layers(spark, root)
    return gaps.transport_gap(t, r, None).select("tid", "region", "ov_len", "tiger_len", planar.defined(F.col("tiger_len")).alias("transport_defined"), r6("transport_gap"))


@query(over(_TRANSPORT.replace("SELECT tid", "SELECT class, tid").replace("FROM tract LEFT JOIN l USING (tid)", "FROM (SELECT * FROM tract, (VALUES ('primary'), ('secondary'), ('residential')) c(class)) t LEFT JOIN l USING (tid, class)"), "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, * FROM ({lengths(where=f"class = '{c}'")})" for c in ("primary", "secondary", "residential")) + ")"))
def transport_gap_by_class(spark, root):
    t, _, r, _ = _layers(spark, root)
    out = gaps.transport_gap_by_class(t, r, ("primary", "secondary", "residential"))
    return out.select("class", "tid", "region", "ov_len", "tiger_len", planar.defined(F.col("tiger_len")).alias("transport_defined"), r6("transport_gap"))


# ---- places and the composite


@query(over(f"SELECT tid, kind, mapped, ref, round({gap('mapped', 'ref')}, 6) AS gap FROM (SELECT tid, kind, count(*) FILTER (WHERE in_mapped) AS mapped, count(*) FILTER (WHERE in_ref) AS ref FROM poi GROUP BY tid, kind)"))
def poi_gap_by_type(spark, root):
    return gaps.poi_counts(tables.pois(spark, root)).withColumn("gap", F.round(planar.ratio_gap(F.col("mapped"), F.col("ref")), 6))


@query(over("SELECT tid, round(poi_gap_fire, 6) AS poi_gap_fire, round(poi_gap_ems, 6) AS poi_gap_ems, round(poi_gap_schools, 6) AS poi_gap_schools, round(facilities_half, 6) AS facilities_half, round(poi_gap, 6) AS poi_gap FROM score", measures=True))
def poi_gap(spark, root):
    t, _, _, p = _layers(spark, root)
    return gaps.poi_gap(t, p).select("tid", *(r6(c) for c in ("poi_gap_fire", "poi_gap_ems", "poi_gap_schools", "facilities_half", "poi_gap")))


@query(over("SELECT tid, cbp_estab, coalesce(places, 0) AS places, round(establishments_half, 6) AS establishments_half FROM score LEFT JOIN poi_wide USING (tid)", measures=True))
def establishments_gap(spark, root):
    t, _, _, p = _layers(spark, root)
    return gaps.poi_gap(t, p).select("tid", "cbp_estab", F.coalesce("places", F.lit(0)).alias("places"), r6("establishments_half"))


_GAPS = ("transport_gap", "building_gap", "poi_gap", "coverage_gap_score")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _GAPS)


@query(over(f"SELECT tid, region, {_ROUND}, CAST(k AS INT) AS k FROM score", measures=True))
def composite_score(spark, root):
    return _scores(spark, root).select("tid", "region", *(r6(c) for c in _GAPS), "k")


@query(over("SELECT region, count(*) FILTER (WHERE k = 3) AS k3, count(*) FILTER (WHERE k = 2) AS k2, count(*) FILTER (WHERE k = 1) AS k1, count(*) FILTER (WHERE k = 0) AS k0, round(avg(CAST(k < 3 AS INT)), 6) AS undefined_share FROM score GROUP BY region", measures=True))
def defined_k_distribution(spark, root):
    k = F.col("k")
    return _scores(spark, root).groupBy("region").agg(*(F.count_if(k == n).alias(f"k{n}") for n in (3, 2, 1, 0)), F.round(F.avg((k < 3).cast("int")), 6).alias("undefined_share"))


@query(over("SELECT region, count(coverage_gap_score) AS n, round(avg(coverage_gap_score), 6) AS mean, round(stddev_samp(coverage_gap_score), 6) AS std, round(min(coverage_gap_score), 6) AS min, round(max(coverage_gap_score), 6) AS max FROM score GROUP BY region", measures=True))
def region_rollup(spark, root):
    return reports.describe(_scores(spark, root), "region", "coverage_gap_score").select("region", "n", *(r6(c) for c in ("mean", "std", "min", "max")))


_QUANTILES = "quantile_cont(coverage_gap_score, 0.25) AS q1, median(coverage_gap_score) AS median, quantile_cont(coverage_gap_score, 0.75) AS q3"


@query(over(f"SELECT region, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM (SELECT region, count(coverage_gap_score) AS n, {_QUANTILES} FROM score GROUP BY region)", measures=True))
def region_describe(spark, root):
    return reports.describe(_scores(spark, root), "region", "coverage_gap_score").select("region", "n", r6("q1"), r6("median"), r6("q3"))


@query(over(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT round({c}, 6)) AS distinct, count(*) FILTER (WHERE {c} = 0) AS zeros FROM score" for c in _GAPS), measures=True).replace("AS distinct", 'AS "distinct"'))
def null_profile(spark, root):
    return reports.null_profile(_scores(spark, root).select(*(r6(c) for c in _GAPS)), _GAPS)


@query(over("SELECT region, count(*) AS n FROM tract GROUP BY region"))
def value_counts(spark, root):
    return reports.value_counts(tables.tracts(spark, root), "region")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_keys(spark, root):
    return reports.duplicate_keys(tables.read(spark, root, "lineitem"), "l_orderkey", "l_linenumber")


@query(over("SELECT * FROM (SELECT round(transport_gap, 2) AS t, round(building_gap, 2) AS b, k, count(*) AS n FROM (SELECT transport_gap, building_gap, CAST(k AS INT) AS k FROM score) WHERE transport_gap IS NOT NULL AND building_gap IS NOT NULL GROUP BY 1, 2, 3) ORDER BY n DESC, t, b, k LIMIT 5", measures=True))
def top_identical_groups(spark, root):
    s = _scores(spark, root).select(F.round("transport_gap", 2).alias("t"), F.round("building_gap", 2).alias("b"), "k")
    return reports.top_groups(s, ["t", "b", "k"])


# ---- validation


@query(over("SELECT region, count(*) AS n, round(avg(CAST((building_gap IS NOT NULL) = (transport_gap IS NOT NULL) AS INT)), 6) AS match_rate FROM score GROUP BY region", measures=True))
def flag_match_rate(spark, root):
    out = reports.match_rate(_scores(spark, root), "region", F.col("building_gap").isNotNull(), F.col("transport_gap").isNotNull())
    return out.select("region", "n", r6("match_rate"))


_TARGETS = {"transport_gap": 0.25, "building_gap": 0.1, "poi_gap": 0.2, "coverage_gap_score": 0.2}


@query(over(" UNION ALL ".join(f"SELECT '{c}' AS component, round(t, 4) AS total, round({v} * n, 4) AS expected, round(t - {v} * n, 4) AS diff, abs(t - {v} * n) < 0.5e-6 * n AS within FROM (SELECT coalesce(sum({c}), 0) AS t, CAST(count(*) AS DOUBLE) AS n FROM score)" for c, v in _TARGETS.items()), measures=True))
def placeholder_validation(spark, root):
    out = reports.placeholder_check(_scores(spark, root), _TARGETS)
    return out.select("component", *(F.round(c, 4).alias(c) for c in ("total", "expected", "diff")), "within")


@query(over("""SELECT unnest(['key_width', 'key_digits', 'key_unique', 'no_nulls', 'in_range', 'row_count', 'leading_zero', 'six_places', 'not_constant']) AS check_name,
  unnest([bool_and(length(g) = 11), bool_and(regexp_matches(g, '^[0-9]+$')), count(g) = count(DISTINCT g), count(*) FILTER (WHERE g IS NULL OR s IS NULL) = 0, bool_and(s BETWEEN 0 AND 1), count(*) = (SELECT count(*) FROM tract), bool_or(starts_with(g, '0')), bool_and(abs(s * 1e6 - round(s * 1e6)) < 1e-3), min(s) < max(s)]) AS ok
  FROM (SELECT lpad(CAST(tid AS VARCHAR), 11, '0') AS g, round(coverage_gap_score, 6) AS s FROM score)""", measures=True))
def format_checks(spark, root):
    s = _scores(spark, root).select(F.lpad(F.col("tid").cast("string"), 11, "0").alias("GEOID"), r6("coverage_gap_score"))
    return reports.format_checks(s, "GEOID", "coverage_gap_score", tables.read(spark, root, "customer", ["c_custkey"]), 11)


@query(over("SELECT count(d) AS n, round(median(d), 6) AS median_diff, round(max(d), 6) AS max_diff, round(avg(CAST(d <= 1e-6 AS INT)), 6) AS exact_share, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS n_undefined_differs FROM (SELECT poi_gap AS a, (poi_gap_fire + poi_gap_ems + poi_gap_schools) / 3 AS b, abs(poi_gap - (poi_gap_fire + poi_gap_ems + poi_gap_schools) / 3) AS d FROM score)", measures=True))
def formula_consistency(spark, root):
    t, _, _, p = _layers(spark, root)
    g = gaps.poi_gap(t, p)
    out = reports.consistency(g, F.col("poi_gap"), (F.col("poi_gap_fire") + F.col("poi_gap_ems") + F.col("poi_gap_schools")) / 3, 1e-6)
    return out.select("n", r6("median_diff"), r6("max_diff"), r6("exact_share"), "n_undefined_differs")


_PARTS = ", ".join(f"round({c}, 6) AS {c}" for c in _GAPS[:3])


@query(over(f"""SELECT count(d) AS n, round(median(d), 8) AS median_diff, round(max(d), 8) AS max_diff, round(avg(CAST(d <= 1e-6 AS INT)), 6) AS exact_share, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS n_undefined_differs FROM (SELECT a, b, abs(a - b) AS d FROM (
  SELECT a, (coalesce(transport_gap, 0) + coalesce(building_gap, 0) + coalesce(poi_gap, 0)) / nullif(k, 0) AS b FROM (SELECT round(coverage_gap_score, 6) AS a, k, {_PARTS} FROM score)))""", measures=True))  # fmt: skip
def composite_consistency(spark, root):
    """The published score against the mean of the published components."""
    s = _scores(spark, root).select(*(r6(c) for c in _GAPS))
    out = reports.consistency(s, F.col("coverage_gap_score"), planar.mean_of_defined(*(F.col(c) for c in _GAPS[:3])), 1e-6)
    return out.select("n", F.round("median_diff", 8).alias("median_diff"), F.round("max_diff", 8).alias("max_diff"), r6("exact_share"), "n_undefined_differs")


@query(over("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT round({c}, 6)) AS \"distinct\", count(*) FILTER (WHERE {c} = 0) AS zeros FROM score" for c in _GAPS) + ") WHERE nulls > 0", measures=True))
def undefined_columns(spark, root):
    return reports.null_profile(_scores(spark, root).select(*(r6(c) for c in _GAPS)), _GAPS, only_nulls=True)


@query(over("SELECT 'only_left' AS side, (SELECT count(*) FROM tract WHERE tid NOT IN (SELECT tid FROM poi)) AS n UNION ALL SELECT 'only_right', (SELECT count(DISTINCT tid) FROM poi WHERE tid NOT IN (SELECT tid FROM tract))"))
def key_set_difference(spark, root):
    return reports.missing_keys(tables.tracts(spark, root), tables.pois(spark, root), "tid")


# ---- equity

_STRATA = {"rural": "rural", "tribal": "tribal", "high_svi": "svi > 5000"}


def _disparity_sql(value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS stratum, round(i, 6) AS mean_in, round(o, 6) AS mean_out, round(i / o, 6) AS ratio, round((i / o - 1) * 100, 4) AS pct_larger FROM (SELECT avg({value}) FILTER (WHERE {c}) AS i, avg({value}) FILTER (WHERE NOT ({c})) AS o FROM score)" for n, c in _STRATA.items())


def _disparity(scores: DataFrame, value: str) -> DataFrame:
    out = reports.disparity(scores, value, {n: F.expr(c) for n, c in _STRATA.items()})
    return out.select("stratum", r6("mean_in"), r6("mean_out"), r6("ratio"), F.round("pct_larger", 4).alias("pct_larger"))


@query(over(_disparity_sql("coverage_gap_score"), measures=True))
def disparity_ratio(spark, root):
    return _disparity(_scores(spark, root), "coverage_gap_score")


@query(over(" UNION ALL ".join(f"SELECT '{c}' AS component, * FROM ({_disparity_sql(c)})" for c in _GAPS[:3]), measures=True))
def component_disparity(spark, root):
    out = reports.disparities(_scores(spark, root), _GAPS[:3], {n: F.expr(c) for n, c in _STRATA.items()})
    return out.select("component", "stratum", r6("mean_in"), r6("mean_out"), r6("ratio"), F.round("pct_larger", 4).alias("pct_larger"))


@query(over("SELECT CAST(1 + CAST(svi > a AS INT) + CAST(svi > b AS INT) + CAST(svi > c AS INT) AS INT) AS quartile, rural, count(*) AS n, round(avg(coverage_gap_score), 6) AS mean FROM score, (SELECT quantile_cont(svi, 0.25) AS a, quantile_cont(svi, 0.5) AS b, quantile_cont(svi, 0.75) AS c FROM score) GROUP BY 1, 2", measures=True))
def svi_quartile_rural(spark, root):
    q = reports.quartiles(_scores(spark, root), "svi", "tid")
    return q.groupBy("quartile", "rural").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage_gap_score"), 6).alias("mean"))


@query(over("SELECT region, round(avg(CAST(coverage_gap_score = 0 AS INT)), 6) AS zero_share, round(avg(CAST(coverage_gap_score = 1 AS INT)), 6) AS one_share FROM score GROUP BY region", measures=True))
def zero_one_share(spark, root):
    s = F.col("coverage_gap_score")
    return _scores(spark, root).groupBy("region").agg(F.round(F.avg((s == 0).cast("int")), 6).alias("zero_share"), F.round(F.avg((s == 1).cast("int")), 6).alias("one_share"))


@query(over("SELECT tid, county, round((sum(g) OVER w - coalesce(g, 0)) / nullif(count(g) OVER w - CAST(g IS NOT NULL AS INT), 0), 6) AS others_mean FROM (SELECT tid, county, coverage_gap_score AS g FROM score) WINDOW w AS (PARTITION BY county)", measures=True))
def county_leave_one_out(spark, root):
    return reports.leave_one_out(_scores(spark, root), "county", "coverage_gap_score", "others_mean").select("tid", "county", r6("others_mean"))


@query(over("SELECT region, round(avg(coverage_gap_score), 6) AS mean_defined, round(avg((coalesce(transport_gap, 1) + coalesce(building_gap, 1) + coalesce(poi_gap, 1)) / 3), 6) AS mean_bound, count(*) FILTER (WHERE k < 3) AS n_flagged FROM score GROUP BY region", measures=True))
def undefined_as_gap_bound(spark, root):
    bound = sum(F.coalesce(c, F.lit(1.0)) for c in _GAPS[:3]) / 3
    return _scores(spark, root).groupBy("region").agg(F.round(F.avg("coverage_gap_score"), 6).alias("mean_defined"), F.round(F.avg(bound), 6).alias("mean_bound"), F.count_if(F.col("k") < 3).alias("n_flagged"))


# ---- projections

_DEGREES = "deg AS (SELECT *, -100e0 + ax / 1e6 AS lon1, 30e0 + ay / 1e6 AS lat1, -100e0 + (ax + dx) / 1e6 AS lon2, 30e0 + (ay + dy) / 1e6 AS lat2 FROM road)"


def _length_sql(code: str) -> str:
    ends = oracles.both_ends("deg", code, "class")
    return over(f"SELECT class, count(*) AS n, round(sum(sqrt(power(px2 - px1, 2) + power(py2 - py1, 2))), 2) AS metres, round(min(px1), 4) AS x_min, round(max(py2), 4) AS y_max FROM ({ends}) GROUP BY class", _DEGREES, oracles.CONES)


def _total(c: F.Column) -> F.Column:
    """A sum that is the same in any order to about the last bit of its result: whole parts are summed as integers."""
    return F.sum(F.floor(c)) + F.sum(c - F.floor(c))


def _projected_length(spark: SparkSession, root: str, projection) -> DataFrame:
    p = variants.projected(variants.degrees(tables.roads(spark, root)), projection)
    metres = planar.length(F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1"))
    return p.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(_total(metres), 2).alias("metres"), F.round(F.min("px1"), 4).alias("x_min"), F.round(F.max("py2"), 4).alias("y_max"))


@query(_length_sql("5070"))
def albers_project(spark, root):
    return _projected_length(spark, root, crs.EPSG5070.expressions)


@query(_length_sql("102003"))
def albers_contiguous_project(spark, root):
    return _projected_length(spark, root, crs.ESRI102003.expressions)


@query(_length_sql("3857"))
def mercator_project(spark, root):
    return _projected_length(spark, root, crs.mercator)


_CLIPPED = "SELECT tid, round(sum(CASE WHEN mapped THEN m ELSE 0 END), 3) AS ov_len, round(sum(CASE WHEN mapped THEN 0 ELSE m END), 3) AS tiger_len FROM (SELECT tid, mapped, sqrt(power(px2 - px1, 2) + power(py2 - py1, 2)) AS m FROM ends) GROUP BY tid"


@query(over(_CLIPPED, f"cut AS ({oracles.clipped()})", oracles.CONES, f"ends AS ({oracles.both_ends('cut', '5070', 'tid, mapped')})"))
def clip_then_project(spark, root):
    t, _, r, _ = _layers(spark, root)
    out = variants.clipped_then_projected(t, r, crs.EPSG5070.expressions)
    return out.select("tid", F.round("ov_len", 3).alias("ov_len"), F.round("tiger_len", 3).alias("tiger_len"))


_SHIFT = {name: crs.shifted("lon", "lat", s) for name, s in crs.SHIFTS.items()}
_POINTS = "pt AS (SELECT tid, -100e0 + x0 / 1e6 AS lon, 30e0 + y0 / 1e6 AS lat FROM tract)"


_SHIFTED = oracles.moved(f"(SELECT tid, lon, lat, shift FROM pt, (SELECT unnest({list(_SHIFT)!r}) AS shift))", "tid, shift AS op")


@query(over("SELECT tid, op, round(px, 3) AS x, round(py, 3) AS y FROM flat", _POINTS, oracles.CONES, f"there AS ({_SHIFTED})", f"flat AS ({oracles.planar_of('there', "'5070'")})"))
def datum_shift_project(spark, root):
    pt = tables.tracts(spark, root).select("tid", (F.lit(-100.0) + F.col("x0") / 1e6).alias("lon"), (F.lit(30.0) + F.col("y0") / 1e6).alias("lat"))
    out = None
    x, y = crs.EPSG5070.expressions("lon2", "lat2")
    for name, (lon, lat) in _SHIFT.items():
        own = pt.select("tid", F.lit(name).alias("op"), F.expr(lon).alias("lon2"), F.expr(lat).alias("lat2")).select("tid", "op", F.round(F.expr(x), 3).alias("x"), F.round(F.expr(y), 3).alias("y"))
        out = own if out is None else out.unionByName(own)
    return out


@query(over(f"SELECT class, mapped, count(*) AS n, round(sum(metres), 2) AS metres FROM ({oracles.geodesic_of('deg')}) GROUP BY class, mapped", _DEGREES))
def geodesic_length(spark, root):
    out = variants.geodesic(variants.degrees(tables.roads(spark, root)))
    return out.groupBy("class", "mapped").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metres"), 2).alias("metres"))


# ---- polygons


@query(over("SELECT tid, round(x0 + 25e4 / 30, 3) AS cx, round(y0 + 25e4 / 30, 3) AS cy, 3e8 AS area FROM tract"))
def polygon_centroid(spark, root):
    c = _l_shapes(tables.tracts(spark, root)).select("tid", planar.centroid(F.col("edges")).alias("c"))
    return c.select("tid", F.round("c.x", 3).alias("cx"), F.round("c.y", 3).alias("cy"), F.col("c.area").alias("area"))


@query(over("SELECT tid, count(*) AS n_inside FROM building JOIN tract ON (cx > x0 AND cx < x1 AND cy > y0 AND cy < y0 + 10000) OR (cx > x0 AND cx < x0 + 10000 AND cy > y0 AND cy < y1) GROUP BY tid"))
def point_in_polygon(spark, root):
    t, b, *_ = _layers(spark, root)
    shapes = _l_shapes(t).select("tid", "edges", "x0", "x1", "y0", "y1")
    inside = planar.contains(F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("edges"))
    return grid_join(b, shapes, ("cx", "cx", "cy", "cy"), ("x0", "x1", "y0", "y1"), gaps.CELL, inside).groupBy("tid").agg(F.count(F.lit(1)).alias("n_inside"))


def _footprints(b: DataFrame) -> DataFrame:
    cx, cy, half = (F.col(c) for c in ("cx", "cy", "half"))
    rings = planar.rectangle(cx - half, cx + half, cy - half, cy + half)
    return gaps.with_edges(b.select("bid", "in_mapped", "in_ref", rings.alias("rings")))


_COUNTED = "SELECT tid, count(*) FILTER (WHERE in_mapped) AS ov_cnt, count(*) FILTER (WHERE in_ref) AS ms_cnt FROM building JOIN tract ON "


@query(over(_COUNTED + "cx - half <= x1 AND cx + half >= x0 AND cy - half <= y1 AND cy + half >= y0 AND (cx - half <= x0 + 10000 OR cy - half <= y0 + 10000) GROUP BY tid"))
def footprints_intersect_polygon(spark, root):
    t, b, *_ = _layers(spark, root)
    return gaps.footprint_counts(_l_shapes(t), _footprints(b), "intersects")


@query(over(_COUNTED + "cx - half >= x0 AND cx + half <= x1 AND cy - half >= y0 AND cy + half <= y1 AND (cx + half <= x0 + 10000 OR cy + half <= y0 + 10000) GROUP BY tid"))
def footprints_in_polygon(spark, root):
    t, b, *_ = _layers(spark, root)
    return gaps.footprint_counts(_l_shapes(t), _footprints(b), "covers")


_PLACES = ("fire_department", "ambulance_and_ems_services", "elementary_school", "private_school", "restaurant", None)
_IN_L = "(cx > x0 AND cx < x1 AND cy > y0 AND cy < y0 + 10000) OR (cx > x0 AND cx < x0 + 10000 AND cy > y0 AND cy < y1)"


@query(over(f"SELECT tid, CASE bid % 6 WHEN 0 THEN 'fire' WHEN 1 THEN 'ems' WHEN 2 THEN 'schools' WHEN 3 THEN 'schools' ELSE 'other' END AS kind, count(*) FILTER (WHERE in_mapped) AS mapped, count(*) FILTER (WHERE in_ref) AS ref FROM building JOIN tract ON {_IN_L} GROUP BY 1, 2"))
def places_by_category(spark, root):
    """Buildings as places: the polygon that holds each, and its kind by category."""
    t, b, *_ = _layers(spark, root)
    category = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("bid") % 6 + 1).cast("int"))
    places = b.select(F.col("cx").cast("double").alias("px"), F.col("cy").cast("double").alias("py"), category.alias("category"), "in_mapped", "in_ref")
    placed = gaps.placed(_l_shapes(t), places).withColumn("kind", F.coalesce(gaps.kind_of(F.col("category")), F.lit("other")))
    return gaps.poi_counts(placed)


@query(over("SELECT tid, -100e0 + x0 / 1e6 AS xmin, -100e0 + x1 / 1e6 AS xmax, 30e0 + y0 / 1e6 AS ymin, 30e0 + y1 / 1e6 AS ymax FROM tract"))
def geometry_boxes(spark, root):
    x0, x1, y0, y1 = (F.lit(variants.ORIGIN["xy".index(c[0])]) + F.col(c) / 1e6 for c in ("x0", "x1", "y0", "y1"))
    boxed = tables.tracts(spark, root).withColumn("rings", planar.rectangle(x0, x1, y0, y1)).select("tid", planar.box_of_rings(F.col("rings")).alias("box"))
    return boxed.select("tid", *(F.col(f"box.{c}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))


@query(over("SELECT tid, round(x0 + 25e4 / 30, 3) AS cx, round(y0 + 25e4 / 30, 3) AS cy, 3e8 AS area, 6 AS n_edges FROM tract"))
def polygons_from_wkb(spark, root):
    """Polygons as well-known binary in a kept layer, and read back from it; the layer keeps their reference system."""
    t = tables.tracts(spark, root)
    rings = _l_rings(t).select("tid", "rings")
    stored = layers.kept("tract-wkb", [t], lambda: wkb.with_wkb(crs.tagged(rings, ("rings",), "micro"), "rings"))
    read = gaps.with_edges(wkb.with_rings(stored, "rings"))
    assert crs.code_of(read, "x0") == "micro"
    out = read.select("tid", planar.centroid(F.col("edges")).alias("c"), F.size("edges").alias("n_edges"))
    return out.select("tid", F.round("c.x", 3).alias("cx"), F.round("c.y", 3).alias("cy"), F.col("c.area").alias("area"), "n_edges")


def _slit(t: DataFrame) -> DataFrame:
    """Squares off the grid with a slit from above and a hole; both may be narrower than the grid."""
    k = F.col("tid")
    x0, x1, y0, y1 = (F.col(c).cast("double") + F.expr(f"tid % {m}") for c, m in (("x0", 10), ("x1", 7), ("y0", 3), ("y1", 9)))
    xm, ym, w = F.col("x0") + 10_000.0, F.col("y0") + 10_000.0, (k % 9 + 2).cast("double")
    hx, hy, h = F.col("x0") + 2000.0, F.col("y0") + 2000.0, (k % 8 + 1).cast("double")
    one = lambda *p: F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in p))
    outer = one((x0, y0), (x1, y0), (x1, y1), (xm + w, y1), (xm + w, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0))
    hole = one((hx, hy), (hx, hy + h), (hx + h, hy + h), (hx + h, hy), (hx, hy))
    return t.select("tid", F.array(outer, hole).alias("rings"))


_on_ten = "round_even(({}) / 10e0, 0) * 10".format


@query(over("""SELECT tid, (a1 - a0) * (b1 - b0) - slit * (b1 - ym) - hole * hole AS area, CASE WHEN hole > 0 THEN 2 ELSE 1 END AS n_rings,
  CASE WHEN slit > 0 THEN 8 ELSE 5 END + CASE WHEN hole > 0 THEN 4 ELSE 0 END AS n_edges FROM snapped""",
  f"""snapped AS (SELECT tid, y0 + 10000e0 AS ym, {_on_ten("x0 + tid % 10")} AS a0, {_on_ten("x1 + tid % 7")} AS a1, {_on_ten("y0 + tid % 3")} AS b0, {_on_ten("y1 + tid % 9")} AS b1,
  {_on_ten("tid % 9 + 2")} AS slit, {_on_ten("tid % 8 + 1")} AS hole FROM tract)"""))  # fmt: skip
def snap_polygons(spark, root):
    """Polygons on a grid of 10: slits and holes that close are gone."""
    out = gaps.snapped_polygons(_slit(tables.tracts(spark, root)), 10.0)
    return out.select("tid", planar.centroid(F.col("edges"))["area"].alias("area"), "n_rings", F.size("edges").alias("n_edges"))


@query("SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) - 1 AS last_row FROM customer")
def row_ids(spark, root):
    c = tables.with_row_ids(tables.read(spark, root, "customer", ["c_custkey", "_metadata"]))
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file", "row").alias("n_ids"), F.max("row").alias("last_row"))


# ---- variants


@query(over("SELECT class, count(*) AS n_roads, CAST(sum(greatest(1, ceil(sqrt(dx * dx + dy * dy) / 5000))) AS BIGINT) AS n_parts, round(sum(sqrt(dx * dx + dy * dy)), 2) AS length FROM road GROUP BY class"))
def segmentize_roads(spark, root):
    parts = variants.segmentize(tables.roads(spark, root), 5000)
    return parts.groupBy("class").agg(F.count_if(F.col("part") == 0).alias("n_roads"), F.count(F.lit(1)).alias("n_parts"), F.round(F.sum(planar.length(F.col("dx"), F.col("dy"))), 2).alias("length"))


def _snap(grid: int) -> str:
    s = lambda x: f"round_even(CAST({x} AS DOUBLE) / {grid}, 0) * {grid}"
    return f"SELECT rid, mapped, class, {s('ax')} AS ax, {s('ay')} AS ay, {s('ax + dx')} - {s('ax')} AS dx, {s('ay + dy')} - {s('ay')} AS dy FROM road"


@query(over("SELECT class, count(*) AS n, CAST(sum(ax) AS BIGINT) AS sum_ax, CAST(sum(dy) AS BIGINT) AS sum_dy FROM s WHERE dx <> 0 OR dy <> 0 GROUP BY class", f"s AS ({_snap(1000)})"))
def snap_grid(spark, root):
    s = variants.snap_roads(tables.roads(spark, root), 1000)
    return s.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("ax").cast("long").alias("sum_ax"), F.sum("dy").cast("long").alias("sum_dy"))


def _variant_sql(v: variants.Variant) -> str:
    """One variant's gaps; densifying changes no total, so the whole segments stand for their parts."""
    roads = f"(SELECT * FROM ({_snap(int(v.snap_roads))}) WHERE dx <> 0 OR dy <> 0)" if v.snap_roads else "road"
    tract = "tract"
    if v.snap_tracts:
        s = lambda c: f"round_even(CAST({c} AS DOUBLE) / {int(v.snap_tracts)}, 0) * {int(v.snap_tracts)} AS {c}"
        tract = f"(SELECT tid, {', '.join(map(s, ('x0', 'x1', 'y0', 'y1')))} FROM tract)"
    own = lengths(roads, tract, "class = 'primary'", 3 if v.round_lengths is None else v.round_lengths)
    return f"SELECT '{v.name}' AS variant, tid, region, {gap('ov_len', 'tiger_len')} AS transport_gap FROM tract LEFT JOIN ({own}) USING (tid)"


_SWEPT = "swept AS MATERIALIZED (" + " UNION ALL ".join(map(_variant_sql, variants.SWEEP)) + ")"
_SUMS = "sums AS (SELECT variant, count(transport_gap) AS n_defined, coalesce(CAST(sum(CAST(round(transport_gap * 1e6) AS BIGINT)) AS BIGINT), 0) AS total FROM swept GROUP BY variant)"


def _swept(spark: SparkSession, root: str) -> DataFrame:
    """The sweep as a kept layer, which the queries over it share."""
    t, _, r, _ = _layers(spark, root)
    return layers.kept("variant-sweep", [t, r], lambda: variants.sweep(t, r), settings=[str(v) for v in variants.SWEEP])


@query(over("SELECT variant, n_defined, total / 1e6 AS total, (total - (SELECT total FROM sums WHERE variant = 'base')) / 1e6 AS diff FROM sums", _SWEPT, _SUMS))
def variant_sweep(spark, root):
    return variants.totals(_swept(spark, root))


@query(over("SELECT tid, round(max(g) - min(g), 6) AS spread, count(g) AS n_defined FROM (SELECT tid, round(transport_gap, 6) AS g FROM swept) GROUP BY tid HAVING count(g) > 0 ORDER BY spread DESC, tid LIMIT 10", _SWEPT))
def variant_spread_topk(spark, root):
    return variants.spread(_swept(spark, root))


@query(over("SELECT tid, " + ", ".join(f"max(round(transport_gap, 6)) FILTER (WHERE variant = '{v.name}') AS {v.name}" for v in variants.SWEEP) + " FROM swept GROUP BY tid", _SWEPT))
def variant_pivot(spark, root):
    return variants.pivot(_swept(spark, root))


_KNOWN = {5: 0.0, 17: 0.0, 40: 0.5, 100: 0.25}


@query(over("SELECT variant, tid, round(transport_gap, 6) AS transport_gap, round(transport_gap - v, 6) AS diff FROM swept JOIN (VALUES " + ", ".join(f"({k}, {v}e0)" for k, v in _KNOWN.items()) + ") known(k, v) ON k = tid WHERE abs(transport_gap - v) < 0.25", _SWEPT))
def variant_hits(spark, root):
    return variants.hits(_swept(spark, root), _KNOWN, 0.25).select("variant", "tid", r6("transport_gap"), r6("diff"))


# ---- lengths in metres before the clip


def _in_metres(spark: SparkSession, root: str, settings: tuple[metres.Setting, ...]) -> DataFrame:
    t, _, r, _ = _layers(spark, root)
    return metres.transport(metres.degree_rings(t), metres.degree_ends(r), settings)


@query(over("SELECT tid, region, ov_len, tiger_len, tiger_len > 0 AS transport_defined, round(transport_gap, 6) AS transport_gap FROM metre_gap", oracles.metre_gaps((metres.BASE,))))
def transport_gap_projected(spark, root):
    """Roads and tracts projected vertex by vertex, then clipped and measured."""
    out = _in_metres(spark, root, (metres.BASE,))
    return out.select("tid", "region", "ov_len", "tiger_len", planar.defined(F.col("tiger_len")).alias("transport_defined"), r6("transport_gap"))


_MEAN, _WITHIN = 0.3, 0.0062
_RANKED = f"""SELECT *, abs(diff) < {_WITHIN}e0 * n AS hit FROM (SELECT *, round(total - {_MEAN}e0 * n, 6) AS diff FROM (
  SELECT variant, count(*) AS n, count(transport_gap) AS n_defined, coalesce(CAST(sum(CAST(round(transport_gap * 1e6) AS BIGINT)) AS BIGINT), 0) / 1e6 AS total FROM metre_gap GROUP BY variant))"""


@query(over(_RANKED, oracles.metre_gaps(metres.TRANSPORT)))
def transport_sweep(spark, root):
    """Fourteen settings of precision, projection and density, nearest to a known mean first."""
    return metres.ranked(_in_metres(spark, root, metres.TRANSPORT), _MEAN, _WITHIN)


@query(over(_RANKED, oracles.metre_gaps(metres.DATUM)))
def datum_sweep(spark, root):
    """Datum operations applied to each vertex, through to the gap."""
    return metres.ranked(_in_metres(spark, root, metres.DATUM), _MEAN, _WITHIN)


@query(over(oracles.deltas(), oracles.metre_gaps(metres.PRECISION)))
def precision_sweep(spark, root):
    """Precision grids in metres and degrees, and the tracts that each changes."""
    return metres.deltas(_in_metres(spark, root, metres.PRECISION)).select("variant", "total", "n_changed", r6("max_delta"))


# ---- error metrics


@query(over("SELECT tid, CAST(k AS INT) AS k, round(transport_gap + k * CASE WHEN tid % 7 = 0 THEN 0.002e0 ELSE 0 END, 6) AS implied FROM score WHERE transport_gap IS NOT NULL", measures=True))
def component_backsolve(spark, root):
    error = F.when(F.col("tid") % 7 == 0, F.lit(0.002)).otherwise(F.lit(0.0))
    s = _scores(spark, root).where(F.col("transport_gap").isNotNull())
    return s.select("tid", "k", F.round(reports.implied_component(F.col("transport_gap"), F.col("k"), error), 6).alias("implied"))


@query(over("SELECT tid, round(s, 6) AS base, round(s + CASE WHEN s > 0.995 THEN -0.01 ELSE 0.01 END, 6) AS perturbed, s > 0.995 AS flipped FROM (SELECT tid, round(coverage_gap_score, 6) AS s FROM score)", measures=True))
def perturb_global(spark, root):
    s = _scores(spark, root).select("tid", F.round("coverage_gap_score", 6).alias("base"))
    return reports.perturb_all(s, "base", 0.01)


_MOVES = {5: 0.001, 17: 0.002}


@query(over("SELECT tid, round(s, 6) AS base, round(s + CASE tid WHEN 5 THEN 0.001 WHEN 17 THEN 0.002 ELSE 0 END, 6) AS perturbed FROM (SELECT tid, round(coverage_gap_score * 0.99, 6) AS s FROM score)", measures=True))
def perturb_single(spark, root):
    s = _scores(spark, root).select("tid", F.round(F.col("coverage_gap_score") * 0.99, 6).alias("base"))
    return reports.perturb_rows(s, "tid", "base", _MOVES).select("tid", "base", r6("perturbed"))


#: Predictions with a known error: the score with transport's gap taken as 0 where it is undefined.
_PRED = "pred AS (SELECT tid, region, coverage_gap_score AS ref, (coalesce(transport_gap, 0) + coalesce(building_gap, 0) + coalesce(poi_gap, 0)) / 3 AS p FROM score)"


def _predictions(spark: SparkSession, root: str) -> DataFrame:
    p = sum(F.coalesce(c, F.lit(0.0)) for c in _GAPS[:3]) / 3
    return _scores(spark, root).select("tid", "region", F.col("coverage_gap_score").alias("ref"), p.alias("p"))


_PROBE = "probe AS (SELECT tid, CASE WHEN tid = 3 THEN 0.004e0 ELSE p - ref END AS e, CASE WHEN tid = 3 THEN 0.004e0 - 0.01e0 ELSE p - ref END AS moved FROM pred)"


def _probe(spark: SparkSession, root: str) -> DataFrame:
    e = F.when(F.col("tid") == 3, F.lit(0.004)).otherwise(F.col("p") - F.col("ref"))
    return _predictions(spark, root).select("tid", e.alias("e"), F.when(F.col("tid") == 3, F.lit(0.004 - 0.01)).otherwise(e).alias("moved"))


@query(over("SELECT round((0.01e0 - n * (b - a)) / 2, 9) AS error, n AS n_rows FROM (SELECT count(*) AS n, avg(abs(e)) AS a, avg(abs(moved)) AS b FROM probe)", _PRED, _PROBE, measures=True))
def mae_decode(spark, root):
    m = _probe(spark, root).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs("e")).alias("a"), F.avg(F.abs("moved")).alias("b"))
    return m.select(F.round(reports.decode_mae(F.col("n_rows"), F.col("a"), F.col("b"), F.lit(0.01)), 9).alias("error"), "n_rows")


@query(over("SELECT round((n * a * a + 1e-4 - n * b * b) / 0.02e0, 7) AS error, n AS n_rows FROM (SELECT count(*) AS n, sqrt(avg(e * e)) AS a, sqrt(avg(moved * moved)) AS b FROM probe)", _PRED, _PROBE, measures=True))
def rmse_decode(spark, root):
    square = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    m = _probe(spark, root).agg(F.count(F.lit(1)).alias("n_rows"), square("e").alias("a"), square("moved").alias("b"))
    return m.select(F.round(reports.decode_rmse(F.col("n_rows"), F.col("a"), F.col("b"), F.lit(0.01)), 7).alias("error"), "n_rows")


@query(over("SELECT count(e) AS n, round(sum(e), 6) AS sum_error, round(sum(abs(e)), 6) AS sum_abs_error, round(max(abs(e)), 6) AS max_abs_error, round(max(abs(e)) / sum(abs(e)), 6) AS max_share FROM (SELECT p - ref AS e FROM pred)", _PRED, measures=True))
def error_budget(spark, root):
    out = reports.error_budget(_predictions(spark, root), "p", "ref")
    return out.select("n", *(r6(c) for c in ("sum_error", "sum_abs_error", "max_abs_error", "max_share")))


@query(over("SELECT region, count(*) AS n, round(avg(abs(p - ref)), 6) AS mae, round(sqrt(avg((p - ref) * (p - ref))), 6) AS rmse, round(corr(p, ref), 6) AS corr, round(regr_r2(ref, p), 6) AS r2, round(avg(p - ref), 6) AS bias FROM pred WHERE ref IS NOT NULL GROUP BY region", _PRED, measures=True))
def regression_metrics(spark, root):
    out = reports.regression_metrics(_predictions(spark, root), "region", "p", "ref")
    return out.select("region", "n", *(r6(c) for c in ("mae", "rmse", "corr", "r2", "bias")))


@query(over("SELECT round(q, 6) AS q_hat, round(avg(CAST(ref BETWEEN greatest(0, p - q) AND least(1, p + q) AS INT)), 6) AS coverage, round(avg(least(1, p + q) - greatest(0, p - q)), 6) AS mean_width FROM pred, (SELECT quantile_cont(abs(p - ref), 0.9) AS q FROM pred) WHERE ref IS NOT NULL GROUP BY q", _PRED, measures=True))
def conformal_interval(spark, root):
    return reports.conformal(_predictions(spark, root), "p", "ref").select(r6("q_hat"), r6("coverage"), r6("mean_width"))


_CASES = {3: 0.004, 4: -0.003, 6: 0.02}


@query(over(" UNION ALL ".join(f"SELECT {k} AS tid, CASE WHEN abs(st) > 0.01e0 + 1e-9 THEN NULL WHEN st >= 0.01e0 - 1e-9 THEN 0 WHEN st <= 1e-9 - 0.01e0 THEN 0.01e0 ELSE round((0.01e0 - st) / 2, 7) END AS error, CASE WHEN abs(st) > 0.01e0 + 1e-9 THEN 'not_one_row' WHEN st >= 0.01e0 - 1e-9 THEN 'at_most' WHEN st <= 1e-9 - 0.01e0 THEN 'at_least' ELSE 'exact' END AS \"case\" FROM (SELECT count(*) * (avg(abs(CASE WHEN tid = {k} THEN {e}e0 - 0.01e0 ELSE p - ref END)) - avg(abs(CASE WHEN tid = {k} THEN {e}e0 ELSE p - ref END))) AS st FROM pred)" for k, e in _CASES.items()), _PRED, measures=True))
def mae_decode_cases(spark, root):
    """Probes of rows whose error lies within the step, below 0 and beyond it: all from one pass."""
    p = _predictions(spark, root)
    own = lambda k, e, d: F.avg(F.abs(F.when(F.col("tid") == k, F.lit(e - d)).otherwise(F.col("p") - F.col("ref"))))
    m = p.agg(F.count(F.lit(1)).alias("n"), *(own(k, e, d).alias(f"m{k}_{w}") for k, e in _CASES.items() for w, d in (("base", 0.0), ("moved", 0.01))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("tid"), reports.decode_mae_case(F.col("n"), F.col(f"m{k}_base"), F.col(f"m{k}_moved"), F.lit(0.01)).alias("c")) for k in _CASES)))
    return m.select(rows.alias("r")).select("r.tid", F.round("r.c.error", 7).alias("error"), F.col("r.c.case").alias("case"))


@query(over("SELECT tid, base, round(base + CASE tid WHEN 5 THEN 0.001 WHEN 17 THEN 0.002 ELSE 0 END, 6) AS perturbed FROM (SELECT tid, CASE WHEN tid = 5 THEN 0.25e0 ELSE round(coverage_gap_score * 0.99, 6) END AS base FROM score)", measures=True))
def perturb_fixed(spark, root):
    s = _scores(spark, root).select("tid", F.round(F.col("coverage_gap_score") * 0.99, 6).alias("base"))
    return reports.fix_and_perturb(s, "tid", "base", {5: 0.25}, _MOVES).select("tid", "base", r6("perturbed"))


@query(over("SELECT tid, round(CASE WHEN x IS NOT NULL THEN greatest(0, x) END, 6) AS proxy FROM (SELECT tid, k - 1 - (building_gap + 2 * transport_gap + CAST(rural AS INT) + poi_gap) / 4 AS x FROM score)", measures=True))
def proxy_formula(spark, root):
    c = F.col
    return _scores(spark, root).select("tid", F.round(reports.proxy(c("building_gap"), c("transport_gap"), c("rural").cast("int"), c("poi_gap"), c("k")), 6).alias("proxy"))


@query(over("SELECT tid, round(coverage_gap_score, 6) AS coverage_gap_score, 'first' AS side FROM (SELECT * FROM score ORDER BY tid LIMIT 5) UNION ALL SELECT tid, round(coverage_gap_score, 6), 'last' FROM (SELECT * FROM score ORDER BY tid DESC LIMIT 5)", measures=True))
def score_preview(spark, root):
    return reports.ends(_scores(spark, root).select("tid", r6("coverage_gap_score")), 5, "tid")


# ---- files

_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
_DESCRIBED = ("region", "nation", "customer", "supplier", "part", "documents", "labels")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in _DESCRIBED))
def describe_tables(spark, root):
    rows = [(t, name, _KINDS.get(kind, kind)) for t in _DESCRIBED for name, kind, _ in tables.schema_report(tables.read(spark, root, t))]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{layers.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_HEADER = "GEOID,coverage_gap_score"


@query(over(f"SELECT '{_HEADER}' AS line, 1 AS n, 0 AS zeros, 0 AS places, 2 AS fields UNION ALL SELECT 'row', count(*), count(*) FILTER (WHERE lpad(CAST(tid AS VARCHAR), 11, '0') LIKE '0%'), 0, 2 FROM tract"))
def export_lines(spark, root):
    """The minimal export as the text that it is: the header, and rows with their leading zeros and places."""
    path = _folder(spark, "export")
    s = _scores(spark, root).select(F.lpad(F.col("tid").cast("string"), 11, "0").alias("GEOID"), "coverage_gap_score")
    tables.export_scores(s, path)
    return tables.line_profile(tables.read_lines(spark, path))


@query(over("SELECT GEOID, region, round(coverage_gap_score, 6) AS coverage_gap_score FROM (SELECT lpad(CAST(t.tid AS VARCHAR), 11, '0') AS GEOID, 'R' || CAST(t.tid % 3 AS VARCHAR) AS region, s.coverage_gap_score FROM tract t JOIN score s USING (tid) WHERE t.tid % 7 <> 0 UNION ALL SELECT '99000000001', 'R1', NULL)", measures=True))
def template_rows(spark, root):
    """A CSV template says which tracts are scored: its keys stay text, its regions hold whatever a key begins with, tracts that it lacks go, and
    a row that no tract has stays without a score."""
    path = _folder(spark, "template")
    t = tables.tracts(spark, root)
    own = t.where("tid % 7 <> 0").select(F.lpad(F.col("tid").cast("string"), 11, "0").alias("GEOID"), F.concat(F.lit("R"), (F.col("tid") % 3).cast("string")).alias("region"), F.lit(None).cast("double").alias("coverage_gap_score"))
    elsewhere = t.limit(1).select(F.lit("99000000001").alias("GEOID"), F.lit("R1").alias("region"), F.lit(None).cast("double").alias("coverage_gap_score"))
    own.unionByName(elsewhere).write.csv(path, header=True)
    s = _scores(spark, root).select(F.lpad(F.col("tid").cast("string"), 11, "0").alias("GEOID"), r6("coverage_gap_score"))
    return tables.read_template(spark, path).drop("coverage_gap_score").join(s, "GEOID", "left")


@query(over("SELECT variant, region, count(*) AS n, count(building_gap) AS n_defined, round(sum(building_gap), 4) AS total FROM (" + " UNION ALL ".join(f"SELECT '{h}' AS variant, region, building_gap FROM ({sql})" for h, sql in (("centroid", _BUILDING.replace("LEFT JOIN c ", f"LEFT JOIN ({oracles.counts('centroid')}) c ")), ("within", _BUILDING.replace("LEFT JOIN c ", f"LEFT JOIN ({oracles.counts('within')}) c ")))) + ") WHERE region = 'ASIA' GROUP BY ALL"))
def component_slice(spark, root):
    """A component table written by region and variant: a region's files alone are read, each row's variant comes from its file's path, and a
    committed table would stand before the fresh one."""
    t, b, *_ = _layers(spark, root)
    fresh = _folder(spark, "component")
    tables.write_component(gaps.building_gaps(t, b, ("centroid", "within")).select("tid", "region", "variant", r6("building_gap")), fresh)
    table = tables.first_existing(spark, f"{root}/committed/component.parquet", fresh).where(F.col("region") == "ASIA")
    named = table.drop("variant").select("*", F.regexp_extract(F.col("_metadata.file_path"), "variant=([^/]+)", 1).alias("variant"))
    return named.groupBy("variant", "region").agg(F.count(F.lit(1)).alias("n"), F.count("building_gap").alias("n_defined"), F.round(F.sum("building_gap"), 4).alias("total"))


# ---- sets, classes, distances


_BY_HOW = {h: _BUILDING.replace("LEFT JOIN c ", f"LEFT JOIN ({oracles.counts(h)}) c ") for h in ("centroid", "within")}


@query(over(" UNION ALL ".join(f"SELECT region, '{h}' AS variant, building_gap FROM ({sql})" for h, sql in _BY_HOW.items())))
def union_regions(spark, root):
    t, b, *_ = _layers(spark, root)
    return gaps.building_gaps(t, b, ("centroid", "within")).select("region", "variant", r6("building_gap"))


@query(over("SELECT a.class AS ref_class, " + ", ".join(f"count(*) FILTER (WHERE b.class = '{c}') AS {c}" for c in ("primary", "secondary", "residential")) + " FROM road a JOIN road b ON NOT a.mapped AND b.mapped AND a.ax // 2000 = b.ax // 2000 AND a.ay // 2000 = b.ay // 2000 GROUP BY a.class"))
def class_confusion(spark, root):
    r = tables.roads(spark, root).select("mapped", "class", F.expr("ax div 2000").alias("i"), F.expr("ay div 2000").alias("j"))
    # counts per cell and class first: the join then has three rows a side and cell at most
    side = lambda mapped, name: r.where(F.col("mapped") == mapped).groupBy("i", "j", F.col("class").alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    pairs = side(False, "ref_class").join(side(True, "map_class"), ["i", "j"])
    n = F.col("n_ref_class") * F.col("n_map_class")
    return pairs.groupBy("ref_class").agg(*(F.coalesce(F.sum(F.when(F.col("map_class") == c, n)), F.lit(0)).alias(c) for c in ("primary", "secondary", "residential")))


_T = "greatest(0, least(1, coalesce(((mx - b.ax) * b.dx + (my - b.ay) * b.dy) / nullif(b.dx * b.dx + b.dy * b.dy, 0), 0)))"


@query(over(f"""SELECT class, count(*) AS n, count(d) AS n_near, round(avg(d), 3) AS mean_distance FROM (
  SELECT m.rid, m.class, min(sqrt(power(mx - b.ax - {_T} * b.dx, 2) + power(my - b.ay - {_T} * b.dy, 2))) FILTER (WHERE sqrt(power(mx - b.ax - {_T} * b.dx, 2) + power(my - b.ay - {_T} * b.dy, 2)) <= 5000) AS d
  FROM m LEFT JOIN (SELECT * FROM road WHERE mapped) b ON least(b.ax, b.ax + b.dx) <= mx + 5000 AND greatest(b.ax, b.ax + b.dx) >= mx - 5000 AND least(b.ay, b.ay + b.dy) <= my + 5000 AND greatest(b.ay, b.ay + b.dy) >= my - 5000 GROUP BY m.rid, m.class) GROUP BY class""",
  "m AS MATERIALIZED (SELECT rid, class, ax + dx / 2 AS mx, ay + dy / 2 AS my FROM road WHERE NOT mapped)"))
def road_distance(spark, root):
    r = tables.roads(spark, root)
    # the segment itself names a reference road: equal ones are as far from any other
    keyed = r.where("NOT mapped").withColumn("ref_id", F.concat_ws("|", "class", "ax", "ay", "dx", "dy"))
    refs = keyed.groupBy("ref_id", "class", "ax", "ay", "dx", "dy").agg(F.count(F.lit(1)).alias("copies"))
    near = gaps.nearest_road(r.where("mapped"), refs, 5000)
    out = refs.select("ref_id", "class", "copies").join(near, "ref_id")
    some = F.when(F.col("distance").isNotNull(), F.col("copies"))
    return out.groupBy("class").agg(F.sum("copies").alias("n"), F.coalesce(F.sum(some), F.lit(0)).alias("n_near"), F.round(F.sum(F.col("distance") * F.col("copies")) / F.sum(some), 3).alias("mean_distance"))


def _segments(r: DataFrame) -> DataFrame:
    """Reference roads, of which alike ones are one with a number of copies; written, so that their short numbers stay as they are."""
    one = r.where("NOT mapped").groupBy("class", *gaps.SEGMENT).agg(F.count(F.lit(1)).alias("copies"))
    return layers.written(one.withColumn("ref_id", F.monotonically_increasing_id()), "reference-roads")


@query(over("""SELECT class, CAST(sum(copies) AS BIGINT) AS n, CAST(coalesce(sum(copies) FILTER (WHERE h < 5000), 0) AS BIGINT) AS n_covered, round(sum(h * copies) FILTER (WHERE h < 5000) / sum(copies) FILTER (WHERE h < 5000), 3) AS mean_distance FROM (
  SELECT class, copies, max(d) AS h FROM (SELECT p.class, p.ax, p.ay, p.dx, p.dy, p.copies, p.m, least(5000, coalesce(min(d), 5000)) AS d FROM place p LEFT JOIN near USING (id, m) GROUP BY ALL) GROUP BY class, ax, ay, dx, dy, copies) GROUP BY class""",
  "one AS (SELECT row_number() OVER () AS id, * FROM (SELECT class, ax, ay, dx, dy, count(*) AS copies FROM road WHERE NOT mapped GROUP BY ALL))",
  "place AS MATERIALIZED (SELECT *, ax + dx * (m / 64e0) AS px, ay + dy * (m / 64e0) AS py, CAST(floor((ax + dx * (m / 64e0)) / 10000) AS BIGINT) AS i, CAST(floor((ay + dy * (m / 64e0)) / 10000) AS BIGINT) AS j FROM (SELECT *, unnest(range(65)) AS m FROM one))",
  "wide AS (SELECT *, unnest(range(CAST(floor((least(ax, ax + dx) - 5000) / 10000) AS BIGINT), CAST(floor((greatest(ax, ax + dx) + 5000) / 10000) AS BIGINT) + 1)) AS i FROM road WHERE mapped)",
  "spread_ AS MATERIALIZED (SELECT *, unnest(range(CAST(floor((least(ay, ay + dy) - 5000) / 10000) AS BIGINT), CAST(floor((greatest(ay, ay + dy) + 5000) / 10000) AS BIGINT) + 1)) AS j FROM wide)",
  "near AS (SELECT id, m, sqrt((px - b.ax - t * b.dx) * (px - b.ax - t * b.dx) + (py - b.ay - t * b.dy) * (py - b.ay - t * b.dy)) AS d FROM (SELECT p.id, p.m, p.px, p.py, b.*, greatest(0, least(1, coalesce(((p.px - b.ax) * b.dx + (p.py - b.ay) * b.dy) / nullif(b.dx * b.dx + b.dy * b.dy, 0), 0))) AS t FROM place p JOIN spread_ b USING (i, j)) b)"))
def road_coverage_distance(spark, root):
    """How far reference roads lie from the mapped ones, at the farthest of 65 places along each."""
    r = tables.roads(spark, root)
    refs = _segments(r)
    out = refs.select("ref_id", "class", "copies").join(matching.coverage_distance(refs, r.where("mapped"), 5000.0), "ref_id")
    some = F.when(F.col("distance") < 5000, F.col("copies"))
    return out.groupBy("class").agg(F.sum("copies").alias("n"), F.coalesce(F.sum(some), F.lit(0)).alias("n_covered"), F.round(F.sum(F.col("distance") * some) / F.sum(some), 3).alias("mean_distance"))


_CLASSES = ("primary", "secondary", "residential")


@query(over("SELECT rclass AS ref_class, " + ", ".join(f"count(*) FILTER (WHERE mclass = '{c}') AS {c}" for c in _CLASSES) + " FROM a JOIN b USING (rid, mid) GROUP BY rclass",
  "ref_ AS MATERIALIZED (SELECT row_number() OVER () AS rid, ax + dx / 2 AS x, ay + dy / 2 AS y, * FROM (SELECT DISTINCT class, ax, ay, dx, dy FROM road WHERE NOT mapped))",
  "map_ AS MATERIALIZED (SELECT row_number() OVER () AS mid, ax + dx / 2 AS x, ay + dy / 2 AS y, * FROM (SELECT DISTINCT class, ax, ay, dx, dy FROM road WHERE mapped))",
  """pair_ AS MATERIALIZED (SELECT rid, mid, r.class AS rclass, m.class AS mclass, r.ax AS rax, r.ay AS ray, r.dx AS rdx, r.dy AS rdy, m.ax AS max_, m.ay AS may, m.dx AS mdx, m.dy AS mdy, (r.x - m.x) * (r.x - m.x) + (r.y - m.y) * (r.y - m.y) AS q
  FROM (SELECT *, unnest([-1, 0, 1]) + CAST(floor(x / 3000) AS BIGINT) AS i FROM ref_) r JOIN (SELECT *, CAST(floor(x / 3000) AS BIGINT) AS i FROM map_) m USING (i)
  WHERE (r.x - m.x) * (r.x - m.x) + (r.y - m.y) * (r.y - m.y) <= 9e6 AND abs(r.dx * m.dy - r.dy * m.dx) <= abs(r.dx * m.dx + r.dy * m.dy) * tan(radians(20e0)) AND (r.dx <> 0 OR r.dy <> 0) AND (m.dx <> 0 OR m.dy <> 0))""",
  "a AS (SELECT rid, mid, rclass, mclass FROM pair_ QUALIFY row_number() OVER (PARTITION BY rid ORDER BY q, max_, may, mdx, mdy, mclass) = 1)",
  "b AS (SELECT rid, mid FROM pair_ QUALIFY row_number() OVER (PARTITION BY mid ORDER BY q, rax, ray, rdx, rdy, rclass) = 1)"))
def matched_class_confusion(spark, root):
    """Classes of reference and mapped roads that are each other's nearest within 3,000 and 20 degrees."""
    r = tables.roads(spark, root)
    pairs = matching.matched_pairs(r.where("NOT mapped"), r.where("mapped"), 3000.0, 20.0)
    return pairs.groupBy(F.col("r_class").alias("ref_class")).agg(*(F.count_if(F.col("m_class") == c).alias(c) for c in _CLASSES))


@query(over(f"SELECT day, kind, mapped, ref, round({gap('mapped', 'ref')}, 6) AS gap FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) FILTER (WHERE user_id % 2 = 0) AS mapped, count(*) FILTER (WHERE user_id % 3 > 0) AS ref FROM events GROUP BY 1, 2)"))
def windowed_poi_gap(spark, root):
    """The stream's aggregation over the table as a batch."""
    e = tables.read(spark, root, "events").select("ts", F.col("event_type").alias("kind"), F.expr("user_id % 2 = 0").alias("in_mapped"), F.expr("user_id % 3 > 0").alias("in_ref"))
    return windowed_gap(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "mapped", "ref", r6("gap"))


def entry(spark: SparkSession, root: str) -> DataFrame:
    """The flagship: buildings by centre in tract, counted on both sides, and the gap."""
    return QUERIES["building_gap_centroid"](spark, root)
