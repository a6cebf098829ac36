"""The derived layers and measures as DuckDB SQL, written apart from the DataFrame code."""

from __future__ import annotations

LAYERS = """
tract AS (SELECT c_custkey AS tid, r_name AS region, n_name AS county, (c_custkey % 50) * 20000 AS x0, (c_custkey % 50) * 20000 + 20000 AS x1,
  (c_custkey - c_custkey % 50) * 400 AS y0, (c_custkey - c_custkey % 50) * 400 + 20000 AS y1,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) % 8 END AS cbp_estab, r_name = 'AFRICA' AS tribal,
  c_mktsegment IN ('MACHINERY', 'FURNITURE') AS rural, c_acctbal AS svi
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
building AS (SELECT o_orderkey AS bid, (o_custkey % 50) * 20000 + (o_orderkey * 7919) % 60000 - 20000 AS cx,
  (o_custkey - o_custkey % 50) * 400 + (o_orderkey * 10473) % 60000 - 20000 AS cy, 10 + o_orderkey % 90 AS half,
  o_orderstatus IN ('O', 'F') AS in_mapped, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 3 > 0) AS in_ref FROM orders),
road AS (SELECT row_number() OVER () AS rid, ((l_orderkey - l_orderkey % 10) * 2000) % 1000000 + (l_partkey * 7919) % 20000 AS ax,
  (l_orderkey - l_orderkey % 500) * 40 + (l_suppkey * 1047 + l_partkey * 13) % 20000 AS ay, l_quantity * 900 - 20000 AS dx, round(l_discount * 100) * 4000 - 20000 AS dy,
  l_returnflag = 'A' AS mapped, CASE l_linenumber WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'residential' END AS class
  FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F'),
poi AS (SELECT (event_id * 3 - (event_id * 3) % 20) // 20 AS tid, CASE event_type WHEN 'signup' THEN 'fire' WHEN 'error' THEN 'ems' WHEN 'click' THEN 'schools' WHEN 'purchase' THEN 'hospital' ELSE 'other' END AS kind,
  user_id % 2 = 0 AS in_mapped, user_id % 3 > 0 AS in_ref FROM events)
"""


def gap(mapped: str, ref: str) -> str:
    return f"CASE WHEN {ref} > 0 THEN 1 - least(CAST(1 AS DOUBLE), CAST(coalesce({mapped}, 0) AS DOUBLE) / {ref}) END"


def lengths(roads: str = "road", tracts: str = "tract", where: str = "true", digits: int = 3, box: tuple[str, str, str, str] = ("x0", "x1", "y0", "y1"), keep: str = "true") -> str:
    """Clipped lengths per tract: entry and exit parameters in both directions."""
    x0, x1, y0, y1 = box
    return f"""SELECT tid, round(sum(CASE WHEN mapped THEN len ELSE 0 END), {digits}) AS ov_len, round(sum(CASE WHEN mapped THEN 0 ELSE len END), {digits}) AS tiger_len FROM (
  SELECT tid, mapped, greatest(0, least(1, lx, ly) - greatest(0, ex, ey)) * sqrt(dx * dx + dy * dy) AS len FROM (
    SELECT tid, mapped, dx, dy,
      CASE WHEN dx > 0 THEN ({x0} - ax) / dx WHEN dx < 0 THEN ({x1} - ax) / dx WHEN ax BETWEEN {x0} AND {x1} THEN 0 ELSE 2 END AS ex, CASE WHEN dx > 0 THEN ({x1} - ax) / dx WHEN dx < 0 THEN ({x0} - ax) / dx ELSE 1 END AS lx,
      CASE WHEN dy > 0 THEN ({y0} - ay) / dy WHEN dy < 0 THEN ({y1} - ay) / dy WHEN ay BETWEEN {y0} AND {y1} THEN 0 ELSE 2 END AS ey, CASE WHEN dy > 0 THEN ({y1} - ay) / dy WHEN dy < 0 THEN ({y0} - ay) / dy ELSE 1 END AS ly
    FROM {roads} JOIN {tracts} ON least(ax, ax + dx) <= {x1} AND greatest(ax, ax + dx) >= {x0} AND least(ay, ay + dy) <= {y1} AND greatest(ay, ay + dy) >= {y0} WHERE ({where}) AND ({keep}))) GROUP BY tid"""


def clipped(where: str = "true") -> str:
    """The ends, in degrees, of roads' parts in tracts."""
    return f"""SELECT tid, mapped, -100e0 + (ax + t0 * dx) / 1e6 AS lon1, 30e0 + (ay + t0 * dy) / 1e6 AS lat1, -100e0 + (ax + t1 * dx) / 1e6 AS lon2, 30e0 + (ay + t1 * dy) / 1e6 AS lat2 FROM (
  SELECT *, greatest(0, CASE WHEN dx > 0 THEN (x0 - ax) / dx WHEN dx < 0 THEN (x1 - ax) / dx WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END, CASE WHEN dy > 0 THEN (y0 - ay) / dy WHEN dy < 0 THEN (y1 - ay) / dy WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END) AS t0,
    least(1, CASE WHEN dx > 0 THEN (x1 - ax) / dx WHEN dx < 0 THEN (x0 - ax) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (y1 - ay) / dy WHEN dy < 0 THEN (y0 - ay) / dy ELSE 1 END) AS t1
  FROM road JOIN tract ON least(ax, ax + dx) <= x1 AND greatest(ax, ax + dx) >= x0 AND least(ay, ay + dy) <= y1 AND greatest(ay, ay + dy) >= y0 WHERE {where}) WHERE t1 > t0"""


PAIRS = {
    "centroid": "cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1",
    "centroid_inside": "cx > x0 AND cx < x1 AND cy > y0 AND cy < y1",
    "intersects": "cx - half <= x1 AND cx + half >= x0 AND cy - half <= y1 AND cy + half >= y0",
    "within": "cx - half >= x0 AND cx + half <= x1 AND cy - half >= y0 AND cy + half <= y1",
}


def counts(how: str) -> str:
    return f"SELECT tid, count(*) FILTER (WHERE in_mapped) AS ov_cnt, count(*) FILTER (WHERE in_ref) AS ms_cnt FROM building JOIN tract ON {PAIRS[how]} GROUP BY tid"


_KINDS = ("fire", "ems", "schools")
MEASURES = f"""
len AS MATERIALIZED ({lengths(where="class = 'primary'")}),
cnt AS MATERIALIZED ({counts("centroid")}),
poi_wide AS (SELECT tid, {", ".join(f"count(*) FILTER (WHERE in_mapped AND kind = '{k}') AS {k}_mapped, count(*) FILTER (WHERE in_ref AND kind = '{k}') AS {k}_ref" for k in _KINDS)}, count(*) FILTER (WHERE in_mapped) AS places FROM poi GROUP BY tid),
poi_halves AS (SELECT t.*, {", ".join(f"{gap(f'{k}_mapped', f'{k}_ref')} AS poi_gap_{k}" for k in _KINDS)}, {gap("places", "cbp_estab")} AS establishments_half FROM tract t LEFT JOIN poi_wide USING (tid)),
poi_mean AS (SELECT *, (coalesce(poi_gap_fire, 0) + coalesce(poi_gap_ems, 0) + coalesce(poi_gap_schools, 0)) / nullif(CAST(poi_gap_fire IS NOT NULL AS INT) + CAST(poi_gap_ems IS NOT NULL AS INT) + CAST(poi_gap_schools IS NOT NULL AS INT), 0) AS facilities_half FROM poi_halves),
poi_score AS (SELECT *, (coalesce(facilities_half, 0) + coalesce(establishments_half, 0)) / nullif(CAST(facilities_half IS NOT NULL AS INT) + CAST(establishments_half IS NOT NULL AS INT), 0) AS poi_gap FROM poi_mean),
parts AS (SELECT p.*, {gap("ov_len", "tiger_len")} AS transport_gap, {gap("ov_cnt", "ms_cnt")} AS building_gap FROM poi_score p LEFT JOIN len USING (tid) LEFT JOIN cnt USING (tid)),
score AS MATERIALIZED (SELECT *, CAST(transport_gap IS NOT NULL AS INT) + CAST(building_gap IS NOT NULL AS INT) + CAST(poi_gap IS NOT NULL AS INT) AS k,
  (coalesce(transport_gap, 0) + coalesce(building_gap, 0) + coalesce(poi_gap, 0)) / nullif(CAST(transport_gap IS NOT NULL AS INT) + CAST(building_gap IS NOT NULL AS INT) + CAST(poi_gap IS NOT NULL AS INT), 0) AS coverage_gap_score FROM parts)
"""


def over(select: str, *more: str, measures: bool = False) -> str:
    return "WITH " + ", ".join([LAYERS, *([MEASURES] if measures else []), *more]) + "\n" + select


# ---- projections, apart from functions/crs.py: other forms of the same formulas, their constants computed in SQL

_ALBERS = {"5070": 23.0, "6350": 23.0, "102003": 37.5}
_E2 = "(2 / 298.257222101e0 - 1 / (298.257222101e0 * 298.257222101e0))"


def _authalic(sine: str, e2: str = "e2") -> str:
    return f"((1 - {e2}) * ({sine} / (1 - {e2} * {sine} * {sine}) + atanh(sqrt({e2}) * {sine}) / sqrt({e2})))"


def _parallel(degrees: float) -> str:
    return f"(cos(radians({degrees}e0)) / sqrt(1 - e2 * sin(radians({degrees}e0)) * sin(radians({degrees}e0))))"


#: One row for each conic projection: cone constant, c and the radius of its origin.
CONES = f"""cone0 AS (SELECT unnest(['{"', '".join(_ALBERS)}']) AS crs, unnest([{", ".join(f"{v}e0" for v in _ALBERS.values())}]) AS lat0, {_E2} AS e2),
cone1 AS (SELECT *, (power({_parallel(29.5)}, 2) - power({_parallel(45.5)}, 2)) / ({_authalic("sin(radians(45.5e0))")} - {_authalic("sin(radians(29.5e0))")}) AS n, {_authalic("sin(radians(lat0))")} AS q0 FROM cone0),
cone2 AS (SELECT *, power({_parallel(29.5)}, 2) + n * {_authalic("sin(radians(29.5e0))")} AS c FROM cone1),
cone AS MATERIALIZED (SELECT crs, e2, n, c, 6378137e0 * sqrt(c - n * q0) / n AS rho0 FROM cone2)"""


def planar_of(table: str, crs: str = "t.crs") -> str:
    """A table with lon and lat (and crs), with px and py beside them."""
    rho = f"(6378137e0 * sqrt(cone.c - cone.n * {_authalic('sin(radians(lat))', 'cone.e2')}) / cone.n)"
    turn = "(cone.n * radians(lon + 96e0))"
    flat = f"{crs} = '3857'"
    return f"SELECT t.*, CASE WHEN {flat} THEN lon * 20037508.342789244e0 / 180 ELSE {rho} * sin({turn}) END AS px, CASE WHEN {flat} THEN 6378137e0 * asinh(tan(radians(lat))) ELSE cone.rho0 - {rho} * cos({turn}) END AS py FROM {table} t LEFT JOIN cone ON cone.crs = {crs}"


def both_ends(table: str, crs: str, keep: str) -> str:
    """(keep, px1, py1, px2, py2) of a table's segments from (lon1, lat1) to (lon2, lat2)."""
    one = planar_of(f"(SELECT {keep}, lon1 AS lon, lat1 AS lat, lon2, lat2 FROM {table})", f"'{crs}'")
    two = planar_of(f"(SELECT {keep}, px AS px1, py AS py1, lon2 AS lon, lat2 AS lat FROM ({one}))", f"'{crs}'")
    return f"SELECT {keep}, px1, py1, px AS px2, py AS py2 FROM ({two})"


def deltas() -> str:
    """Each setting's total beside the base, from ``metre_gap``."""
    return """SELECT variant, coalesce(CAST(sum(CAST(round(g * 1e6) AS BIGINT)) AS BIGINT), 0) / 1e6 AS total, count(*) FILTER (WHERE abs(g - b) > 1e-6) AS n_changed, round(max(abs(g - b)), 6) AS max_delta
  FROM (SELECT m.variant, m.transport_gap AS g, base.transport_gap AS b FROM metre_gap m JOIN metre_gap base ON base.variant = 'base' AND base.tid = m.tid) GROUP BY variant"""


def _chain(table: str, steps: list[str]) -> str:
    """A table with columns added step by step, each as a level of its own: an alias used beside its definition is written out anew."""
    for step in steps:
        table = f"(SELECT *, {step} FROM {table})"
    return table


_NAD = {"op3": (-1, -1, 1), "op2": (2, 0, -4)}


def moved(table: str, columns: str) -> str:
    """A table's points (lon, lat) on the datum that ``shift`` names: to geocentric, and back by iteration."""
    step = lambda k: f"atan2(gz + {_E2} * 6378137e0 / sqrt(1 - {_E2} * sin(f{k}) * sin(f{k})) * sin(f{k}), gp) AS f{k + 1}"
    cases = lambda i: "CASE shift " + " ".join(f"WHEN '{n}' THEN {v[i]}e0" for n, v in _NAD.items()) + " END"
    w2 = "(2 / 298.257223563e0 - 1 / (298.257223563e0 * 298.257223563e0))"
    nu = f"(6378137e0 / sqrt(1 - {w2} * power(sin(radians(lat)), 2)))"
    to = f"{nu} * cos(radians(lat)) * cos(radians(lon)) + {cases(0)} AS gx, {nu} * cos(radians(lat)) * sin(radians(lon)) + {cases(1)} AS gy, {nu} * (1 - {w2}) * sin(radians(lat)) + {cases(2)} AS gz"
    there = _chain(table, [to, "sqrt(gx * gx + gy * gy) AS gp", f"atan2(gz, gp * (1 - {_E2})) AS f0", *map(step, range(5))])
    return f"SELECT {columns}, CASE WHEN shift IS NULL THEN lon ELSE degrees(atan2(gy, gx)) END AS lon, CASE WHEN shift IS NULL THEN lat ELSE degrees(f5) END AS lat FROM {there}"


def metre_gaps(settings) -> str:
    """CTEs that end in ``metre_gap`` (variant, tid, region, ov_len, tiger_len, transport_gap): corners are rounded, moved, projected and
    snapped; a road is clipped by the four edges of its tract as half-planes. Cutting straight roads into parts changes no length, so that
    is left out here."""
    none = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{float(v)!r}e0" if "e" not in repr(float(v)) else f"CAST({float(v)!r} AS DOUBLE)"
    rows = ", ".join(f"({', '.join(none(v) for v in (s.name, s.crs, s.degrees, s.rounded, s.shift, s.snap))})" for s in settings)
    grid = lambda c, by: f"round_even({c} / {by}, 0) * {by}"
    on = lambda c: f"CASE WHEN degrees IS NOT NULL AND rounded IN ('both', layer) THEN {grid(c, 'degrees')} ELSE {c} END AS {c}"
    snapped = lambda c, n: f"CASE WHEN snap IS NULL THEN {c} ELSE {grid(c, 'snap')} END AS {n}"
    lon, lat = "-100e0 + {} / 999983e0", "30e0 + {} / 999983e0"
    ends = " UNION ALL ".join(f"SELECT 'roads' AS layer, rid AS id, {k} AS k, {lon.format(x)} AS lon, {lat.format(y)} AS lat FROM road WHERE class = 'primary'" for k, (x, y) in enumerate((("ax", "ay"), ("(ax + dx)", "(ay + dy)"))))
    corners = " UNION ALL ".join(f"SELECT 'tracts', tid, {k}, {lon.format(x)}, {lat.format(y)} FROM tract" for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    s, d = ((lambda k, f=f: f.format(x=f"x{k}", y=f"y{k}", u=f"x{(k + 1) % 4}", v=f"y{(k + 1) % 4}")) for f in ("(({u} - {x}) * (ay - {y}) - ({v} - {y}) * (ax - {x}))", "(({u} - {x}) * dy - ({v} - {y}) * dx)"))
    enter = ", ".join(f"CASE WHEN {d(k)} > 0 THEN -{s(k)} / {d(k)} WHEN {d(k)} = 0 AND {s(k)} < 0 THEN 2 ELSE 0 END" for k in range(4))
    leave = ", ".join(f"CASE WHEN {d(k)} < 0 THEN -{s(k)} / {d(k)} ELSE 1 END" for k in range(4))
    return f"""{CONES},
setting(variant, crs, degrees, rounded, shift, snap) AS (VALUES {rows}),
corner AS ({ends} UNION ALL {corners}),
c1 AS (SELECT variant, crs, shift, snap, layer, id, k, {on("lon")}, {on("lat")} FROM corner, setting),
c2 AS ({moved("c1", "variant, crs, snap, layer, id, k")}),
c3 AS MATERIALIZED (SELECT variant, layer, id, k, {snapped("px", "x")}, {snapped("py", "y")} FROM ({planar_of("c2")})),
line AS (SELECT variant, id AS rid, max(x) FILTER (WHERE k = 0) AS ax, max(y) FILTER (WHERE k = 0) AS ay, max(x) FILTER (WHERE k = 1) - max(x) FILTER (WHERE k = 0) AS dx, max(y) FILTER (WHERE k = 1) - max(y) FILTER (WHERE k = 0) AS dy FROM c3 WHERE layer = 'roads' GROUP BY ALL),
part AS MATERIALIZED (SELECT variant, mapped, line.ax, line.ay, line.dx, line.dy FROM line JOIN road USING (rid)),
quad AS MATERIALIZED (SELECT variant, id AS tid, {", ".join(f"max({c}) FILTER (WHERE k = {k}) AS {c}{k}" for k in range(4) for c in "xy")}, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM c3 WHERE layer = 'tracts' GROUP BY ALL),
metre_len AS (SELECT variant, tid, round(sum(CASE WHEN mapped THEN len ELSE 0 END), 3) AS ov_len, round(sum(CASE WHEN mapped THEN 0 ELSE len END), 3) AS tiger_len FROM (
  SELECT variant, tid, mapped, greatest(0, least(1, {leave}) - greatest(0, {enter})) * sqrt(dx * dx + dy * dy) AS len
  FROM part JOIN quad USING (variant) WHERE least(ax, ax + dx) <= bx1 AND greatest(ax, ax + dx) >= bx0 AND least(ay, ay + dy) <= by1 AND greatest(ay, ay + dy) >= by0) GROUP BY ALL),
metre_gap AS MATERIALIZED (SELECT variant, tid, region, coalesce(ov_len, 0) AS ov_len, coalesce(tiger_len, 0) AS tiger_len, {gap("ov_len", "tiger_len")} AS transport_gap FROM (SELECT tid, region, variant FROM tract, setting) LEFT JOIN metre_len USING (variant, tid))"""


def geodesic_of(table: str, rounds: int = 7) -> str:
    """A table with the ellipsoidal distance ``metres`` of (lon1, lat1) and (lon2, lat2): the inverse problem with the series in Helmert's
    third-flattening form, each round as its own columns."""
    f = "(1 / 298.257222101e0)"
    steps = [f"radians(lon2 - lon1) AS big, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2", "big AS l0"]
    for k in range(rounds):
        steps += [
            f"sqrt(power(cos(u2) * sin(l{k}), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l{k}), 2)) AS s{k}, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l{k}) AS c{k}",
            f"atan2(s{k}, c{k}) AS w{k}, coalesce(cos(u1) * cos(u2) * sin(l{k}) / nullif(s{k}, 0), 0) AS a{k}",
            f"1 - a{k} * a{k} AS k{k}",
            f"coalesce(c{k} - 2 * sin(u1) * sin(u2) / nullif(k{k}, 0), 0) AS m{k}, {f} / 16 * k{k} * (4 + {f} * (4 - 3 * k{k})) AS g{k}",
            f"big + (1 - g{k}) * {f} * a{k} * (w{k} + g{k} * s{k} * (m{k} + g{k} * c{k} * (2 * m{k} * m{k} - 1))) AS l{k + 1}",
        ]
    z = rounds - 1
    steps += [
        f"k{z} * (1 / ((1 - {f}) * (1 - {f})) - 1) AS h",
        "(sqrt(1 + h) - 1) / (sqrt(1 + h) + 1) AS j",
        "(1 + j * j / 4) / (1 - j) AS aa, j * (1 - 3 * j * j / 8) AS bb",
        f"bb * s{z} * (m{z} + bb / 4 * (c{z} * (2 * m{z} * m{z} - 1) - bb / 6 * m{z} * (4 * s{z} * s{z} - 3) * (4 * m{z} * m{z} - 3))) AS dd",
        f"6378137e0 * (1 - {f}) * aa * (w{z} - dd) AS metres",
    ]
    return f"SELECT * FROM {_chain(table, steps)}"
