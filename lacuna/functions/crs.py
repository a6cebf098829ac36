"""Map projections and datum shifts in closed form, as SQL expressions that both engines take.

Longitude and latitude are degrees, x is longitude first. Formulas after Snyder (1987), Bowring (1976)
and, for the geodesic, Vincenty's inverse with a fixed number of rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Ellipsoids: semi-major axis and inverse flattening (fixed values).
GRS80, WGS84, CLARKE66 = (6378137.0, 298.257222101), (6378137.0, 298.257223563), (6378206.4, 294.978698214)
#: Shifts in metres from WGS84 to NAD83 (fixed values of two published operations).
SHIFTS = {"op3": (-1.0, -1.0, 1.0), "op2": (2.0, 0.0, -4.0)}


def lit(x: float) -> str:
    """A double literal for both engines."""
    return f"{x:.17e}"


def _squared(ellipsoid: tuple[float, float]) -> float:
    return 2 / ellipsoid[1] - 1 / (ellipsoid[1] * ellipsoid[1])


def atanh(x: str) -> str:
    """The inverse hyperbolic tangent of an expression within 0.5 of 0, from the logarithm of 1 + y: as a logarithm of a quotient near 1 it
    would lose several of the last bits, which is enough to round some coordinates to another place of a grid."""
    return f"(sign({x}) * 0.5D * log1p(2 * abs({x}) + 2 * abs({x}) * abs({x}) / (1 - abs({x}))))"


@dataclass(frozen=True)
class Albers:
    """Equal-area conic projection with two parallels."""

    parallel1: float = 29.5
    parallel2: float = 45.5
    latitude: float = 23.0
    longitude: float = -96.0
    ellipsoid: tuple[float, float] = GRS80

    def constants(self) -> tuple[float, float, float]:
        e2 = _squared(self.ellipsoid)
        m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) * math.sin(p))
        p1, p2, p0 = map(math.radians, (self.parallel1, self.parallel2, self.latitude))
        n = (m(p1) ** 2 - m(p2) ** 2) / (self._q(p2) - self._q(p1))
        c = m(p1) ** 2 + n * self._q(p1)
        return n, c, self.ellipsoid[0] * math.sqrt(c - n * self._q(p0)) / n

    def _q(self, p: float) -> float:
        e = math.sqrt(e2 := _squared(self.ellipsoid))
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    def expressions(self, lon: str, lat: str) -> tuple[str, str]:
        n, c, rho0 = self.constants()
        e = math.sqrt(e2 := _squared(self.ellipsoid))
        s = f"sin(radians({lat}))"
        q = f"({lit(1 - e2)} * ({s} / (1 - {lit(e2)} * {s} * {s}) + {atanh(f'({lit(e)} * {s})')} / {lit(e)}))"
        rho = f"({lit(self.ellipsoid[0])} * sqrt({lit(c)} - {lit(n)} * {q}) / {lit(n)})"
        theta = f"({lit(n)} * radians({lon} - ({lit(self.longitude)})))"
        return f"({rho} * sin({theta}))", f"({lit(rho0)} - {rho} * cos({theta}))"


#: Conterminous US: NAD83 Albers, its 2011 realisation (the same projection), and the contiguous-US variant.
EPSG5070 = EPSG6350 = Albers()
ESRI102003 = Albers(latitude=37.5)


def mercator(lon: str, lat: str) -> tuple[str, str]:
    """Spherical Mercator of web maps. It has a value at every latitude: beyond a pole that of the same place on the other side's meridian."""
    r, t = lit(WGS84[0]), f"tan(radians({lat}))"
    # the inverse hyperbolic sine of t, whose own function in Spark loses its digits where t is far below 0
    y = f"sign({t}) * log1p(abs({t}) + {t} * {t} / (1 + sqrt({t} * {t} + 1)))"
    return f"({lon} * {lit(math.pi * WGS84[0])} / 180)", f"({r} * {y})"


#: Projections by their codes.
PROJECTIONS = {"5070": EPSG5070.expressions, "6350": EPSG6350.expressions, "102003": ESRI102003.expressions, "3857": mercator}
#: The metadata key under which a column keeps its reference system.
TAG = "crs"


def tagged(df: DataFrame, columns: tuple[str, ...], code: str) -> DataFrame:
    """The frame with columns that say in which system their coordinates are: selections, joins and Parquet files keep it, new
    expressions don't (see ``like``)."""
    for c in columns:
        df = df.withMetadata(c, {**df.schema[c].metadata, TAG: code})
    return df


def code_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get(TAG)


def like(df: DataFrame, source: str, columns: tuple[str, ...]) -> DataFrame:
    """The frame with columns tagged as the column they were made from; as it is if that one has no tag."""
    code = code_of(df, source)
    return tagged(df, columns, code) if code else df


def same_code(left: DataFrame, right: DataFrame, columns: tuple[str, str]) -> None:
    """Fails where two columns are tagged with different systems."""
    a, b = code_of(left, columns[0]), code_of(right, columns[1])
    if a and b and a != b:
        raise ValueError(f"{columns[0]} is in {a}, {columns[1]} in {b}: project one of them first")


def shifted(lon: str, lat: str, shift: tuple[float, float, float], source: tuple[float, float] = WGS84, target: tuple[float, float] = GRS80) -> tuple[str, str]:
    """Longitude and latitude on another datum: to geocentric, shift, and back."""
    a, e2 = source[0], _squared(source)
    s, c = f"sin(radians({lat}))", f"cos(radians({lat}))"
    nu = f"({lit(a)} / sqrt(1 - {lit(e2)} * {s} * {s}))"
    x = f"({nu} * {c} * cos(radians({lon})) + ({lit(shift[0])}))"
    y = f"({nu} * {c} * sin(radians({lon})) + ({lit(shift[1])}))"
    z = f"({nu} * {lit(1 - e2)} * {s} + ({lit(shift[2])}))"
    a2, e22 = target[0], _squared(target)
    b2 = a2 * (1 - 1 / target[1])
    p = f"sqrt({x} * {x} + {y} * {y})"
    t = f"atan2({z} * {lit(a2)}, {p} * {lit(b2)})"
    lat2 = f"degrees(atan2({z} + {lit(e22 / (1 - e22) * b2)} * power(sin({t}), 3), {p} - {lit(e22 * a2)} * power(cos({t}), 3)))"
    return f"degrees(atan2({y}, {x}))", lat2


Step = tuple[str, str]


def shift_steps(lon: str, lat: str, tx: str, ty: str, tz: str, source: tuple[float, float] = WGS84, target: tuple[float, float] = GRS80) -> list[Step]:
    """The datum shift as steps (name, expression), each from the ones before it, ending in ``lon`` and ``lat`` anew. The shift comes from
    expressions, so that one plan serves rows of many shifts; where ``tx`` is NULL the point stays."""
    a, e2, a2, e22 = source[0], _squared(source), target[0], _squared(target)
    b2 = a2 * (1 - 1 / target[1])
    return [
        ("d_s", f"sin(radians({lat}))"),
        ("d_c", f"cos(radians({lat}))"),
        ("d_nu", f"{lit(a)} / sqrt(1 - {lit(e2)} * d_s * d_s)"),
        ("d_x", f"d_nu * d_c * cos(radians({lon})) + {tx}"),
        ("d_y", f"d_nu * d_c * sin(radians({lon})) + {ty}"),
        ("d_z", f"d_nu * {lit(1 - e2)} * d_s + {tz}"),
        ("d_p", "sqrt(d_x * d_x + d_y * d_y)"),
        ("d_t", f"atan2(d_z * {lit(a2)}, d_p * {lit(b2)})"),
        (lon, f"CASE WHEN {tx} IS NULL THEN {lon} ELSE degrees(atan2(d_y, d_x)) END"),
        (lat, f"CASE WHEN {tx} IS NULL THEN {lat} ELSE degrees(atan2(d_z + {lit(e22 / (1 - e22) * b2)} * power(sin(d_t), 3), d_p - {lit(e22 * a2)} * power(cos(d_t), 3))) END"),
    ]


def conic_steps(lon: str, lat: str, n: str, c: str, rho0: str, ellipsoid: tuple[float, float] = GRS80, longitude: float = -96.0) -> list[Step]:
    """The conic projection as steps that end in ``p_x`` and ``p_y``; its constants are expressions (see ``Albers.constants``), and where
    ``n`` is NULL the projection is the spherical Mercator."""
    e = math.sqrt(e2 := _squared(ellipsoid))
    flat_x, flat_y = mercator(lon, lat)
    return [
        ("p_s", f"sin(radians({lat}))"),
        ("p_e", f"{lit(e)} * p_s"),
        ("p_q", f"{lit(1 - e2)} * (p_s / (1 - {lit(e2)} * p_s * p_s) + {atanh('p_e')} / {lit(e)})"),
        ("p_r", f"{lit(ellipsoid[0])} * sqrt({c} - {n} * p_q) / {n}"),
        ("p_t", f"{n} * radians({lon} - ({lit(longitude)}))"),
        ("p_x", f"CASE WHEN {n} IS NULL THEN {flat_x} ELSE p_r * sin(p_t) END"),
        ("p_y", f"CASE WHEN {n} IS NULL THEN {flat_y} ELSE {rho0} - p_r * cos(p_t) END"),
    ]


#: Constants of the projections that are conic, by code; the other one is the spherical Mercator.
CONES = {"5070": EPSG5070.constants(), "6350": EPSG6350.constants(), "102003": ESRI102003.constants(), "3857": (None, None, None)}


def geodesic(columns: tuple[str, str, str, str], rounds: int = 5, ellipsoid: tuple[float, float] = GRS80) -> list[tuple[str, str]]:
    """Steps (name, expression) that end in ``metres``: Vincenty's inverse from (lon1, lat1) to (lon2, lat2).

    Each step uses the ones before it; ``rounds`` suffice for distances of a few hundred kilometres.
    """
    lon1, lat1, lon2, lat2 = columns
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    b = a * (1 - f)
    steps = [("g_l", f"radians({lon2} - {lon1})"), ("g_u1", f"atan({lit(1 - f)} * tan(radians({lat1})))"), ("g_u2", f"atan({lit(1 - f)} * tan(radians({lat2})))"), ("g_k0", "g_l")]
    for k in range(1, rounds + 1):
        k0 = f"g_k{k - 1}"
        steps += [
            (f"g_ss{k}", f"sqrt(power(cos(g_u2) * sin({k0}), 2) + power(cos(g_u1) * sin(g_u2) - sin(g_u1) * cos(g_u2) * cos({k0}), 2))"),
            (f"g_cs{k}", f"sin(g_u1) * sin(g_u2) + cos(g_u1) * cos(g_u2) * cos({k0})"),
            (f"g_s{k}", f"atan2(g_ss{k}, g_cs{k})"),
            (f"g_sa{k}", f"CASE WHEN g_ss{k} = 0 THEN 0e0 ELSE cos(g_u1) * cos(g_u2) * sin({k0}) / g_ss{k} END"),
            (f"g_ca{k}", f"1 - g_sa{k} * g_sa{k}"),
            (f"g_cm{k}", f"CASE WHEN g_ca{k} = 0 THEN 0e0 ELSE g_cs{k} - 2 * sin(g_u1) * sin(g_u2) / g_ca{k} END"),
            (f"g_c{k}", f"{lit(f / 16)} * g_ca{k} * (4 + {lit(f)} * (4 - 3 * g_ca{k}))"),
            (f"g_k{k}", f"g_l + (1 - g_c{k}) * {lit(f)} * g_sa{k} * (g_s{k} + g_c{k} * g_ss{k} * (g_cm{k} + g_c{k} * g_cs{k} * (2 * g_cm{k} * g_cm{k} - 1)))"),
        ]
    k = rounds
    steps += [
        ("g_w", f"g_ca{k} * {lit((a * a - b * b) / (b * b))}"),
        ("g_big", "1 + g_w / 16384 * (4096 + g_w * (g_w * (320 - 175 * g_w) - 768))"),
        ("g_small", "g_w / 1024 * (256 + g_w * (g_w * (74 - 47 * g_w) - 128))"),
        ("g_d", f"g_small * g_ss{k} * (g_cm{k} + g_small / 4 * (g_cs{k} * (2 * g_cm{k} * g_cm{k} - 1) - g_small / 6 * g_cm{k} * (4 * g_ss{k} * g_ss{k} - 3) * (4 * g_cm{k} * g_cm{k} - 3)))"),
        ("metres", f"{lit(b)} * g_big * (g_s{k} - g_d)"),
    ]
    return steps
