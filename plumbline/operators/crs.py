"""Coordinate reference systems: the datum dimension, candidates from a legend, transverse Mercator both ways, ranking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.portable import apply

# Fixed values of the EPSG registry: datum, geographic code, then base code and first and last zone, north and south.
DATUMS = (
    ("WGS84", 4326, 32600, 1, 60, 32700, 1, 60),
    ("PSAD56", 4248, 24800, 17, 21, 24860, 17, 22),
    ("SIRGAS2000", 4674, 31954, 11, 22, 31960, 17, 25),
    ("SAD69", 4618, 29150, 18, 22, 29170, 17, 25),
    ("NAD27", 4267, 26700, 1, 22, None, None, None),
    ("NAD83", 4269, 26900, 1, 23, None, None, None),
    ("ETRS89", 4258, 25800, 28, 38, None, None, None),
    ("ED50", 4230, 23000, 28, 38, None, None, None),
)
_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "CAST(NULL AS INT)" if x is None else str(x) for x in row) + ")" for row in DATUMS)
DIMENSION = f"(VALUES {_ROWS}) AS d(datum, geographic, north, north_from, north_to, south_base, south_from, south_to)"


def utm_epsg(datum: str, zone: int, south: bool) -> int | None:
    """The code of a datum's zone, None where there is none."""
    row = next((r for r in DATUMS if r[0] == datum.upper()), None)
    base, first, last = row[5:] if row and south else row[2:5] if row else (None, 0, 0)
    return base + zone if base and first <= zone <= last else None


#: crs_candidates: the geographic system, or every UTM zone that legend, hint and hemisphere leave open. A northing over
#: 9 400 000 rules the northern hemisphere out. One candidate of a known datum, zone and hemisphere is confident.
CANDIDATES = f"""
WITH known AS (
  SELECT map_id, coalesce(datum, 'WGS84') AS datum, datum IS NOT NULL AS datum_known, kind, zone, south, longitude, northing,
         coalesce(zone, CAST(floor((longitude + 180) / 6) + 1 AS INT)) AS used_zone FROM {{legends}}),
options AS (
  SELECT k.*, o.is_south FROM known k CROSS JOIN (VALUES (true), (false)) AS o(is_south)
  WHERE (south IS NULL OR south = is_south) AND NOT (NOT is_south AND coalesce(northing, 0) > 9400000)),
coded AS (
  SELECT o.map_id, o.datum, datum_known, kind, zone, south,
         CASE WHEN is_south THEN CASE WHEN used_zone BETWEEN south_from AND south_to THEN south_base + used_zone END
              ELSE CASE WHEN used_zone BETWEEN north_from AND north_to THEN north + used_zone END END AS epsg
  FROM options o JOIN {DIMENSION} ON o.datum = d.datum),
together AS (
  SELECT map_id, epsg, datum_known, zone, south, 'utm' AS made FROM coded WHERE epsg IS NOT NULL
  UNION ALL SELECT map_id, geographic AS epsg, datum_known, zone, south, 'geo' AS made FROM known k JOIN {DIMENSION} ON k.datum = d.datum WHERE kind = 'geo')
SELECT map_id, CAST(epsg AS BIGINT) AS epsg, made,
       CASE WHEN made = 'geo' THEN datum_known ELSE datum_known AND zone IS NOT NULL AND south IS NOT NULL AND count(*) OVER (PARTITION BY map_id) = 1 END AS confident
FROM together
"""

# Semi-major axis and inverse flattening of the ellipsoids, and the one of each datum.
WGS84 = (6378137.0, 298.257223563)
ELLIPSOIDS = {
    "WGS84": WGS84,
    "GRS80": (6378137.0, 298.257222101),
    "International": (6378388.0, 297.0),
    "GRS67": (6378160.0, 298.25),
    "Clarke1866": (6378206.4, 294.978698213898),
}
ELLIPSOID_OF = {
    "WGS84": "WGS84", "PSAD56": "International", "SIRGAS2000": "GRS80", "SAD69": "GRS67",
    "NAD27": "Clarke1866", "NAD83": "GRS80", "ETRS89": "GRS80", "ED50": "International",
}
K0 = 0.9996


def _number(x: float) -> str:
    return f"{x:.17e}"


def series(ellipsoid: tuple[float, float] = WGS84) -> dict[str, list[float] | float]:
    """Coefficients of the transverse Mercator series to the fourth order of the third flattening."""
    a, inverse = ellipsoid
    n = 1 / (2 * inverse - 1)
    return {
        "radius": a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "e": 2 * math.sqrt(n) / (1 + n),
        "forward": [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4],
        "inverse": [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4],
        "latitude": [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4],
    }


def _sum(terms: list[float], shape: str) -> str:
    return " + ".join(f"{_number(c)} * " + shape.format(k=2 * (j + 1)) for j, c in enumerate(terms))


def forward_text(ellipsoid: tuple[float, float] = WGS84) -> str:
    """points(id, zone, south, lon, lat) -> easting and northing."""
    s = series(ellipsoid)
    e, radius = _number(s["e"]), _number(K0 * s["radius"])
    return f"""
WITH polar AS (
  SELECT id, south, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t, radians(lon - (6 * zone - 183)) AS dl FROM {{points}}),
flat AS (SELECT id, south, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM polar)
SELECT id, round(500000 + {radius} * (eta + {_sum(s["forward"], "cos({k} * xi) * sinh({k} * eta)")}), 3) AS easting,
       round(CASE WHEN south THEN 10000000 ELSE 0 END + {radius} * (xi + {_sum(s["forward"], "sin({k} * xi) * cosh({k} * eta)")}), 3) AS northing
FROM flat
"""


def inverse_text(ellipsoid: tuple[float, float] = WGS84) -> str:
    """points(id, zone, south, easting, northing) -> longitude, latitude and whether they lie in the zone's area of use,
    a degree of slack around it."""
    s = series(ellipsoid)
    radius = _number(K0 * s["radius"])
    return f"""
WITH scaled AS (
  SELECT id, zone, south, (northing - CASE WHEN south THEN 10000000 ELSE 0 END) / {radius} AS xi, (easting - 500000) / {radius} AS eta FROM {{points}}),
flat AS (
  SELECT id, zone, south, xi - ({_sum(s["inverse"], "sin({k} * xi) * cosh({k} * eta)")}) AS x, eta - ({_sum(s["inverse"], "cos({k} * xi) * sinh({k} * eta)")}) AS h FROM scaled),
polar AS (SELECT id, zone, south, asin(sin(x) / cosh(h)) AS chi, atan2(sinh(h), cos(x)) AS dl FROM flat),
degrees_ AS (
  SELECT id, zone, south, degrees(dl) + (6 * zone - 183) AS lon, degrees(chi + {_sum(s["latitude"], "sin({k} * chi)")}) AS lat FROM polar)
SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat,
       lon BETWEEN 6 * zone - 187 AND 6 * zone - 179 AND lat BETWEEN CASE WHEN south THEN -81 ELSE -1 END AND CASE WHEN south THEN 1 ELSE 85 END AS in_area
FROM degrees_
"""


#: rank_crs: candidates by error, those without one last, then in input order; a projected system replaces a geographic
#: one only if its error is below 0.85 of it.
RANK = """
WITH placed AS (
  SELECT map_id, epsg, rmse, seq, row_number() OVER (PARTITION BY map_id ORDER BY coalesce(RINT[rmse * 1e3] / 1e3, 1e300), seq) AS place,
         min(CASE WHEN epsg < 10000 THEN rmse END) OVER (PARTITION BY map_id) AS geographic, count(*) OVER (PARTITION BY map_id) AS n
  FROM {candidates})
SELECT map_id, CAST(epsg AS BIGINT) AS epsg, CAST(place AS BIGINT) AS place, round(rmse, 6) AS rmse,
       place = 1 AND n >= 2 AND epsg >= 10000 AND coalesce(rmse < 85e-2 * geographic, false) AS replaces
FROM placed
"""


#: area_of_use: whether a map's middle lies where its system is made for, a degree of slack around; null for unknown codes.
#: A projected middle goes back to degrees on the WGS84 ellipsoid, which is near enough for that.
_ZONES = f"""
  SELECT p.map_id, p.epsg, p.x, p.y, CAST(p.epsg - CASE WHEN p.epsg - d.north BETWEEN d.north_from AND d.north_to THEN d.north ELSE d.south_base END AS INT) AS zone,
         NOT coalesce(p.epsg - d.north BETWEEN d.north_from AND d.north_to, false) AS south
  FROM {{middles}} p JOIN {DIMENSION} ON p.epsg - d.north BETWEEN d.north_from AND d.north_to OR p.epsg - d.south_base BETWEEN d.south_from AND d.south_to"""


def area_text() -> str:
    """middles(map_id, epsg, x, y) -> lon, lat, in_area."""
    inverse = inverse_text().strip().removeprefix("WITH").replace("{points}", "zoned")
    return f"""
WITH zoned AS (SELECT map_id AS id, zone, south, x AS easting, y AS northing FROM ({_ZONES}) z),
back AS (WITH {inverse}),
plain AS (SELECT p.map_id, p.x AS lon, p.y AS lat FROM {{middles}} p JOIN {DIMENSION} ON p.epsg = d.geographic)
SELECT m.map_id, CAST(m.epsg AS BIGINT) AS epsg, round(coalesce(b.lon, p.lon), 4) AS lon, round(coalesce(b.lat, p.lat), 4) AS lat,
       CASE WHEN p.map_id IS NOT NULL THEN p.lon BETWEEN -181 AND 181 AND p.lat BETWEEN -91 AND 91 ELSE b.in_area END AS in_area
FROM {{middles}} m LEFT JOIN back b ON m.map_id = b.id LEFT JOIN plain p ON m.map_id = p.map_id
"""


#: crs_name: what a code of the dimension is called; codes outside it are unknown.
NAMES = f"""
SELECT c.epsg, CASE WHEN d.datum IS NULL THEN concat('EPSG:', CAST(c.epsg AS STRING), ' (unknown)') WHEN c.epsg = d.geographic THEN d.datum
                    WHEN c.epsg - d.north BETWEEN d.north_from AND d.north_to THEN concat(d.datum, ' / UTM ', CAST(c.epsg - d.north AS STRING), 'N')
                    ELSE concat(d.datum, ' / UTM ', CAST(c.epsg - d.south_base AS STRING), 'S') END AS name
FROM {{codes}} c LEFT JOIN {DIMENSION} ON c.epsg = d.geographic OR c.epsg - d.north BETWEEN d.north_from AND d.north_to OR c.epsg - d.south_base BETWEEN d.south_from AND d.south_to
"""


#: zones_of: the zone, hemisphere and ellipsoid of projected codes; other codes go.
ZONES_OF = f"""
SELECT c.epsg, CAST(c.epsg - CASE WHEN n.datum IS NOT NULL THEN n.north ELSE s.south_base END AS INT) AS zone, n.datum IS NULL AS south, e.ellipsoid
FROM {{codes}} c LEFT JOIN {DIMENSION.replace(" d(", " n(")} ON c.epsg - n.north BETWEEN n.north_from AND n.north_to
LEFT JOIN {DIMENSION.replace(" d(", " s(")} ON c.epsg - s.south_base BETWEEN s.south_from AND s.south_to
JOIN (VALUES {", ".join(f"('{d}', '{e}')" for d, e in ELLIPSOID_OF.items())}) AS e(datum, ellipsoid) ON e.datum = coalesce(n.datum, s.datum)
"""


def zones_of(codes: DataFrame) -> DataFrame:
    """codes(epsg) -> zone, south and ellipsoid of those that are projected."""
    return apply(ZONES_OF, codes=codes)


def area_of_use(middles: DataFrame) -> DataFrame:
    """middles(map_id, epsg, x, y), one row for each map -> lon, lat, in_area."""
    return apply(area_text(), middles=middles)


def crs_names(codes: DataFrame) -> DataFrame:
    """codes(epsg) -> their names."""
    return apply(NAMES, codes=codes)


def crs_candidates(legends: DataFrame) -> DataFrame:
    """legends(map_id, kind, datum, zone, south, longitude, northing) -> candidate codes."""
    return apply(CANDIDATES, legends=legends)


def utm_forward(points: DataFrame, ellipsoid: tuple[float, float] = WGS84) -> DataFrame:
    """points(id, zone, south, lon, lat) -> easting and northing; id may be of any type."""
    return apply(forward_text(ellipsoid), points=points)


def utm_inverse(points: DataFrame) -> DataFrame:
    return apply(inverse_text(), points=points)


def rank_crs(candidates: DataFrame) -> DataFrame:
    """candidates(map_id, epsg, rmse, seq) -> their places."""
    return apply(RANK, candidates=candidates)


# Fixed values of the EPSG registry: shift of each datum's center to that of WGS84, in metres.
SHIFTS = {"WGS84": (0, 0, 0), "PSAD56": (-288, 175, -376), "SIRGAS2000": (0, 0, 0), "SAD69": (-57, 1, -41), "NAD27": (-8, 160, 176), "NAD83": (0, 0, 0), "ETRS89": (0, 0, 0), "ED50": (-87, -98, -121)}


def _datum_rows() -> str:
    rows = []
    for name, shift in SHIFTS.items():
        a, inverse = ELLIPSOIDS[ELLIPSOID_OF[name]]
        rows.append(f"('{name}', {a:.3f}e0, {(2 - 1 / inverse) / inverse:.15f}e0, " + ", ".join(f"{d}e0" for d in shift) + ")")
    return f"(VALUES {', '.join(rows)}) AS d(datum, a, e2, dx, dy, dz)"


def shift_text() -> str:
    """shift_datum: to geocentric places, by the difference of the two centers, and back by Bowring's formula."""
    return f"""
WITH dims AS (SELECT * FROM {_datum_rows()}),
keyed AS (
  SELECT p.id, radians(lon) AS l, radians(lat) AS f, s.a AS a1, s.e2 AS e1, t.a AS a2, t.e2 AS e2, s.dx - t.dx AS dx, s.dy - t.dy AS dy, s.dz - t.dz AS dz
  FROM {{points}} p JOIN dims s ON p.source = s.datum JOIN dims t ON p.target = t.datum),
normal AS (SELECT *, a1 / sqrt(1 - e1 * sin(f) * sin(f)) AS n FROM keyed),
placed AS (SELECT id, a2, e2, n * cos(f) * cos(l) + dx AS x, n * cos(f) * sin(l) + dy AS y, n * (1 - e1) * sin(f) + dz AS z FROM normal),
turned AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * sqrt(1 - e2)) AS u FROM placed)
SELECT id, round(degrees(atan2(y, x)), 9) AS lon,
       round(degrees(atan2(z + e2 / sqrt(1 - e2) * a2 * power(sin(u), 3), r - e2 * a2 * power(cos(u), 3))), 9) AS lat
FROM turned
"""


def shift_datum(points: DataFrame) -> DataFrame:
    """points(id, lon, lat, source, target), names of datums -> the places on the target datum. Points of an unknown datum go."""
    return apply(shift_text(), points=points)


def well_known(datum: str, code: int, zone: int | None = None, south: bool = False) -> str:
    """A datum's geographic system, or one of its zones, in well-known text."""
    name = ELLIPSOID_OF[datum]
    axis, inverse = ELLIPSOIDS[name]
    geographic = next(r[1] for r in DATUMS if r[0] == datum)
    base = f'GEOGCS["{datum}",DATUM["{datum}",SPHEROID["{name}",{axis:.10g},{inverse:.12g}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","{geographic}"]]'
    if zone is None:
        return base
    values = {"latitude_of_origin": 0, "central_meridian": 6 * zone - 183, "scale_factor": K0, "false_easting": 500000, "false_northing": 10000000 * south}
    parameters = ",".join(f'PARAMETER["{k}",{v}]' for k, v in values.items())
    return f'PROJCS["{datum} / UTM zone {zone}{"S" if south else "N"}",{base},PROJECTION["Transverse_Mercator"],{parameters},UNIT["metre",1],AUTHORITY["EPSG","{code}"]]'


def projection_text(systems: DataFrame) -> DataFrame:
    """systems(map_id, epsg) -> the text that stands beside an image; null for codes outside the dimension, whose some 300
    codes are a small table."""
    rows = [(r[1], well_known(r[0], r[1])) for r in DATUMS]
    for datum, _, *bases in DATUMS:
        for south, (base, first, last) in enumerate((bases[:3], bases[3:])):
            rows += [(base + z, well_known(datum, base + z, z, bool(south))) for z in range(first, last + 1)] if base else []
    texts = systems.sparkSession.createDataFrame(rows, "epsg long, text string")
    return systems.join(F.broadcast(texts), "epsg", "left").select("map_id", "epsg", "text")
