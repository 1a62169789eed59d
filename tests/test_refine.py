"""Sheets that need a decision: false lines, a line a little off, a tilted photograph, degrees drawn in a projection."""

import math

import numpy as np
import pytest

from plumbline.operators import crs, fitting, transforms
from plumbline.plans.georeference import georeference

from .test_georeference import HEIGHT, WIDTH, sheet

LEGEND = "COORDENADAS GEOGRAFICAS - DATUM WGS 84 - ESCALA 1:100 000"


def with_roads(map_id):
    """Off-lattice lines close to the grid's own, nearer to the labels' spacing than a lattice allows."""
    lines, items = sheet(map_id)
    roads = [(map_id, "x", 100 + k, 0.0, 170 + 200 * (k - 0.5) + 57.0) for k in range(1, 5)]
    return lines + roads, items


def with_shift(map_id, numbers, by):
    lines, items = sheet(map_id)
    return [(m, a, k, s, i + (by if a == "x" and k in numbers else 0.0)) for m, a, k, s, i in lines], items


def tilted(map_id):
    """Meridians that fan out and rows that widen downwards, as a photograph taken at an angle shows them."""
    h = np.array([[1.0, 0.02, -20.0], [0.01, 1.0, -12.0], [8e-6, 1.2e-5, 1.0]])

    def seen(x, y):
        a, b, c = (h @ [x, y, 1.0]).tolist()
        return a / c, b / c

    lines, items, seq = [], [], 0
    for axis, size, other in (("x", WIDTH, HEIGHT), ("y", HEIGHT, WIDTH)):
        for k in range(1, int((size - 340) / 200) + 1):
            at = 170 + 200 * (k - 0.5)
            ends = [seen(at, t) if axis == "x" else seen(t, at) for t in (0, other)]
            (x0, y0), (x1, y1) = ends
            slope = (x1 - x0) / (y1 - y0) if axis == "x" else (y1 - y0) / (x1 - x0)
            lines.append((map_id, axis, k, slope, x0 - slope * y0 if axis == "x" else y0 - slope * x0))
            for side in (120, other - 120):
                cx, cy = seen(at, side) if axis == "x" else seen(side, at)
                value = 318000 + 1000 * k if axis == "x" else 8652000 - 1000 * k
                t = f"{value // 1000 // 1000 or ''} {value // 1000 % 1000:03d} {value % 1000:03d}".strip()
                items.append((map_id, seq, t, cx - 40.0, cy - 10.0, cx + 40.0, cy + 10.0))
                seq += 1
    items.append((map_id, seq, "PROYECCION UTM - ZONA 18 SUR - DATUM WGS 84 - ESCALA 1:50 000", 900.0, 1760.0, 1500.0, 1790.0))
    return lines, items


def transverse(lon, lat, zone=18):
    """Easting and northing by the plain power series in the longitude difference, good to centimetres in a zone."""
    a, f = 6378137.0, 1 / 298.257223563
    e2, p, d = f * (2 - f), math.radians(lat), math.radians(lon - (6 * zone - 183))
    second, t, n = e2 / (1 - e2), math.tan(p) ** 2, a / math.sqrt(1 - e2 * math.sin(p) ** 2)
    c, w = second * math.cos(p) ** 2, d * math.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64) * p - (3 * e2 / 8 + 3 * e2**2 / 32) * math.sin(2 * p) + 15 * e2**2 / 256 * math.sin(4 * p))
    east = 0.9996 * n * (w + (1 - t + c) * w**3 / 6) + 500000
    north = 0.9996 * (m + n * math.tan(p) * (w**2 / 2 + (5 - t + 9 * c + 4 * c * c) * w**4 / 24)) + 10000000
    return east, north


def drawn_in_zone(map_id):
    """A graticule of 15 minutes far from its zone's middle, drawn in the zone's projection: 100 m a pixel."""
    center = transverse(-77.75, -45.0)

    def at(lon, lat):
        e, n = transverse(lon, lat)
        return WIDTH / 2 + (e - center[0]) / 100, HEIGHT / 2 - (n - center[1]) / 100

    lines, items, seq = [], [], 0
    for axis, values in (("x", [-77.75 + k / 4 for k in range(-4, 5)]), ("y", [-45 + k / 4 for k in range(-2, 3)])):
        for k, v in enumerate(values, 1):
            ends = [at(v, -45.6), at(v, -44.4)] if axis == "x" else [at(-78.9, v), at(-76.6, v)]
            (x0, y0), (x1, y1) = ends
            slope = (x1 - x0) / (y1 - y0) if axis == "x" else (y1 - y0) / (x1 - x0)
            cut = x0 - slope * y0 if axis == "x" else y0 - slope * x0
            lines.append((map_id, axis, k, slope, cut))
            minutes = round(abs(v) * 60)
            for side in (60, (HEIGHT if axis == "x" else WIDTH) - 60):
                cx, cy = (cut + slope * side, side) if axis == "x" else (side, cut + slope * side)
                items.append((map_id, seq, f"{minutes // 60}°{minutes % 60:02d}'", cx - 30.0, cy - 9.0, cx + 30.0, cy + 9.0))
                seq += 1
    items.append((map_id, seq, LEGEND, 900.0, 1790.0, 1500.0, 1799.0))
    return lines, items


@pytest.fixture(scope="module")
def result(spark):
    sheets = {1: sheet(1), 2: with_roads(2), 3: with_shift(3, {4}, 1.9), 4: with_shift(4, {3, 8}, 1.9), 5: tilted(5), 6: drawn_in_zone(6), 7: ([], [])}
    maps = spark.createDataFrame([(k, WIDTH, HEIGHT, None) for k in sheets], "map_id long, width int, height int, dpi double")
    items = spark.createDataFrame([i for s in sheets.values() for i in s[1]], "map_id long, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([x for s in sheets.values() for x in s[0]], "map_id long, axis string, line_no int, slope double, intercept double")
    return georeference(maps, items, lines)


def test_decisions(result):
    status = {r.map_id: r for r in result.status.collect()}
    assert {k: status[k].model for k in (1, 2, 3, 4, 5)} == {1: "affine", 2: "affine", 3: "affine", 4: "affine", 5: "projective"}
    assert all(status[k].status == "ok" and status[k].rmse < 0.5 for k in (1, 2, 3, 4))
    assert status[5].rmse < 0.05 and status[5].loo < 0.1 and status[7].status == "needs_review"


def test_false_lines_have_no_value(result):
    dropped = {(r.map_id, r.axis, r.line_no) for r in result.dropped.collect()}
    assert dropped == {(3, "x", 4), (4, "x", 3), (4, "x", 8)}
    valued = {(r.map_id, r.line_no) for r in result.values.filter("axis = 'x'").collect()}
    assert not {(2, 100 + k) for k in range(1, 5)} & valued and {(2, k) for k in range(1, 11)} <= valued
    assert not {(3, 4), (4, 3), (4, 8)} & valued
    assert result.gcps.filter("map_id = 3 and gcp_id like 'V4H%'").isEmpty()


def test_system_of_degrees(result):
    ranks = {r.epsg: r for r in result.ranks.filter("map_id = 6").collect()}
    assert ranks[32718].replaces and ranks[32718].rmse < 0.85 * ranks[4326].rmse
    found = result.status.filter("map_id = 6").first()
    assert found.epsg == 32718
    p = result.gcps.filter("map_id = 6").first()
    assert p.label_x < 0 and (p.x, p.y) == pytest.approx(transverse(p.label_x, p.label_y), abs=0.5)


def test_own_ellipsoids(spark):
    """The datum's own figure of the earth, against the meridian's arc summed up numerically."""
    codes = spark.createDataFrame([(32718,), (24878,), (4326,), (26718,)], "epsg long")
    found = {r.epsg: (r.zone, r.south, r.ellipsoid) for r in crs.zones_of(codes).collect()}
    assert found == {32718: (18, True, "WGS84"), 24878: (18, True, "International"), 26718: (18, False, "Clarke1866")}
    points = spark.createDataFrame([(1, 18, False, -75.0, 45.0)], "id int, zone int, south boolean, lon double, lat double")
    by = {n: crs.utm_forward(points, e).first().northing for n, e in crs.ELLIPSOIDS.items()}
    for name, (a, inverse) in crs.ELLIPSOIDS.items():
        e2 = (2 - 1 / inverse) / inverse
        middles = (np.arange(20000) + 0.5) * math.pi / 4 / 20000
        arc = float((a * (1 - e2) * (1 - e2 * np.sin(middles) ** 2) ** -1.5).sum()) * math.pi / 4 / 20000
        assert by[name] == pytest.approx(0.9996 * arc, abs=0.01)


def test_rule_of_kinds(spark):
    """A quadratic sheet where the projective kind does not help still gets the quadratic kind."""
    rows = [(1, 30, 0.9, 0.1, 0.1), (2, 30, 4.0, 2.0, 1.5), (3, 30, 4.0, 2.0, 0.9), (4, 30, 4.0, 3.9, 0.5), (5, 30, 4.0, None, 0.5), (6, 7, 4.0, 1.0, 0.5), (7, 12, 4.0, 1.0, 0.1), (8, 30, None, 1.0, 0.1), (9, 30, 2.0, 1.0, 0.1)]
    errors = spark.createDataFrame(rows, "map_id long, n long, loo_affine double, loo_projective double, loo_poly2 double")
    found = {r.map_id: r.kind for r in fitting.model_choice(errors).collect()}
    assert found == {1: "affine", 2: "projective", 3: "poly2", 4: "poly2", 5: "poly2", 6: "affine", 7: "projective", 8: "affine", 9: "projective"}


def test_auto_fit_agrees_with_the_errors_of_every_kind(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m, bend in ((1, 0.0), (2, 3e-5), (3, 0.0)):
        for k in range(36 if m < 3 else 5):
            x, y = 300.0 * (k % 6), 250.0 * (k // 6 if m < 3 else k * k % 3)
            px, py = x + bend * x * x + float(rng.normal(0, 0.2)), y + bend * x * y + bend * y * y + float(rng.normal(0, 0.2))
            rows.append((m, f"P{k:02d}", px, py, 3e5 + 5 * x, 8e6 - 5 * y))
    rows += [(4, f"P{k}", 10.0 * k, 5.0 * k, 1e3 * k, 2e3 * k) for k in range(6)] + [(5, "P0", 1.0, 1.0, 2.0, 2.0)]
    gcps = spark.createDataFrame(rows, "map_id long, gcp_id string, px double, py double, x double, y double")
    fits = {(r.map_id, r.kind): r for r in transforms.fit_errors(gcps).collect()}
    auto = transforms.auto_fit(gcps).toPandas().groupby("map_id")
    first = {m: g.iloc[0] for m, g in auto}
    assert set(first) == {1, 2, 3} and first[1].kind == "affine" and first[2].kind == "poly2"
    for m, r in first.items():
        want = fits[m, r.kind]
        assert (round(r.rmse, 3), round(r.loo, 3)) == pytest.approx((want.rmse, want.loo), abs=2e-3)
    assert all(g.rmse.iloc[0] == pytest.approx(math.sqrt((g.rx**2 + g.ry**2).mean())) for _, g in auto)


def test_stacks_of_maps_are_fitted_as_each_map_alone():
    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 12):
        world = rng.uniform(-1, 1, (40, n, 2)) * 1e3
        pixel = world @ np.array([[0.2, 0.01], [0.02, -0.2]]) + rng.normal(0, 2, world.shape)
        for kind, least in transforms.LEAST.items():
            if n < least:
                continue
            alone = np.stack([transforms.predict(kind, w, p, w) for w, p in zip(world, pixel)])
            assert np.abs(transforms.predictions(kind, world, pixel, world) - alone).max() < 1e-6
            if n > least + 1:
                left = [np.sqrt(np.mean([((transforms.predict(kind, np.delete(w, k, 0), np.delete(p, k, 0), w[k : k + 1])[0] - p[k]) ** 2).sum() for k in range(n)])) for w, p in zip(world, pixel)]
                assert np.allclose(transforms._loo_direct(kind, world, pixel), left, rtol=1e-6)
    doubled = rng.uniform(-1, 1, (2, 6, 2))
    doubled[1] = 0.5  # a singular plate leaves the others of its stack their fit
    found = transforms.predictions("tps", doubled, doubled * 2, doubled)
    assert np.abs(found[0] - doubled[0] * 2).max() < 1e-9 and np.isnan(found[1]).all()


def test_large_maps_leave_every_point_out(spark):
    """Against a fit without each point; one that 150 points spread evenly over 200 would pass by stands off."""
    rng = np.random.default_rng(8)
    world = rng.uniform(0, 1, (200, 2)) * 1e3
    pixel = world @ np.array([[0.2, 0.01], [0.02, -0.2]]) + rng.normal(0, 0.1, world.shape)
    pixel[3] += 40
    assert 3 not in np.linspace(0, 199, 150).astype(int)
    rows = [(1, f"P{k:03d}", *map(float, pixel[k]), *map(float, world[k])) for k in range(200)]
    gcps = spark.createDataFrame(rows, "map_id long, gcp_id string, px double, py double, x double, y double")
    found = {r.kind: r.loo for r in transforms.fit_errors(gcps).collect()}
    auto = transforms.auto_fit(gcps).first()
    for kind in transforms.LEAST:
        off = [transforms.predict(kind, np.delete(world, k, 0), np.delete(pixel, k, 0), world[k : k + 1])[0] - pixel[k] for k in range(200)]
        want = np.sqrt((np.array(off) ** 2).sum(axis=1).mean())
        assert found[kind] == pytest.approx(want, abs=1e-4)
        if kind == auto.kind:
            assert auto.loo == pytest.approx(want, abs=1e-6)


def test_points_that_alone_hold_a_term_up():
    """Closed forms against a fit without each point, over maps on a line, with one point off it and with points on two lines."""
    rng = np.random.default_rng(9)
    for n in (7, 10, 20):
        world = rng.uniform(-1, 1, (4, n, 2)) * 1e3
        pixel = world @ np.array([[0.2, 0.01], [0.02, -0.2]]) + rng.normal(0, 2, world.shape)
        world[0, :, 1], world[1, 1:, 1], world[2, :, 1] = 2 * world[0, :, 0], 2 * world[1, 1:, 0], np.where(np.arange(n) % 2, 3.0, -3.0)
        with np.errstate(all="ignore"):
            for kind, least in transforms.LEAST.items():
                if n > least + 1:
                    fitted = transforms._fit_off(kind, world, pixel)
                    has = ~np.isnan(fitted).any(axis=(1, 2))
                    found, want = (f(kind, world[has], pixel[has], *more) for f, more in ((transforms._left_out, (fitted[has],)), (transforms._loo_direct, ())))
                    assert np.allclose(found, want, rtol=1e-6, equal_nan=True), (n, kind)
