"""Measuring sheets: the suite of drawn sheets through the whole batch, and each step against a plain version."""

from collections import deque
from dataclasses import replace

import numpy as np
import pytest

from plumbline.operators import peaks, scan
from plumbline.plans import batch

from .sheets import Sheet, geographic, items, pixels

SUITE = {
    "utm_lines": Sheet(rotation=1.3, seed=1), "utm_straight": Sheet(seed=2), "utm_units": Sheet(rotation=-2.5, seed=3, form="unit"),
    "utm_misread": Sheet(rotation=0.6, seed=4, drop=0.3, corrupt=0.2), "utm_large": Sheet(width=7000, height=5200, margin=300, res=2.0, rotation=0.7, seed=8),
    "geo_lines": geographic(rotation=-0.8, seed=2), "geo_letters": geographic(rotation=0.4, seed=6, letters=True), "utm_crosses": Sheet(style="crosses", rotation=0.9, seed=9),
    "utm_ticks": Sheet(style="ticks", rotation=-0.7, seed=11), "geo_ticks": geographic(style="ticks", rotation=0.5, seed=12), "none": Sheet(style="none", seed=13),
    "no_zone": Sheet(seed=5, legend="CARTA TOPOGRAFICA - ESCALA 1:50 000"), "many_misread": Sheet(rotation=0.6, seed=4, corrupt=0.35),
}
IMAGES = "map_id string, width int, height int, dpi double, pixels binary"
ITEMS = "map_id string, seq int, text string, x0 double, y0 double, x1 double, y1 double"


def image_rows(sheets):
    return [(k, s.width, s.height, None, bytearray(pixels(s))) for k, s in sheets.items()]


def item_rows(sheets):
    return [(k, i, t, *map(float, box)) for k, s in sheets.items() for i, (t, box) in enumerate(items(s))]


def error_of(sheet, gcps):
    """Root mean square and largest error of the affine fit of control points over a mesh, in pixels."""
    p = np.array([(r.px, r.py, 1.0, r.x, r.y) for r in gcps])
    fit = np.linalg.lstsq(p[:, :3], p[:, 3:] - p[:, 3:].mean(axis=0), rcond=None)[0]
    px, py = (v.ravel() for v in np.meshgrid(np.linspace(0, sheet.width - 1, 9), np.linspace(0, sheet.height - 1, 9)))
    off = np.stack([px, py, np.ones(81)], 1) @ fit + p[:, 3:].mean(axis=0) - np.stack(sheet.world(px, py), 1)
    off = np.hypot(*off.T) / sheet.res
    return float(np.sqrt((off**2).mean())), float(off.max())


@pytest.fixture(scope="module")
def suite(spark):
    """The suite, and beside it sheets that cannot be measured."""
    broken = [("cut short", 2400, 1800, None, bytearray(pixels(SUITE["utm_lines"])[:-5000])), ("no pixels", 300, 200, None, None), ("no size", 0, 0, None, bytearray()), ("blank", 400, 300, None, bytearray(b"\xf0" * 120000))]
    broken += [("twice", 300, 200, None, bytearray(b"\xf0" * 60000))] * 2
    images = spark.createDataFrame(image_rows(SUITE) + broken, IMAGES)
    return batch.run(images.repartition(8), spark.createDataFrame(item_rows(SUITE), ITEMS))


def test_statuses(suite):
    found = {r.map_id: r for r in suite.summary.collect()}
    assert set(found) == {*SUITE, "cut short", "no pixels", "no size", "blank", "twice"}
    assert {k for k, r in found.items() if r.status == "failed"} == {"cut short", "no pixels", "no size", "twice"}
    assert all((r.error is None) == (r.status != "failed") for r in found.values())
    want = {k: "ok" for k in SUITE} | {"none": "no_coordinates", "no_zone": "needs_review", "blank": "needs_review"}
    assert {k: found[k].status for k in want} == want
    modes = {k: "crosses" if "crosses" in k else "ticks" if "ticks" in k else "lines" for k in SUITE}
    assert {k: found[k].mode for k in SUITE} == modes
    assert {k: found[k].epsg for k in want if want[k] == "ok"} == {k: SUITE[k].epsg for k in want if want[k] == "ok"}


def test_accuracy(suite):
    """Below half a pixel on average and below one anywhere, for every sheet that can be solved."""
    points = suite.result.gcps.collect()
    errors = {k: error_of(s, [r for r in points if r.map_id == k]) for k, s in SUITE.items() if k != "none"}
    assert {k: e for k, e in errors.items() if not (e[0] < 0.5 and e[1] < 1)} == {}
    assert errors["many_misread"][1] < 0.5 and errors["utm_crosses"][1] < 0.5
    assert suite.result.models.filter("model <> 'affine'").count() == 0


def test_false_lines_have_no_value(suite):
    """Every line with a value lies where that value is drawn."""
    sheet = SUITE["utm_lines"]
    rows = suite.result.values.join(suite.detected.lines.filter("rank = 0"), ["map_id", "axis", "line_no"]).filter("map_id = 'utm_lines'").collect()
    assert len(rows) >= 15
    for r in rows:
        t = (r.low + r.high) / 2
        px, py = (r.intercept + r.slope * t, t) if r.axis == "x" else (t, r.intercept + r.slope * t)
        assert abs(sheet.world(px, py)["xy".index(r.axis)] - r.value) < 0.5 * sheet.res


def test_frames(suite, spark):
    y, x = np.mgrid[0:900, 0:1200]
    ring = np.where(np.abs(np.hypot((x - 600) / 450, (y - 450) / 350) - 1) < 0.006, 30, 240).astype(np.uint8)
    oval = batch.detect(spark.createDataFrame([("oval", 1200, 900, None, bytearray(ring.tobytes()))], IMAGES))
    found = {r.map_id: r for d, c in ((suite.detected, suite.chosen), (oval, spark.createDataFrame([("oval", 0)], "map_id string, rank int"))) for r in batch.frames(d, c).collect()}
    assert found["utm_straight"].source == "grid" and found["oval"].source == "contour" and "blank" not in found
    for name, want in (("utm_straight", SUITE["utm_straight"].frame()), ("oval", (150, 100, 1050, 800))):
        r = found[name]
        assert max(abs(a - b) for a, b in zip((r.x0, r.y0, r.x1, r.y1), want)) < 6


def test_stripes_do_not_matter(spark):
    """Lines of a sheet cut into other stripes are the same."""
    sheet = replace(SUITE["utm_lines"], width=900, height=700, margin=90, step=500.0, clutter=8)
    images = spark.createDataFrame(image_rows({"a": sheet}), IMAGES)
    first, second = ([tuple(r) for r in batch.detect(images, rows).lines.orderBy("rank", "axis", "line_no").collect()] for rows in (700, 130))
    assert len(first) > 10 and [r[:4] for r in first] == [r[:4] for r in second]
    assert max(abs(a - b) for r, q in zip(first, second) for a, b in zip(r[4:9], q[4:9])) < 1e-6


def test_hint_and_default_datum(spark):
    sheets = {k: Sheet(seed=5, legend="CARTA TOPOGRAFICA") for k in ("one", "two")}
    images = spark.createDataFrame(image_rows({"one": sheets["one"]}), IMAGES)
    read = spark.createDataFrame(item_rows({"one": sheets["one"]}), ITEMS)
    assert [(r.status, r.epsg) for r in batch.run(images, read, "18S", "PSAD56").summary.collect()] == [("ok", 24878)]


def test_snap(spark):
    """Rough places, four pixels right and three up of crosses and line crossings, come back to them."""
    sheets = {"crosses": SUITE["utm_crosses"], "lines": SUITE["utm_lines"]}
    images = spark.createDataFrame(image_rows(sheets), IMAGES)
    truth = {(k, f"{i}:{j}"): s.turn(s.place(s.values("x")[i], "x"), s.place(s.values("y")[j], "y")) for k, s in sheets.items() for i in range(1, 9) for j in range(1, 6)}
    rough = [(*k, x + 4, y - 3) for k, (x, y) in truth.items()] + [("lines", "beyond", 10.0, -50.0), ("lines", "edge", 2.0, 2.0)]
    points = spark.createDataFrame(rough, "map_id string, point_id string, px double, py double")
    got = {(r.map_id, r.point_id): (r.px, r.py) for r in scan.snap_points(scan.stripes(images), points).collect()}
    assert got.pop(("lines", "beyond")) == (10.0, -50.0) and got.pop(("lines", "edge")) == (2.0, 2.0) and set(got) == set(truth)
    off = {k: np.hypot(got[k][0] - truth[k][0], got[k][1] - truth[k][1]) for k in truth}
    # strokes of clutter that run through a window mislead a few
    assert sum(v < 1 for v in off.values()) >= 0.9 * len(off) and np.median([*off.values()]) < 0.2


# ---------------------------------------------------------------- plain versions
def plain_peaks(v, height, distance, prominence):
    """One peak after the other, by the definitions."""
    tops, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) and v[j] < v[i] and v[j - 1] == v[i]:
            tops.append((i + j - 1) // 2)
        i = max(j, i + 1)
    kept = []
    for p in sorted((p for p in tops if v[p] >= height), key=lambda p: (v[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def base(p, step):
        least, k = v[p], p
        while 0 <= k < len(v) and v[k] <= v[p]:
            least, k = min(least, v[k]), k + step
        return least

    return sorted(p for p in kept if v[p] - max(base(p, -1), base(p, 1)) >= prominence)


def test_peaks():
    rng = np.random.default_rng(0)
    for n in range(400):
        v = rng.integers(0, rng.integers(2, 12), rng.integers(0, 60)).astype(float)
        limits = (float(rng.integers(0, 6)), int(rng.integers(1, 7)), float(rng.integers(0, 5)))
        assert peaks.find(v, *limits).tolist() == plain_peaks(v.tolist(), *limits), n


def test_regions():
    """As a flood fill finds them."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.uniform(0.1, 0.7)
        seen, want = np.zeros_like(mask), set()
        for start in zip(*np.nonzero(mask)):
            if seen[start]:
                continue
            seen[start], queue, part = True, deque([start]), []
            while queue:
                y, x = queue.popleft()
                part.append(int(y * mask.shape[1] + x))
                for j in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                    for i in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                        if mask[j, i] and not seen[j, i]:
                            seen[j, i] = True
                            queue.append((j, i))
            want.add(tuple(sorted(part)))
        assert {tuple(sorted(r.tolist())) for r in scan.regions(mask)} == want


def test_ink_and_shrinking():
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 256, (40, 57)).astype(np.uint8)
    n = 15
    wide = np.pad(gray.astype(float), n // 2, mode="edge")
    mean = np.array([[wide[y : y + n, x : x + n].mean() for x in range(57)] for y in range(40)])
    assert (scan.ink_of(gray) == (gray <= np.rint(mean) - scan.DARKER)).all()
    for scale in (0.77, 0.5, 0.31):
        whole = scan.shrunk_rows(gray, 0, 0, 40, 40, scale)
        for rows in (7, 13, 25):
            parts = [scan.shrunk_rows(gray[max(0, a - 9) : a + rows + 9], max(0, a - 9), a, min(40, a + rows), 40, scale) for a in range(0, 40, rows)]
            assert (np.vstack(parts) == whole).all()
    half = scan.shrunk_rows(np.full((30, 30), 200, np.uint8), 0, 0, 30, 30, 0.4)
    assert half.shape == (12, 12) and (half == 200).all()


def test_turning_and_skew():
    sheet = Sheet(width=800, height=600, margin=60, step=400.0, rotation=2.2, clutter=3)
    gray = np.frombuffer(pixels(sheet), np.uint8).reshape(600, 800)
    angle = scan.skew_of(gray)
    assert abs(angle + 2.2) < 0.06
    _, back = scan.turned(scan.ink_of(gray), angle)
    x, y = back(100.0, 50.0)
    assert np.hypot(x - 400, y - 300) == pytest.approx(np.hypot(100 - (nw := np.ceil(800 * np.cos(np.radians(abs(angle))) + 600 * np.sin(np.radians(abs(angle))))) / 2, 50 - np.ceil(800 * np.sin(np.radians(abs(angle))) + 600 * np.cos(np.radians(abs(angle)))) / 2)) and nw > 800


def test_angle_of_points():
    rng = np.random.default_rng(3)
    c, s = np.cos(np.radians(0.9)), np.sin(np.radians(0.9))
    grid = np.array([(200.0 * i, 200.0 * j) for i in range(10) for j in range(7)])
    p = grid @ np.array([[c, -s], [s, c]]) + rng.normal(0, 0.1, grid.shape)
    assert abs(scan.skew_of_points(p) + 0.9) < 0.05
    lines = scan.lines_of_points(p + [300, 300], 2400)
    assert sum(line[0] == "x" for line in lines) == 10 and sum(line[0] == "y" for line in lines) == 7
