"""The warp against a plain version over whole images, and what cannot be warped."""

import numpy as np
import pytest

from plumbline.operators import warp
from plumbline.operators.transforms import predict

IMAGES = "map_id string, width int, height int, pixels binary, note string"
POINTS = "map_id string, gcp_id string, px double, py double, x double, y double, kind string, note string"


def picture(width, height, channels, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    base = 128 + 90 * np.sin(x / 17.0 + seed) * np.cos(y / 23.0)
    return np.stack([np.clip(base + 10 * c + rng.normal(0, 8, base.shape), 0, 255) for c in range(channels)], 2).astype(np.uint8)


def affine_world(px, py, degrees, res=2.0):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return 500000 + res * (c * px + s * py), 8600000 + res * (s * px - c * py)


def bent_world(px, py):
    x, y = affine_world(px, py, 3.0)
    return x + 4e-5 * (px - 300) * (py - 200), y + 3e-5 * (px - 300) ** 2


def leaning_world(px, py):
    w = 1 + 6e-5 * px + 3e-5 * py
    x, y = affine_world(px, py, -4.0)
    return 500000 + (x - 500000) / w, 8600000 + (y - 8600000) / w


def points_of(name, width, height, world, kind, n=5):
    grid = [(px, py) for py in np.linspace(5, height - 6, n) for px in np.linspace(3, width - 4, n)]
    return [(name, f"g{k}", float(px), float(py), *map(float, world(px, py)), kind, "n") for k, (px, py) in enumerate(grid)]


def plain(image, canvas, points):
    """The whole canvas at once, from a sheet with a white border."""
    height, width, _ = image.shape
    p = np.array([r[2:6] for r in sorted(points, key=lambda r: r[2:6])])
    x, y = np.meshgrid(canvas.x_min + (np.arange(canvas.out_width) + 0.5) * canvas.res_x, canvas.y_max - (np.arange(canvas.out_height) + 0.5) * canvas.res_y)
    at = predict(canvas.kind, p[:, 2:], p[:, :2], np.column_stack([x.ravel(), y.ravel()]))
    px, py = at[:, 0], at[:, 1]
    wide = np.full((height + 2, width + 2, image.shape[2]), 255.0)
    wide[1:-1, 1:-1] = image
    inside = (px > -1) & (px < width) & (py > -1) & (py < height)
    i, j = (np.floor(np.where(inside, v, 0)).astype(int) for v in (px, py))
    fx, fy = (px - i)[:, None], (py - j)[:, None]
    mixed = (wide[j + 1, i + 1] * (1 - fx) + wide[j + 1, i + 2] * fx) * (1 - fy) + (wide[j + 2, i + 1] * (1 - fx) + wide[j + 2, i + 2] * fx) * fy
    return np.where(inside[:, None], np.rint(mixed), 255).astype(np.uint8).reshape(canvas.out_height, canvas.out_width, -1)


def whole(canvas, tiles, channels):
    out = np.zeros((canvas.out_height, canvas.out_width, channels), np.uint8)
    for t in tiles:
        r, c = t.tile_row * warp.TILE, t.tile_col * warp.TILE
        out[r : r + t.height, c : c + t.width] = np.frombuffer(t.pixels, np.uint8).reshape(t.height, t.width, channels)
        assert np.allclose((t.x_min, t.y_max), (canvas.x_min + c * canvas.res_x, canvas.y_max - r * canvas.res_y), atol=1e-6)
    return out


SHEETS = {
    "turned": (1300, 900, 1, lambda x, y: affine_world(x, y, 20.0), "affine"), "color": (600, 700, 3, lambda x, y: affine_world(x, y, -7.0), "affine"),
    "leaning": (1024, 512, 1, leaning_world, "projective"), "bent": (640, 530, 1, bent_world, "poly2"), "plate": (530, 520, 1, bent_world, "tps"),
    "upside": (520, 300, 1, lambda x, y: affine_world(x, y, 180.0), "affine"), "straight": (1100, 700, 1, lambda x, y: affine_world(x, y, 0.001), "affine"), "pixel": (1, 1, 1, lambda x, y: affine_world(x, y, 0.0), "affine"),
}


@pytest.fixture(scope="module")
def warped(spark):
    pictures = {k: picture(s[0], s[1], s[2], n) for n, (k, s) in enumerate(SHEETS.items())}
    points = {k: points_of(k, s[0], s[1], s[3], s[4]) for k, s in SHEETS.items() if k != "pixel"}
    points["pixel"] = [("pixel", f"g{k}", float(x), float(y), *map(float, affine_world(x, y, 0.0)), "affine", "n") for k, (x, y) in enumerate([(0, 0), (5, 0), (0, 5)])]
    images = [(k, s[0], s[1], bytearray(pictures[k].tobytes()), "n") for k, s in SHEETS.items()]
    blank = bytearray(b"\xff" * 6000)
    images += [("short", 100, 60, blank[:-1], "n"), ("none", 100, 60, None, "n"), ("sizeless", 0, 0, bytearray(), "n"), ("twice", 100, 60, blank, "n"), ("twice", 100, 60, blank, "n"),
               ("line", 100, 60, blank, "n"), ("few", 100, 60, blank, "n"), ("vast", 2400, 10, bytearray(24000), "n"), ("free", 100, 60, blank, "n"), (None, 100, 60, blank, "n"), ("odd", 100, 60, blank, "n")]
    rows = [r for p in points.values() for r in p]
    for k in ("short", "none", "sizeless", "twice"):
        rows += points_of(k, 100, 60, lambda x, y: affine_world(x, y, 5.0), "affine")
    rows += [("line", f"g{k}", float(k), float(k), 2.0 * k, 2.0 * k, "affine", "n") for k in range(5)]
    rows += points_of("few", 100, 60, leaning_world, "poly2", 2) + [(None, *r[1:]) for r in points["color"]]
    rows += [("odd", *r[1:5], float("nan"), *r[6:]) for r in points["color"]]
    rows += points_of("vast", 2400, 10, lambda x, y: affine_world(x, y, 5.0), "affine")
    found = warp.warp(spark.createDataFrame(images, IMAGES).repartition(5), spark.createDataFrame(rows, POINTS).repartition(3), longest=2000)
    return pictures, points, {r.map_id: r for r in found.canvases.collect()}, found.tiles.collect(), {r.map_id: r.error for r in found.errors.collect()}


def test_equal_to_the_plain_version(warped):
    pictures, points, canvases, tiles, _ = warped
    assert set(canvases) == set(SHEETS)
    for k, canvas in canvases.items():
        mine = [t for t in tiles if t.map_id == k]
        assert len(mine) == -(-canvas.out_height // warp.TILE) * -(-canvas.out_width // warp.TILE)
        got = whole(canvas, mine, SHEETS[k][2])
        want = pictures[k] if not canvas.resampled else plain(pictures[k], canvas, points[k])
        # a value on a half may round either way between one fit of all pixels and one of a band
        assert np.abs(got.astype(int) - want).max() <= 1 and (got != want).mean() < 1e-4, k


def test_canvases(warped):
    _, points, canvases, _, _ = warped
    assert {k for k, c in canvases.items() if not c.resampled} == {"straight", "pixel"}
    straight = canvases["straight"]
    assert (straight.out_width, straight.out_height) == (1100, 700)
    for col, row in ((0, 0), (500, 300), (1099, 699)):
        at = straight.x_min + (col + 0.5) * straight.res_x, straight.y_max - (row + 0.5) * straight.res_y
        assert np.allclose(at, affine_world(col, row, 0.001), atol=0.05)
    for k, canvas in canvases.items():
        for _, _, _, _, x, y, _, _ in points[k] if k != "pixel" else []:
            assert canvas.x_min <= x <= canvas.x_min + canvas.out_width * canvas.res_x
            assert canvas.y_max - canvas.out_height * canvas.res_y <= y <= canvas.y_max


def test_what_cannot_be_warped(warped):
    errors = warped[4]
    assert set(errors) == {"short", "none", "sizeless", "twice", "line", "few", "vast", "odd"}
    assert "several sheets" in errors["twice"] and "longer than" in errors["vast"] and "span" in errors["line"]


def test_empty_and_number_ids(spark):
    images, points = spark.createDataFrame([], IMAGES), spark.createDataFrame([], POINTS)
    none = warp.warp(images, points)
    assert none.tiles.count() == none.canvases.count() == none.errors.count() == 0
    numbers = spark.createDataFrame([(7, 20, 10, bytearray(range(200)))], "map_id long, width int, height int, pixels binary")
    at = spark.createDataFrame([(7, *r[1:]) for r in points_of("a", 20, 10, lambda x, y: affine_world(x, y, 0.0), "affine")], POINTS.replace("map_id string", "map_id long"))
    assert [(r.map_id, bytes(r.pixels)) for r in warp.warp(numbers, at).tiles.collect()] == [(7, bytes(range(200)))]


def test_ink_stays_at_its_points(spark):
    """Crosses drawn at control points are dark at their world places on the canvas."""
    image = np.full((800, 1200), 240, np.uint8)
    points = points_of("m", 1200, 800, lambda x, y: affine_world(x, y, 11.0), "affine")
    for r in points:
        x, y = round(r[2]), round(r[3])
        image[max(0, y - 1) : y + 2, max(0, x - 9) : x + 10] = image[max(0, y - 9) : y + 10, max(0, x - 1) : x + 2] = 20
    found = warp.warp(spark.createDataFrame([("m", 1200, 800, bytearray(image.tobytes()), "n")], IMAGES), spark.createDataFrame(points, POINTS))
    canvas = found.canvases.collect()[0]
    out = whole(canvas, found.tiles.collect(), 1)[..., 0]
    for r in points:
        col, row = (r[4] - canvas.x_min) / canvas.res_x, (canvas.y_max - r[5]) / canvas.res_y
        assert out[int(row), int(col)] < 120
