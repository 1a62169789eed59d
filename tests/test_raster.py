"""Detected lines lie within half a pixel of the drawn ones; transformations recover known geometry; streams fit once."""

import math

import numpy as np
import pytest

from plumbline.operators import crosses, raster, transforms
from plumbline.streaming.arrivals import LABELS, fit_arrivals


@pytest.mark.parametrize("only_crosses", [False, True])
def test_lines_within_half_a_pixel(spark, only_crosses):
    specs = [(1, 700, 520, 1.3, 97), (2, 640, 700, -2.5, 110), (3, 500, 400, 0.0, 83)]
    images = raster.synthetic_maps(spark.createDataFrame(specs, "map_id long, width int, height int, rotation double, step int"), only_crosses).cache()
    lines = (crosses.lines_of_crosses(crosses.crosses(raster.stripes(images))) if only_crosses else raster.detect_lines(images)).collect()
    for map_id, width, height, rotation, step in specs:
        m = math.tan(math.radians(rotation))
        for axis, side, other in (("x", width, height), ("y", height, width)):
            found = [r for r in lines if r.map_id == map_id and r.axis == axis]
            ends = [step * k for k in range(1, side // step + 1) if 15 + abs(m) * other / 2 < step * k < side - 15 - abs(m) * other / 2]
            assert len(found) >= len(ends)
            for at in ends:
                best = min(found, key=lambda r: abs(r.intercept + r.slope * other / 2 - at))
                for t in (0.1 * other, 0.5 * other, 0.9 * other):
                    truth = at - (t - other / 2) * m if axis == "x" else at + (t - other / 2) * m
                    assert abs(best.intercept + best.slope * t - truth) < 0.5


@pytest.mark.parametrize("kind", ["affine", "projective", "poly2", "tps"])
def test_transformations(kind):
    rng = np.random.default_rng(1)
    source = rng.uniform(0, 2000, (25, 2))
    target = source @ np.array([[5.0, 0.2], [0.1, -5.0]]) + [318000, 8652000]
    at = rng.uniform(200, 1800, (9, 2))
    assert np.abs(transforms.predict(kind, source, target, at) - (at @ np.array([[5.0, 0.2], [0.1, -5.0]]) + [318000, 8652000])).max() < 1e-4


def test_stream_of_maps(spark, tmp_path):
    rows = [(1, "x", k, 100.0 * k, 3e5 + 1e3 * k) for k in range(5)]
    source, sink = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame(rows, LABELS).coalesce(1).write.parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        fit_arrivals(spark, str(source), str(sink), str(tmp_path / "state")).awaitTermination(120)
    assert [(r.n_inliers, r.slope) for r in spark.read.parquet(str(sink)).collect()] == [(5, 10.0)]
