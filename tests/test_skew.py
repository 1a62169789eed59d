"""Grids turned by more than four degrees keep their lines."""

import math

import pytest

from plumbline.operators import raster


@pytest.mark.parametrize("rotation", [5.5, -5.63])
def test_turned_grid(spark, rotation):
    specs = spark.createDataFrame([(1, 700, 520, rotation, 97)], "map_id long, width int, height int, rotation double, step int")
    lines = raster.detect_lines(raster.synthetic_maps(specs)).collect()
    m = math.tan(math.radians(rotation))
    for axis, other, numbers in (("x", 520, range(1, 7)), ("y", 700, range(1, 5))):
        found = [r for r in lines if r.axis == axis]
        for at in (97 * k for k in numbers):
            best = min((abs(r.intercept + r.slope * other / 2 - at) for r in found), default=99)
            assert best < 0.5, (axis, at, best)
        assert all(abs(abs(r.slope) - abs(m)) < 0.01 for r in found)
