"""Synthetic map sheets with known geometry, through the whole plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans.georeference import georeference

WIDTH, HEIGHT, RES = 2400, 1800, 5.0


def sheet(map_id, rotation=0.0, legend="PROYECCION UTM - ZONA 18 SUR - DATUM WGS 84 - ESCALA 1:50 000", misread=0.0, seed=0, geo=False):
    """Lines every 1000 m (or 5') and their labels on all four sides; some labels with a wrong digit."""
    rng = random.Random(seed)
    m = math.tan(math.radians(rotation))
    lines, items, seq = [], [], 0
    step = 1000 / RES if not geo else 416.0
    for axis, size, other in (("x", WIDTH, HEIGHT), ("y", HEIGHT, WIDTH)):
        for k in range(1, int((size - 2 * 170) / step) + 1):
            at = 170 + step * (k - 0.5)
            slope = -m if axis == "x" else m
            lines.append((map_id, axis, k, slope, at - slope * other / 2))
            for side in (120, other - 120):
                if geo:
                    minutes = 76 * 60 + 55 - 5 * k if axis == "x" else 11 * 60 + 50 + 5 * k
                    t = f"{minutes // 60}°{minutes % 60:02d}'"
                else:
                    value = 318000 + 1000 * k if axis == "x" else 8652000 - 1000 * k
                    s = str(value)
                    if rng.random() < misread:
                        j = rng.randrange(3)
                        s = s[:j] + rng.choice([d for d in "123456789" if d != s[j]]) + s[j + 1 :]
                    t = f"{s[:-6]} {s[-6:-3]} {s[-3:]}".strip()
                along = at + slope * (side - other / 2)
                cx, cy = (along, side) if axis == "x" else (side, along)
                items.append((map_id, seq, t, cx - 40.0, cy - 10.0, cx + 40.0, cy + 10.0))
                seq += 1
    if legend:
        items.append((map_id, seq, legend, 900.0, 1760.0, 1500.0, 1790.0))
    return lines, items


@pytest.fixture(scope="module")
def result(spark):
    sheets = {
        1: sheet(1, 1.3), 2: sheet(2), 3: sheet(3, 0.6, misread=0.35, seed=11), 4: sheet(4, legend="CARTA TOPOGRAFICA - ESCALA 1:50 000"),
        5: sheet(5, -0.8, legend="COORDENADAS GEOGRAFICAS - DATUM WGS 84 - ESCALA 1:100 000", geo=True), 6: (sheet(6)[0], [(6, 0, "RIO CHILLON", 1.0, 1.0, 9.0, 9.0)]), 7: ([], []),
    }
    maps = spark.createDataFrame([(k, WIDTH, HEIGHT, None) for k in sheets], "map_id long, width int, height int, dpi double")
    items = spark.createDataFrame([i for s in sheets.values() for i in s[1]], "map_id long, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([x for s in sheets.values() for x in s[0]], "map_id long, axis string, line_no int, slope double, intercept double")
    return georeference(maps, items, lines)


def test_status(result):
    found = {r.map_id: r for r in result.status.collect()}
    assert {k: r.status for k, r in found.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "needs_review", 5: "ok", 6: "no_coordinates", 7: "needs_review"}
    assert found[1].epsg == found[2].epsg == found[3].epsg == 32718 and found[5].epsg == 4326
    assert max(found[k].rmse for k in (1, 2, 3, 5)) < 0.5


def test_every_line_has_its_value(result):
    values = result.values.filter("map_id = 3 and axis = 'x'").orderBy("line_no").collect()
    assert [r.value for r in values] == [318000.0 + 1000 * r.line_no for r in values] and len(values) == 10
    assert result.gcps.filter("map_id = 2").count() == 10 * result.values.filter("map_id = 2 and axis = 'y'").count()
    signs = result.values.filter("map_id = 5").agg(F.max("value")).first()[0]
    assert signs < 0
