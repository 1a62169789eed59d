"""Operators against known geometry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import crs, fitting, layout, matching
from plumbline.sources import deliverables


def test_axis_fit_rejects_misread_labels(spark):
    random.seed(11)
    rows = [(1, "x", k, 150.0 + 200.0 * k, 319000.0 + 1000 * k + (random.choice([-7000, 20000, 300]) if k % 3 == 1 else 0)) for k in range(10)]
    fit = fitting.axis_fit(spark.createDataFrame(rows, "map_id long, axis string, seq int, pos double, value double")).collect()
    assert len(fit) == 1 and fit[0].slope == pytest.approx(5.0) and fit[0].n_inliers == 7


def test_affine_recovers_truth_and_leave_one_out(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(9):
        px, py = float(100 * (k % 3)), float(90 * (k // 3))
        rows.append((1, f"P{k}", px, py, 318000 + 5 * px + 0.1 * py + rng.normal(), 8652000 + 0.2 * px - 5 * py + rng.normal()))
    gcps = spark.createDataFrame(rows, "map_id long, gcp_id string, px double, py double, x double, y double")
    p = np.array([[r[2], r[3], 1] for r in rows])
    w = np.array([[r[4], r[5]] for r in rows])
    m = np.linalg.lstsq(p, w, rcond=None)[0]
    fit = fitting.affine_fit(gcps).first()
    assert [fit.a, fit.b, fit.c, fit.d] == pytest.approx([m[0, 0], m[1, 0], m[0, 1], m[1, 1]], abs=1e-5) and not fit.mirrored
    errors = []
    for k in range(9):
        keep = np.arange(9) != k
        n = np.linalg.lstsq(p[keep], w[keep], rcond=None)[0]
        errors.append(((p[k] @ n - w[k]) ** 2).sum())
    assert fitting.affine_loo(gcps).first().loo_rmse == pytest.approx(math.sqrt(np.mean(errors)), abs=0.006)


@pytest.mark.parametrize("datum, zone, south, code", [("WGS84", 18, True, 32718), ("WGS84", 18, False, 32618), ("PSAD56", 18, True, 24878), ("PSAD56", 17, False, 24817), ("SIRGAS2000", 18, True, 31978), ("SAD69", 18, True, 29188), ("NAD27", 18, True, None), ("WGS84", 61, True, None)])
def test_codes(datum, zone, south, code):
    assert crs.utm_epsg(datum, zone, south) == code


def test_transverse_mercator_round_trip(spark):
    rows = [(k, 18, k % 2 == 0, -77.9 + 0.6 * k, (-1 if k % 2 == 0 else 1) * 9.0 * k) for k in range(9)]
    there = crs.utm_forward(spark.createDataFrame(rows, "id long, zone int, south boolean, lon double, lat double"))
    back = crs.utm_inverse(there.withColumn("zone", F.lit(18)).withColumn("south", F.col("id") % 2 == 0)).orderBy("id").collect()
    for r, (_, _, _, lon, lat) in zip(back, rows):
        assert (r.lon, r.lat) == (pytest.approx(lon, abs=1e-7), pytest.approx(lat, abs=1e-7)) and r.in_area
    assert there.filter("id = 0").first().northing == pytest.approx(10_000_000, abs=1e-3)


def test_tiles(spark):
    maps = spark.createDataFrame([(1, 5000, 3000), (2, 500, 400)], "map_id long, width int, height int")
    found = layout.tiles(maps)
    assert found.filter("map_id = 1").count() == 6 and found.filter("map_id = 2").collect() == [(2, 0, 0, 500, 400)]
    assert found.filter("map_id = 1").agg(F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))).first() == (5000, 3000)


def test_rotated_boxes(spark):
    rows = [(1, k, 320.0, 150.0, 399.0, 169.0, 0, 600, 400, 1.0, 0.0, 0.0) for k in range(1)]
    rows += [(1, 1, 400 - 1 - 169.0, 320.0, 400 - 1 - 150.0, 399.0, 90, 600, 400, 1.0, 0.0, 0.0)]
    schema = "map_id long, seq int, x0 double, y0 double, x1 double, y1 double, rotation int, wc int, hc int, upscale double, dx double, dy double"
    for r in layout.unrotate_boxes(spark.createDataFrame(rows, schema)).collect():
        assert tuple(r)[2:] == (320.0, 150.0, 399.0, 169.0)


def test_cells(spark):
    region = layout.cell_region(F.col("t"), F.lit(640), F.lit(430))
    rows = spark.createDataFrame([("B2:C3",), ("c3:b2",), ("J7",), ("K1",), ("A0",)], "t string").select(region.alias("r")).collect()
    assert [r.r and tuple(r.r) for r in rows] == [(64, 64, 128, 128), (64, 64, 128, 128), (576, 384, 64, 46), None, None]


def test_phrases(spark):
    words = [("8", 100, 112), ("650", 120, 156), ("000", 164, 200), ("N", 203, 215), ("8", 900, 912), ("651", 920, 956), ("000", 964, 1000)]
    rows = [(1, 0, k, t, float(a), float(b), 20.0) for k, (t, a, b) in enumerate(words)]
    found = matching.phrases(spark.createDataFrame(rows, "map_id long, row_no int, seq int, text string, x0 double, x1 double, height double")).orderBy("x0").collect()
    assert [(r.text, r.x0, r.x1) for r in found] == [("8 650 000 N", 100, 215), ("8 651 000", 900, 1000)]


def test_points_file_round_trip(spark, tmp_path):
    gcps = spark.createDataFrame([(1, "V1H1", 10.5, 20.25, 318350.0, 8652700.0, True), (1, "V1H2", 11.0, 90.0, 318351.0, 8652000.0, False)], "map_id long, gcp_id string, px double, py double, x double, y double, enabled boolean")
    residuals = spark.createDataFrame([(1, "V1H1", 0.3, -0.4)], "map_id long, gcp_id string, dx double, dy double")
    lines = deliverables.point_rows(gcps, residuals).orderBy("gcp_id").select("line").collect()
    assert lines[0].line == "318350.000000,8652700.000000,10.500,-20.250,1,0.3000,-0.4000,0.5000" and lines[1].line.endswith(",0,0.0000,0.0000,0.0000")
    (tmp_path / "a.points").write_text("#CRS:EPSG:32718\n" + deliverables.POINTS_HEADER + "\n" + "\n".join(r.line for r in lines) + "\n")
    assert [(r.px, r.py, r.x, r.enabled) for r in deliverables.read_points(spark, str(tmp_path)).orderBy("px").collect()] == [(10.5, 20.25, 318350.0, True), (11.0, 90.0, 318351.0, False)]


def test_boxes_are_read_one_by_one(spark):
    """A better reading moves the box that later ones are held against: 3 overlaps 2 but no longer 1, and 4 is no duplicate of
    2 any more."""
    rows = [
        (1, 1, "old", 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, "new", 2.0, 0.0, 12.0, 10.0, 0.9), (1, 3, "near", 4.0, 0.0, 14.0, 10.0, 0.4),
        (1, 4, "apart", 0.0, 0.0, 7.0, 10.0, 0.3), (1, 5, " ", 50.0, 0.0, 60.0, 10.0, 0.9), (1, 6, "longer", 2.0, 0.0, 12.0, 10.0, 0.9), (2, 1, "one", 0.0, 0.0, 1.0, 1.0, 0.1),
    ]
    boxes = spark.createDataFrame(rows, "map_id long, seq int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    assert {(r.map_id, r.text) for r in matching.box_duplicates(boxes).collect()} == {(1, "longer"), (1, "apart"), (2, "one")}


def test_snapping_over_fits_that_carry_a_step(spark):
    """The batch hands fits that have a step of their own; the one of steps counts."""
    lines = spark.createDataFrame([(1, "x", 1, 100.0), (1, "x", 2, 151.0), (1, "y", 1, 40.0)], "map_id long, axis string, line_no int, pos double")
    fits = spark.createDataFrame([(1, "x", 10.0, 3e5, 7.0), (1, "y", -10.0, 8e6, 7.0)], "map_id long, axis string, slope double, intercept double, step double")
    steps = spark.createDataFrame([(1, "x", 1000.0), (1, "y", 200.0)], "map_id long, axis string, step double")
    found = {(r.axis, r.line_no): r.value for r in fitting.snap_values(lines, fits, steps).collect()}
    assert found == {("x", 1): 301000.0, ("x", 2): None, ("y", 1): 7999600.0}


def test_reading_order_takes_its_limit(spark):
    boxes = spark.createDataFrame([(1, k, str(k), 100.0 - k, 5.0) for k in range(5)], "map_id long, seq int, text string, cx double, cy double")
    assert [r.text for r in matching.reading_order(boxes, 2).orderBy("place").collect()] == ["4", "3"]


def test_trimmed_line_in_rounds(spark):
    """Against numpy, over groups where one round is too few; single points and points on one spot keep the level median."""
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        t = np.arange(60.0)
        v = 0.3 * t + 5 + rng.normal(0, 0.4, 60) + np.where(rng.random(60) < 0.05 * g, rng.normal(0, 30, 60), 0) + np.where(t > 60 - 2 * g, 9, 0)
        rows += [(g, float(a), float(b)) for a, b in zip(t, v)]
    rows += [(20, 1.0, 4.0), (21, 1.0, 2.0), (21, 1.5, 4.0), (21, 1.2, 30.0)]
    got = {r.group_id: r for r in fitting.trimmed_line(spark.createDataFrame(rows, "group_id long, t double, v double")).collect()}
    several = 0
    for g in got:
        t, v = np.array([r[1:] for r in rows if r[0] == g]).T
        stays, slope, level, changes = np.full(len(t), True), 0.0, np.median(v), 0
        for _ in range(4):
            if stays.sum() > 1 and t[stays].max() - t[stays].min() > 1:
                (slope, level), *_ = np.linalg.lstsq(np.stack([t[stays], np.ones(stays.sum())], 1), v[stays], rcond=None)
            off = v - slope * t - level
            limit = max(1.0, 2.5 * 1.4826 * np.median(np.abs(off[stays] - np.median(off[stays]))))
            inside = np.abs(off) <= limit
            if inside.sum() > 1:
                changes += bool((inside != stays).any())
                stays = inside
        several += changes > 1
        assert (got[g].n_kept, got[g].slope, got[g].intercept) == (stays.sum(), pytest.approx(slope, abs=1e-5), pytest.approx(level, abs=1e-3)), g
    assert several >= 4 and len(got) == 14 and got[20].slope == 0


def test_islands_of_repeated_values(spark):
    values = [v for v in (1.0, 2.0, 9.0, 10.0, 11.0, 30.0, 31.5) for _ in range(40)]
    found = matching.islands(spark.createDataFrame([(1, v) for v in values], "group_id int, v double").repartition(5), 2.5).orderBy("cluster").collect()
    assert [(r.cluster, r.n, r.low, r.high) for r in found] == [(1, 80, 1.0, 2.0), (2, 120, 9.0, 11.0), (3, 80, 30.0, 31.5)]
