"""Files in and out: points files, documents, summaries, systems as text, and changes of datum against known places."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from plumbline.operators import crs
from plumbline.sources import deliverables


def test_points_files(spark, tmp_path):
    (tmp_path / "a.points").write_text("#CRS: EPSG:32718\nmapX,mapY,sourceX,sourceY,enable,dX,dY,residual\n319000.5,8650000,100.25,-50.5,1,0,0,0\n320000,8650000,300,-50,0,0,0,0\nnot,a,row,x\n1,2\n\n-7.5,1,2,-3\n")
    (tmp_path / "b.points").write_text("1,2,3,-4,1\n")
    rows = {(r.path[-8:], r.px): r for r in deliverables.read_points(spark, str(tmp_path), enabled_only=True).collect()}
    assert set(rows) == {("a.points", 100.25), ("a.points", 2.0), ("b.points", 3.0)}
    r = rows["a.points", 100.25]
    assert (r.py, r.x, r.y, r.system, r.enabled) == (50.5, 319000.5, 8650000.0, "EPSG:32718", True) and rows["b.points", 3.0].system is None
    assert deliverables.read_points(spark, str(tmp_path)).count() == 4


def test_points_come_back(spark, tmp_path):
    gcps = spark.createDataFrame([(1, "V1H1", 10.5, 20.25, 3.0, 4.0, True), (1, "V1H2", 11.0, 21.0, 5.0, 6.0, False)], "map_id int, gcp_id string, px double, py double, x double, y double, enabled boolean")
    none = gcps.select("map_id", "gcp_id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")).limit(0)
    deliverables.point_rows(gcps, none).select("line").write.text(str(tmp_path / "out"))
    back = deliverables.read_points(spark, str(tmp_path / "out")).orderBy("px").collect()
    assert [(r.px, r.py, r.x, r.y, r.enabled) for r in back] == [(10.5, 20.25, 3.0, 4.0, True), (11.0, 21.0, 5.0, 6.0, False)]


def test_documents_and_summary(spark, tmp_path):
    maps = spark.createDataFrame([("m1", "ok"), ("m2", "failed")], "map_id string, status string")
    gcps = spark.createDataFrame([("m1", "V2H1", 1.0, 2.0, 3.0, 4.0), ("m1", "V1H1", 5.0, 6.0, 7.0, 8.0)], "map_id string, gcp_id string, px double, py double, x double, y double")
    affine = spark.createDataFrame([("m1", 5.0, 0.1)], "map_id string, a double, b double")
    checks = spark.createDataFrame([("m1", "loo", False), ("m1", "rmse", True), ("m1", "crs", False)], "map_id string, name string, passed boolean")
    found = deliverables.document(maps, gcps, affine, checks)
    deliverables.write_documents(found, str(tmp_path / "documents"))
    one = {r.map_id: json.loads(r.document) for r in found.collect()}
    assert [g["gcp_id"] for g in one["m1"]["gcps"]] == ["V1H1", "V2H1"] and one["m1"]["transform"] == {"kind": "affine", "a": 5.0, "b": 0.1}
    assert one["m1"]["warnings"] == ["crs", "loo"] and one["m2"]["warnings"] == [] and "transform" not in one["m2"]
    assert json.loads(next((tmp_path / "documents" / "map_id=m2").glob("*.txt")).read_text()) == one["m2"]
    deliverables.write_summary(maps.orderBy(F.desc("map_id")), str(tmp_path / "summary"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "summary").glob("*.csv")))
    assert text.startswith("﻿map_id,status\nm1,ok\n") and "m2,failed" in text


def test_image_listing(spark, tmp_path):
    """Headers made by hand: a PNG of 300 x 200 at 254 dots per inch, a BMP of 70000 x 5, a JPEG, and a file of no image."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 300, 200, 8, 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", 10000, 10000, 1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(png)
    (tmp_path / "sub" / "b.bmp").write_bytes(b"BM" + bytes(16) + struct.pack("<ii", 70000, 5) + bytes(20))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "d.txt").write_text("no image")
    rows = {r.path[-5:].lstrip('/'): r for r in deliverables.image_listing(spark, str(tmp_path)).collect()}
    assert {k: (r.format, r.width, r.height, r.dpi) for k, r in rows.items()} == {"a.PNG": ("png", 300, 200, 254.0), "b.bmp": ("bmp", 70000, 5, None), "c.jpg": ("jpg", None, None, None)}


def test_systems_as_text(spark):
    codes = spark.createDataFrame([(1, 32718), (2, 4326), (3, 24878), (4, 99)], "map_id int, epsg long")
    text = {r.map_id: r.text for r in crs.projection_text(codes).collect()}
    assert text[4] is None and text[2].startswith('GEOGCS["WGS84",') and '"EPSG","32718"' in text[1]
    assert 'PARAMETER["central_meridian",-75]' in text[1] and 'PARAMETER["false_northing",10000000]' in text[1] and "International" in text[3]


def test_datum_shift(spark):
    """As a plain geocentric computation by iteration gives it; there and back again; the same datum, the same place."""
    import math

    def plain(lon, lat, source, target):
        a, inv = crs.ELLIPSOIDS[crs.ELLIPSOID_OF[source]]
        e = (2 - 1 / inv) / inv
        l, f = math.radians(lon), math.radians(lat)
        n = a / math.sqrt(1 - e * math.sin(f) ** 2)
        d = [s - t for s, t in zip(crs.SHIFTS[source], crs.SHIFTS[target])]
        x, y, z = n * math.cos(f) * math.cos(l) + d[0], n * math.cos(f) * math.sin(l) + d[1], n * (1 - e) * math.sin(f) + d[2]
        a, inv = crs.ELLIPSOIDS[crs.ELLIPSOID_OF[target]]
        e, r = (2 - 1 / inv) / inv, math.hypot(x, y)
        f = math.atan2(z, r * (1 - e))
        for _ in range(20):
            f = math.atan2(z + e * a / math.sqrt(1 - e * math.sin(f) ** 2) * math.sin(f), r)
        return math.degrees(math.atan2(y, x)), math.degrees(f)

    rows = [(k, lon, lat, s, t) for k, (lon, lat, s, t) in enumerate([(-76.9, -11.9, "PSAD56", "WGS84"), (2.1, 53.8, "ED50", "WGS84"), (-100.0, 40.0, "NAD27", "WGS84"), (-60.0, 5.0, "SAD69", "PSAD56"), (10.0, 89.9, "ETRS89", "WGS84"), (1.0, 1.0, "WGS84", "WGS84")])]
    kind = "id int, lon double, lat double, source string, target string"
    got = {r.id: (r.lon, r.lat) for r in crs.shift_datum(spark.createDataFrame([*rows, (9, 0.0, 0.0, "MARS", "WGS84")], kind)).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, lon, lat, s, t in rows:
        assert got[k] == pytest.approx(plain(lon, lat, s, t), abs=2e-9)
    assert got[5] == (1.0, 1.0) and 200 < math.hypot((got[0][0] + 76.9) * 108900, (got[0][1] + 11.9) * 110600) < 500
    back = {r.id: (r.lon, r.lat) for r in crs.shift_datum(spark.createDataFrame([(k, *got[k], t, s) for k, _, _, s, t in rows], kind)).collect()}
    assert all(back[k] == pytest.approx((lon, lat), abs=2e-6) for k, lon, lat, _, _ in rows)
