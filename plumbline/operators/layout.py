"""Image regions as relations: tiles, rotated boxes, the lettered reference grid, regions and text search, error meshes,
arm classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, OVERLAP = 2200, 260


def _starts(size: Column, tile: int, overlap: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil((size - overlap) / (tile - overlap))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * (tile - overlap))


def tiles(maps: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """maps(map_id, width, height) -> overlapping tiles that cover each map, the last ones clipped."""
    across = maps.withColumn("x", F.explode(_starts(F.col("width"), tile, overlap)))
    down = across.withColumn("y", F.explode(_starts(F.col("height"), tile, overlap)))
    return down.select(
        "map_id", F.col("x").cast("long"), F.col("y").cast("long"), F.least(F.lit(tile), F.col("width") - F.col("x")).cast("long").alias("w"), F.least(F.lit(tile), F.col("height") - F.col("y")).cast("long").alias("h")
    )


def unrotate_boxes(boxes: DataFrame) -> DataFrame:
    """boxes(map_id, seq, x0, y0, x1, y1, rotation, wc, hc, upscale, dx, dy), read in a turned and scaled crop -> boxes
    in map pixels."""

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        r, w, h = F.col("rotation"), F.col("wc") - 1, F.col("hc") - 1
        px = F.when(r == 0, x).when(r == 90, y).when(r == 180, w - x).otherwise(w - y)
        py = F.when(r == 0, y).when(r == 90, h - x).when(r == 180, h - y).otherwise(x)
        scale = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("upscale")))
        return px / scale + F.col("dx"), py / scale + F.col("dy")

    a, b = back(F.col("x0"), F.col("y0")), back(F.col("x1"), F.col("y1"))
    ends = [F.least(a[0], b[0]).alias("x0"), F.least(a[1], b[1]).alias("y0"), F.greatest(a[0], b[0]).alias("x1"), F.greatest(a[1], b[1]).alias("y1")]
    return boxes.select("map_id", F.col("seq").cast("long"), *ends).select("map_id", "seq", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def grid_cells(points: DataFrame) -> DataFrame:
    """points(map_id, seq, x, y, width, height) -> the lettered cell of a ten-cell grid that holds each point, and its box."""
    cell = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / 10))
    p = points.withColumn("cell", cell)
    place = lambda v, size: F.least(F.ceil(F.col(size) / F.col("cell")) - 1, F.greatest(F.lit(0), F.floor(F.col(v) / F.col("cell"))))
    p = p.withColumn("col_", place("x", "width").cast("int")).withColumn("row_", place("y", "height").cast("int"))
    return p.select(
        "map_id", F.col("seq").cast("long"), F.concat(F.char(F.col("col_") + 65), (F.col("row_") + 1).cast("string")).alias("name"), (F.col("col_") * F.col("cell")).cast("long").alias("x0"), (F.col("row_") * F.col("cell")).cast("long").alias("y0")
    )


def cell_region(text: Column, width: Column, height: Column) -> Column:
    """ "C4" or "B2:C3" as struct(x, y, w, h); null for a cell that does not exist."""
    cell = F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / 10)).cast("int")
    part = lambda k: F.when(F.size(F.split(text, ":")) > k, F.get(F.split(text, ":"), F.lit(k))).otherwise(F.split(text, ":")[0])
    col = lambda t: F.ascii(F.upper(F.trim(t))) - 65
    row = lambda t: F.substring(F.trim(t), 2, 9).try_cast("int") - 1
    c0, c1, r0, r1 = F.least(col(part(0)), col(part(1))), F.greatest(col(part(0)), col(part(1))), F.least(row(part(0)), row(part(1))), F.greatest(row(part(0)), row(part(1)))
    sound = (c0 >= 0) & (c1 < F.ceil(width / cell)) & (r0 >= 0) & (r1 < F.ceil(height / cell))
    x, y = c0 * cell, r0 * cell
    return F.when(sound, F.struct(x.alias("x"), y.alias("y"), (F.least(width, (c1 + 1) * cell) - x).alias("w"), (F.least(height, (r1 + 1) * cell) - y).alias("h")))


def search(items: DataFrame, pattern: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """items(map_id, seq, text, cx, cy) whose center lies in the region, ends included, and whose text matches."""
    return items.filter(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1) & F.col("text").rlike("(?i)" + pattern) & (F.trim("text") != ""))


def mesh_error(fits: DataFrame, samples: int = 9) -> DataFrame:
    """fits(map_id, width, height, and affine a..f against truth ta..tf) -> error over a mesh of each map. The error is affine
    in the position, so that its mean square is that of the middle plus what the mesh spreads, and the largest stands in a
    corner."""
    w, h = F.col("width") - 1, F.col("height") - 1
    spread = (samples + 1) / (12 * (samples - 1))
    differ = lambda *names: [F.col(c) - F.col(f"t{c}") for c in names]
    (px, qx, rx), (py, qy, ry) = differ("a", "b", "e"), differ("c", "d", "f")

    def squared(x: Column, y: Column) -> Column:
        dx, dy = px * x + qx * y + rx, py * x + qy * y + ry
        return dx * dx + dy * dy

    mean = squared(w / 2, h / 2) + spread * ((px * px + py * py) * w * w + (qx * qx + qy * qy) * h * h)
    worst = F.greatest(*(squared(x, y) for x in (F.lit(0.0), w) for y in (F.lit(0.0), h)))
    return fits.select("map_id", F.round(F.sqrt(mean), 5).alias("rmse"), F.round(F.sqrt(worst), 5).alias("worst"))


def arm_classes(arms: DataFrame) -> DataFrame:
    """arms(group_id, v) -> size classes: sorted arms join a class while at most 1.25 times its first member plus 1;
    classes of at least four, most members first. A fold over each group's sorted array, which a map bounds."""
    sorted_ = arms.groupBy("group_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    start = F.array().cast("array<struct<first:double,n:bigint>>")

    def add(classes: Column, v: Column) -> Column:
        last = F.try_element_at(classes, F.lit(-1))
        joins = (F.size(classes) > 0) & (v <= 1.25 * last["first"] + 1)
        new = F.array(F.struct(v.cast("double").alias("first"), F.lit(1).cast("bigint").alias("n")))
        grown = F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n")))
        return F.when(joins, F.concat(F.slice(classes, 1, F.greatest(F.size(classes) - 1, F.lit(0))), grown)).otherwise(F.concat(classes, new))

    found = sorted_.select("group_id", F.explode(F.aggregate("vs", start, add)).alias("c"))
    return found.filter("c.n >= 4").select("group_id", F.round("c.first", 4).alias("first"), F.col("c.n").alias("n"))
