"""Sheet geometry: regions typed by hand, zoom levels, reading jobs, rulers, distances, drawn layers, edits of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import cell_region, tiles

# Metres of a degree of longitude at the equator and of latitude.
METRES_X, METRES_Y = 111320.0, 110540.0
#: Views are at most this large, levels at least, and enlarged at most this much.
LEVEL_SIDE, ZOOM = 2400, 4.0


def clamp_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The whole pixels that a region covers inside the image, one at least: struct(x, y, w, h)."""
    x0 = F.greatest(F.lit(0), F.least(F.floor(x), width - 1))
    y0 = F.greatest(F.lit(0), F.least(F.floor(y), height - 1))
    x1, y1 = F.least(width, F.greatest(F.ceil(x + w), x0 + 1)), F.least(height, F.greatest(F.ceil(y + h), y0 + 1))
    return F.struct(x0.cast("long").alias("x"), y0.cast("long").alias("y"), (x1 - x0).cast("long").alias("w"), (y1 - y0).cast("long").alias("h"))


def parse_region(text: Column, width: Column, height: Column) -> Column:
    """ "", "full" and the like: the whole image; "x,y,w,h": that box, clamped; "B2:C3": those cells; else null."""
    plain = F.lower(F.trim(text))
    part = F.split(F.translate(plain, ";", ","), ",")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    box = F.when(number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull(), clamp_region(number(0), number(1), number(2), number(3), width, height))
    cells = cell_region(plain, width, height)
    whole = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), width.cast("long").alias("w"), height.cast("long").alias("h"))
    named = F.when(plain.rlike(r"^[a-z]\d+(:[a-z]\d+)?$"), F.struct(*(cells[c].cast("long").alias(c) for c in "xywh")))
    return F.when(plain.isin("", "all", "todo", "full"), whole).when(F.size(part) == 4, box).otherwise(named)


def regions(requests: DataFrame) -> DataFrame:
    """requests(map_id, text, width, height) -> the region that each asks for, null where it is none."""
    r = parse_region(F.col("text"), F.col("width"), F.col("height"))
    return requests.select("map_id", "text", *(r[c].alias(c) for c in "xywh"))


def pyramid_levels(maps: DataFrame) -> DataFrame:
    """maps(map_id, width, height) -> halved levels until the longer side is at most LEVEL_SIDE."""
    n = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("width", "height") / LEVEL_SIDE)).cast("int"))
    level = maps.withColumn("level", F.explode(F.sequence(F.lit(0), n)))
    half = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))))
    return level.select("map_id", F.col("level").cast("long"), half("width").cast("long").alias("width"), half("height").cast("long").alias("height"))


def view_scale(w: Column, h: Column, side: Column) -> Column:
    """Scale of a region's view, four decimals."""
    return F.round(F.least(side / F.greatest(w, h), F.lit(ZOOM)), 4)


def reading_jobs(maps: DataFrame, frames: DataFrame) -> DataFrame:
    """What to read: every tile upright, and the bands left and right of the frame (an eighth of the sheet where there is
    none) turned by 90 degrees, if over 20 pixels wide."""
    upright = tiles(maps).select("map_id", "x", "y", "w", "h", F.lit(0).cast("long").alias("rotation"))
    sheet = maps.join(frames.select("map_id", "x0", "x1"), "map_id", "left")
    left = F.coalesce(F.ceil(F.col("x0") + 0.02 * F.col("width")), F.ceil(0.12 * F.col("width"))).cast("long")
    right = F.coalesce(F.floor(F.col("x1") - 0.02 * F.col("width")), F.floor(0.88 * F.col("width"))).cast("long")
    band = lambda x, w: sheet.select("map_id", x.cast("long").alias("x"), F.lit(0).cast("long").alias("y"), w.cast("long").alias("w"), F.col("height").cast("long").alias("h"), F.lit(90).cast("long").alias("rotation"))
    return upright.union(band(F.lit(0), left).filter("w > 20")).union(band(right, F.col("width") - right).filter("w > 20"))


def ruler_step(target: Column) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that is at least the target."""
    ten = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    return F.array_min(F.filter(F.array(*(F.lit(f) * ten for f in (1.0, 2.0, 5.0, 10.0))), lambda s: s >= target * (1 - 1e-12)))


def metres(dx: Column, dy: Column, latitude: Column, degrees: Column) -> Column:
    """Length of a difference in world units; differences in degrees on a sphere."""
    return F.when(degrees, F.hypot(dx * METRES_X * F.cos(F.radians(latitude)), dy * METRES_Y)).otherwise(F.hypot(dx, dy))


def distances(pairs: DataFrame) -> DataFrame:
    """pairs(map_id, dx, dy, latitude, degrees) -> metres and the ruler step for a tenth of them."""
    m = metres(F.col("dx"), F.col("dy"), F.col("latitude"), F.col("degrees"))
    return pairs.withColumn("m", m).filter("m > 0").select("map_id", F.round("m", 4).alias("metres"), F.round(ruler_step(F.col("m") / 10), 6).alias("ruler"))


def toggle_points(gcps: DataFrame, edits: DataFrame) -> DataFrame:
    """gcps(map_id, gcp_id), edits(map_id, seq, what, enabled), where `what` is a point's id or a line's: the last edit
    that touches a point decides. The edits of a map are one row beside its points."""
    of_map = edits.filter("seq IS NOT NULL").groupBy("map_id").agg(F.collect_list(F.struct("seq", "enabled", "what")).alias("edits"))
    ends = [F.col("gcp_id"), F.regexp_extract("gcp_id", r"^(V\d+)H\d+$", 1), F.regexp_extract("gcp_id", r"^V\d+(H\d+)$", 1)]
    last = F.array_max(F.filter("edits", lambda e: e["what"].isin(*ends)))
    return gcps.select("map_id", "gcp_id").join(of_map, "map_id", "left").select("map_id", "gcp_id", F.coalesce(last["enabled"], F.lit(True)).alias("enabled"))


def draw_list(lines: DataFrame, gcps: DataFrame, frames: DataFrame) -> DataFrame:
    """The shapes of an overlay: layer, tag, shape and its numbers, for any renderer."""
    line = lines.select("map_id", F.lit("lines").alias("layer"), F.concat(F.when(F.col("axis") == "x", "V").otherwise("H"), F.col("line_no")).alias("tag"), F.lit("line").alias("shape"), F.array("a", "b", "c").alias("numbers"))
    point = gcps.select("map_id", F.lit("points").alias("layer"), F.col("gcp_id").alias("tag"), F.lit("cross").alias("shape"), F.array("px", "py").alias("numbers"))
    frame = frames.select("map_id", F.lit("frame").alias("layer"), F.lit("frame").alias("tag"), F.lit("box").alias("shape"), F.array("x0", "y0", "x1", "y1").alias("numbers"))
    return line.union(point).union(frame)


def truth_pairs(images: DataFrame, points: DataFrame) -> DataFrame:
    """Images (path) with a points file (path) of the same name, its suffix replaced or appended; replaced wins."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    p = points.select(F.col("path").alias("points_path"), stem(F.col("path")).alias("key")).distinct()
    replaced = images.withColumn("key", stem(F.col("path"))).join(p, "key").select("path", "points_path", F.lit(0).alias("rank_"))
    appended = images.withColumn("key", F.col("path")).join(p, "key").select("path", "points_path", F.lit(1).alias("rank_"))
    return replaced.union(appended).groupBy("path").agg(F.min_by("points_path", "rank_").alias("points_path"))
