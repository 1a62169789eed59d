"""Readers and writers of a map's deliverables: control points, world file, JSON document, summary, traces, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_HEADER = "mapX,mapY,sourceX,sourceY,enable,dX,dY,residual"
# The world file's suffix of each image suffix.
WORLD_SUFFIX = {"tif": "tfw", "tiff": "tfw", "jpg": "jgw", "jpeg": "jgw", "png": "pgw", "bmp": "bpw"}
IMAGES = ("tif", "tiff", "jpg", "jpeg", "png", "bmp", "jp2", "webp")


def point_rows(gcps: DataFrame, residuals: DataFrame) -> DataFrame:
    """gcps(map_id, gcp_id, px, py, x, y, enabled) with residuals(map_id, gcp_id, dx, dy), where there are any, as lines
    of a points file; the row axis is negative there."""
    joined = gcps.join(residuals, ["map_id", "gcp_id"], "left")
    dx, dy = (F.when(F.col("enabled"), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in (F.col("dx"), F.col("dy")))
    line = F.format_string("%.6f,%.6f,%.3f,%.3f,%d,%.4f,%.4f,%.4f", F.col("x"), F.col("y"), F.col("px"), -F.col("py"), F.col("enabled").cast("int"), dx, dy, F.sqrt(dx * dx + dy * dy))
    return joined.select("map_id", "gcp_id", line.alias("line"))


def read_points(spark: SparkSession, path: str, enabled_only: bool = False) -> DataFrame:
    """Points files below a path: path, px, py, x, y, enabled, and the system that the file's `#CRS:` line names (null
    without one). Lines without four numbers are passed over; disabled points go with `enabled_only`."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    named = lines.filter(F.col("value").startswith("#CRS:")).groupBy("path").agg(F.min(F.trim(F.substring("value", 6, 1 << 20))).alias("system"))
    part = F.split("value", ",")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    rows = lines.select("path", number(2).alias("px"), (-number(3)).alias("py"), number(0).alias("x"), number(1).alias("y"), F.coalesce(F.trim(F.get(part, F.lit(4))) != "0", F.lit(True)).alias("enabled"))
    rows = rows.filter("px is not null and py is not null and x is not null and y is not null")
    return (rows.filter("enabled") if enabled_only else rows).join(named, "path", "left")


def world_file(fits: DataFrame) -> DataFrame:
    """fits(map_id, suffix, a, b, c, d, e, f) -> world file text (x scale, y skew, x skew, y scale, origin) and suffix."""
    text = F.concat_ws("\n", *(F.format_string("%.10f", F.col(c)) for c in ("a", "c", "b", "d", "e", "f")))
    suffixes = F.create_map(*(F.lit(x) for pair in WORLD_SUFFIX.items() for x in pair))
    return fits.select("map_id", F.coalesce(suffixes[F.lower("suffix")], F.lit("wld")).alias("suffix"), text.alias("text"))


def output_grid(fits: DataFrame) -> DataFrame:
    """fits(map_id, width, height, a..f) -> the north-up canvas that holds the image: origin, resolution, size. The image of
    a rectangle under an affine map lies within the box of its four corners."""
    corners = [(x, y) for x in (F.lit(-0.5), F.col("width") - 0.5) for y in (F.lit(-0.5), F.col("height") - 0.5)]
    xs, ys = ([F.col(p) * x + F.col(q) * y + F.col(r) for x, y in corners] for p, q, r in ("abe", "cdf"))
    p = fits.select("map_id", F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"), F.sqrt(F.hypot("a", "b") * F.hypot("c", "d")).alias("res"))
    size = lambda v: F.ceil(F.round((F.col(f"{v}1") - F.col(f"{v}0")) / F.col("res"), 6)).cast("long")
    return p.select("map_id", F.round("x0", 4).alias("x_min"), F.round("y1", 4).alias("y_max"), F.round("res", 6).alias("res"), size("x").alias("width"), size("y").alias("height"))


def strip_images(text: Column) -> Column:
    """Embedded base64 images replaced by a note of their size and hash."""
    pattern = r"data:image/[a-z]+;base64,[A-Za-z0-9+/=]+"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    note = lambda m: F.concat(F.lit("[image omitted: "), F.floor(F.length(m) * 3 / 4096).cast("string"), F.lit(" KB, id "), F.substring(F.sha1(F.substring(m, 1, 8192)), 1, 10), F.lit("]"))
    return F.aggregate(F.array_distinct(found), text, lambda t, m: F.replace(t, m, note(m)))


def document(maps: DataFrame, gcps: DataFrame, affine: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """One JSON document for each map: its columns, its control points in id order, the transformation (of an affine fit)
    and a warning for each check(map_id, name, passed) that failed."""
    points = gcps.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("gcp_id", "px", "py", "x", "y"))).alias("gcps"))
    joined = maps.join(points, "map_id", "left")
    if affine is not None:
        held = F.struct(F.lit("affine").alias("kind"), *(c for c in affine.columns if c != "map_id")).alias("transform")
        joined = joined.join(affine.select("map_id", held), "map_id", "left")
    if checks is not None:
        failed = checks.filter("not passed").groupBy("map_id").agg(F.array_sort(F.collect_list("name")).alias("warnings"))
        joined = joined.join(failed, "map_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    return joined.select("map_id", F.to_json(F.struct(*(c for c in joined.columns))).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder for each map with its document as a line of JSON; folders of other maps stay as they are."""
    documents.select("map_id", "document").write.mode("append").partitionBy("map_id").text(path)


def write_summary(rows: DataFrame, path: str, order: str = "map_id") -> None:
    """The batch's flat summary as CSV in the order of a column, with a header and the mark that spreadsheets look for: the
    first column's name begins with it. One row a map: Spark sorts them by range, and file names follow that order."""
    marked = rows.orderBy(order).withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.mode("errorifexists").option("header", True).csv(path)


def image_listing(spark: SparkSession, path: str) -> DataFrame:
    """Supported images below a path with their format, size and dots per inch, read from their headers (PNG and BMP; others
    null; dots per inch of PNG only)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring("content", 1, 65536)
    word = lambda at, n: F.conv(F.hex(F.substring(head, at, n)), 16, 10).cast("long")
    phys = F.instr(F.decode(F.substring(head, 1, 4096), "ISO-8859-1"), "pHYs")
    per_metre = F.conv(F.hex(F.substring(head, phys + 4, F.lit(4))), 16, 10).cast("long")
    dpi = F.when((suffix == "png") & (phys > 0), F.rint(per_metre * 0.0254))
    png, bmp = suffix == "png", suffix == "bmp"
    little = lambda at: F.conv(F.concat(*(F.hex(F.substring(head, at + k, 1)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    size = lambda of_png, of_bmp: F.when(png, word(of_png, 4)).when(bmp, little(of_bmp))
    return files.filter(suffix.isin(*IMAGES)).select("path", suffix.alias("format"), "length", size(17, 19).alias("width"), size(21, 23).alias("height"), F.when(dpi > 96, dpi).alias("dpi")).orderBy("path")
