"""From pixels and text to signed maps, whatever a sheet prints: full lines, crosses, or ticks on its frame.

What each mode finds on a sheet is a set of lines with a rank. All sets are valued in one plan, keyed by map and rank, and of each map
the least rank whose lines resolve both axes counts; a map that none resolves goes on with its lines. A sheet that cannot
be measured gets the status failed and its error; the others are untouched by it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .georeference import Evaluated, Georeferenced, conclude, evaluate, labels_of
from .stages import stage

#: Ranks of what a sheet may print; crosses by size class, the most frequent first.
MODES = {0: "lines", 1: "crosses", 2: "crosses", 3: "ticks"}
#: Control points that a mode must give to count.
LEAST_POINTS = 4


@dataclass
class Detected:
    """lines(map_id, rank, axis, line_no, slope, intercept, low, high, support, on_lattice) of all modes, the box of each map's
    largest closed stroke, and errors(map_id, error)."""

    lines: DataFrame
    contours: DataFrame
    errors: DataFrame


def detect(images: DataFrame, rows: int = scan.ROWS) -> Detected:
    """images(map_id, width, height, pixels) -> what is measured on them."""
    cut = stage(scan.stripes(images, rows))
    sizes = stage(images.select("map_id", "width", "height"))
    found = stage(scan.coarse(cut, sizes))
    good = found.filter("error is null")
    lines = stage(scan.measure_lines(cut, sizes, good))
    crosses = stage(scan.measure_crosses(cut, sizes, good))
    ticks = stage(scan.measure_ticks(cut, sizes, lines))
    failed = reduce(DataFrame.unionByName, (d.filter("error is not null").select("map_id", "error") for d in (found, lines, crosses, ticks)))
    errors = stage(failed.groupBy("map_id").agg(F.min("error").alias("error")))
    kept = ["map_id", "axis", "m", "q", "t0", "t1", "support"]
    sets = [lines.withColumn("rank", F.lit(0)), crosses.filter("class < 2").withColumn("rank", (F.col("class") + 1).cast("int")), ticks.withColumn("rank", F.lit(3))]
    together = reduce(DataFrame.unionByName, (d.filter("error is null").select(*kept, "rank") for d in sets))
    together = together.join(errors, "map_id", "left_anti")
    contours = good.filter("kind = 'contour'").select("map_id", "x0", "y0", "x1", "y1")
    return Detected(stage(scan.numbered(together, sizes, "rank")), contours, errors)


def frames(detected: Detected, chosen: DataFrame) -> DataFrame:
    """chosen(map_id, rank) -> the frame of each map, by the ends of its lattice lines, else by its largest closed stroke."""
    from ..operators import matching

    held = detected.lines.join(chosen, ["map_id", "rank"]).filter("on_lattice")
    middle = F.col("intercept") + F.col("slope") * (F.col("low") + F.col("high")) / 2
    by_lines = matching.frame_of_lines(held.select("map_id", "axis", middle.alias("pos"), "low", "high")).withColumn("source", F.lit("grid"))
    rest = detected.contours.join(by_lines, "map_id", "left_anti").withColumn("source", F.lit("contour"))
    return by_lines.unionByName(rest)


def choose_modes(maps: DataFrame, labels: DataFrame, lines: DataFrame) -> tuple[DataFrame, Evaluated]:
    """lines of several ranks -> (map_id, rank) and the chosen lines with their values, keyed by map."""
    ranks = lines.select("map_id", "rank").distinct()
    key = F.struct("map_id", "rank").alias("map_id")
    keyed = lambda df: df.join(ranks, "map_id").select(key, *(c for c in df.columns if c != "map_id"))
    found = evaluate(keyed(maps), keyed(labels), lines.select(key, "axis", "line_no", "slope", "intercept"))
    points = found.points.groupBy("map_id").agg(F.count("*").alias("n"))
    axes = found.fits.groupBy("map_id").agg(F.countDistinct("axis").alias("axes"))
    resolved = points.join(axes, "map_id").filter((F.col("n") >= LEAST_POINTS) & (F.col("axes") == 2)).select("map_id.map_id", "map_id.rank")
    first = resolved.groupBy("map_id").agg(F.min("rank").alias("rank"))
    chosen = stage(maps.select("map_id").join(first, "map_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0))))
    names = {f.name: getattr(found, f.name) for f in fields(Evaluated)}
    own = chosen.select(key, F.col("map_id").alias("own"))
    plain = {k: stage(v.join(own, "map_id").drop("map_id").withColumnRenamed("own", "map_id")) for k, v in names.items()}
    return chosen, Evaluated(**plain)


@dataclass
class Batch:
    """detected, chosen(map_id, rank), result, and summary: one row a map, failed ones included."""

    detected: Detected
    chosen: DataFrame
    result: Georeferenced
    summary: DataFrame


def run(images: DataFrame, items: DataFrame, region_hint: str | None = None, default_datum: str | None = None) -> Batch:
    """images(map_id, width, height, dpi, pixels), items(map_id, seq, text, x0, y0, x1, y1) as read from them."""
    detected = detect(images)
    # of maps that share an id none can be told apart: each of them fails
    twice = Window.partitionBy("map_id")
    sheets = stage(images.select("map_id", "width", "height", "dpi").withColumn("copies", F.count("*").over(twice)))
    sound = sheets.filter("copies = 1").drop("copies").join(detected.errors, "map_id", "left_anti")
    labels = stage(labels_of(items))
    chosen, found = choose_modes(sound, labels, detected.lines)
    result = conclude(sound, items.join(sound.select("map_id"), "map_id", "left_semi"), labels, found, region_hint, default_datum)
    mode = F.element_at(F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair)), F.col("rank"))
    points = result.gcps.groupBy("map_id").agg(F.count("*").alias("points"))
    failed = F.when(F.col("copies") > 1, "several sheets have this id").otherwise(F.col("error"))
    summary = (
        sheets.groupBy("map_id").agg(F.max("copies").alias("copies")).join(detected.errors, "map_id", "left").join(result.status, "map_id", "left")
        .join(chosen, "map_id", "left").join(points, "map_id", "left")
        .select(
            "map_id", F.when(failed.isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.when(failed.isNull(), mode).alias("mode"), "epsg", "model",
            F.coalesce("points", F.lit(0)).cast("long").alias("points"), "rmse", "loo", failed.alias("error"),
        )
    )
    return Batch(detected, chosen, result, summary)
