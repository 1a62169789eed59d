"""What a batch decides after its first control points: the system that a sheet was drawn in, the kind of transformation,
and the lines that do not belong to the grid.

Each step is keyed by map. The rounds of dropping lines are stages over the maps that still lose one, so that a batch of
regular sheets costs one round; the driver learns only whether any map is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import crs, fitting, matching, transforms
from .stages import stage

#: Rounds of dropping one line a map, and the control points that a round needs at least.
ROUNDS, LEAST_POINTS = 4, 8


def grid_lines(lines: DataFrame) -> DataFrame:
    """lines(map_id, axis, line_no, pos, ...) -> those that a label may belong to: the lattice of each family, or the whole
    family where it has none."""
    flags = fitting.lattice_flags(lines.select("map_id", "axis", "line_no", "pos")).filter("on_lattice")
    return lines.join(flags.select("map_id", "axis", "line_no"), ["map_id", "axis", "line_no"])


def world_points(points: DataFrame, systems: DataFrame) -> DataFrame:
    """points(map_id, gcp_id, px, py, x, y) as printed and systems(map_id, epsg, kind), of which a map may have several ->
    the points with x and y in each system, epsg, and what was printed as label_x and label_y. Degrees go to a projected
    system on its datum's own ellipsoid; a point without a projection there (over 80 degrees off) goes. Maps without a
    system keep the printed values."""
    keyed = points.join(systems.select("map_id", "epsg", "kind"), "map_id", "left").withColumnsRenamed({"x": "label_x", "y": "label_y"})
    zones = crs.zones_of(systems.filter("kind = 'geo'").select("epsg").distinct())
    keyed = keyed.join(F.broadcast(zones), "epsg", "left")  # at most the zones of the dimension, some 300 rows
    printed = (F.col("kind") != "geo") | F.col("zone").isNull()
    same = keyed.filter(F.coalesce(printed, F.lit(True))).withColumns({"x": F.col("label_x"), "y": F.col("label_y")})
    flat = keyed.filter(~F.coalesce(printed, F.lit(True)) & (F.abs(F.col("label_x") - (6 * F.col("zone") - 183)) < 80) & (F.abs("label_y") < 90))
    flat = flat.withColumn("id", F.struct("map_id", "epsg", "gcp_id", "px", "py", "label_x", "label_y"))
    kept = ["map_id", "gcp_id", "epsg", "px", "py", "label_x", "label_y", "x", "y"]
    parts = [same.select(kept)]
    for name, ellipsoid in crs.ELLIPSOIDS.items():
        these = flat.filter(F.col("ellipsoid") == name).select("id", "zone", "south", F.col("label_x").alias("lon"), F.col("label_y").alias("lat"))
        parts.append(crs.utm_forward(these, ellipsoid).select("id.*", F.col("easting").alias("x"), F.col("northing").alias("y")).select(kept))
    return reduce(DataFrame.unionByName, parts)


def system_ranks(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """points as printed and candidates(map_id, epsg, kind) -> the affine error in pixels of each candidate and its place,
    for maps in degrees with four points and two candidates. Printed projected values fit alike in every zone."""
    several = candidates.withColumn("n", F.count("*").over(Window.partitionBy("map_id"))).filter("kind = 'geo' and n > 1")
    placed = world_points(points.join(several.select("map_id").distinct(), "map_id", "left_semi"), several).filter("epsg is not null")
    turned = placed.select(
        F.struct("map_id", "epsg").alias("map_id"), "gcp_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("x"), F.col("py").alias("y")
    )
    errors = fitting.affine_fit(turned).select("map_id.map_id", F.col("map_id.epsg").cast("long").alias("epsg"), "rmse")
    return crs.rank_crs(errors.withColumn("seq", F.col("epsg")))


def worst_lines(fitted: DataFrame) -> DataFrame:
    """fitted(map_id, gcp_id, n, rx, ry) -> at most one line of each map: of both families the one that stands off most."""
    numbers = [F.regexp_extract("gcp_id", r"^V(\d+)H(\d+)$", k).cast("long") for k in (1, 2)]
    enough = fitted.filter(F.col("n") >= LEAST_POINTS)
    each = [
        enough.select(F.struct("map_id", F.lit(axis).alias("axis")).alias("map_id"), number.alias("line_no"), F.col(residual).alias("residual"))
        for axis, number, residual in zip("xy", numbers, ("rx", "ry"))
    ]
    found = fitting.inconsistent_lines(each[0].unionByName(each[1]))
    found = found.select("map_id.map_id", "map_id.axis", "line_no", F.abs("offset_").alias("offset_"))
    first = Window.partitionBy("map_id").orderBy(F.desc("offset_"), "axis", "line_no")
    return found.withColumn("place", F.row_number().over(first)).filter("place = 1").select("map_id", "axis", "line_no")


def consistent(drawn: DataFrame, values: DataFrame, bounds: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """drawn lines, values(map_id, axis, line_no, value), bounds of maps and the system(map_id, epsg, kind) of each map ->
    the points with their residuals under the chosen kind, the values that stay, and the lines dropped.

    Each round fits the maps that lost a line in the last one, and drops at most one line of each; after ROUNDS rounds all
    maps stay as they are.
    """
    settled, dropped = [], []
    for left in range(ROUNDS, -1, -1):
        points = stage(world_points(matching.crossings(drawn.join(values, ["map_id", "axis", "line_no"]), bounds), systems))
        fitted = stage(points.join(transforms.auto_fit(points), ["map_id", "gcp_id"], "left"))
        worst = stage(worst_lines(fitted)) if left else None
        if worst is None or worst.isEmpty():
            settled.append((fitted, values))
            break
        dropped.append(worst)
        gone = worst.select("map_id")
        settled.append((fitted.join(gone, "map_id", "left_anti"), values.join(gone, "map_id", "left_anti")))
        values = stage(values.join(gone, "map_id", "left_semi").join(worst, ["map_id", "axis", "line_no"], "left_anti"))
    none = values.select("map_id", "axis", F.col("line_no").cast("long").alias("line_no")).limit(0)
    return reduce(DataFrame.unionByName, [f for f, _ in settled]), reduce(DataFrame.unionByName, [v for _, v in settled]), reduce(DataFrame.unionByName, dropped, none)
