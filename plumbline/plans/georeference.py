"""The whole batch: recognised text and measured lines of any number of maps in, a signed status for each map out.

Every step is keyed by map; nothing comes to the driver. Relations that several later steps read are written to the shared
folder once. Positions are pixels of the original
image with y downwards; a vertical line is x = intercept + slope y, a horizontal one y = intercept + slope x.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import crs, fitting, matching, rules
from . import refine
from .stages import stage

# The round steps of printed graticules, in arc seconds.
ARC_STEPS = (1, 2, 5, 10, 15, 20, 30, 60, 120, 150, 300, 600, 900, 1200, 1800, 3600, 7200, 18000, 36000)


@dataclass
class Georeferenced:
    """The batch's relations, each keyed by map_id. gcps hold x and y in the chosen system, what was printed, and the
    residual of the chosen kind; models its errors in pixels; values the lines that stay, dropped those that did not fit."""

    labels: DataFrame
    fits: DataFrame
    values: DataFrame
    gcps: DataFrame
    affine: DataFrame
    models: DataFrame
    dropped: DataFrame
    ranks: DataFrame
    legends: DataFrame
    systems: DataFrame
    checks: DataFrame
    status: DataFrame


def geometry(lines: DataFrame, maps: DataFrame) -> DataFrame:
    """lines(map_id, axis, line_no, slope, intercept) with their unit-free equation a x + b y + c = 0 and middle position."""
    across = F.when(F.col("axis") == "x", F.col("height") / 2).otherwise(F.col("width") / 2)
    vertical = F.col("axis") == "x"
    return lines.join(maps.select("map_id", "width", "height"), "map_id").select(
        "map_id", "axis", "line_no", "slope", "intercept",
        F.when(vertical, 1.0).otherwise(-F.col("slope")).alias("a"), F.when(vertical, -F.col("slope")).otherwise(1.0).alias("b"), (-F.col("intercept")).alias("c"),
        (F.col("intercept") + F.col("slope") * across).alias("pos"),
    )


def labels_of(items: DataFrame) -> DataFrame:
    """Items whose text holds exactly one coordinate."""
    found = items.withColumn("found", text.parse_candidates(F.col("text"))).filter(F.size("found") == 1)
    one = F.col("found")[0]
    center = [((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")]
    return found.select("map_id", "seq", "text", *center, one["kind"].alias("kind"), one["value"].alias("value"), one["axis"].alias("printed"), one["complete"].alias("complete"))


def frames_of(lines: DataFrame) -> DataFrame:
    """Frame through the outermost lines."""
    none = F.lit(None).cast("double")
    return matching.frame_of_lines(lines.select("map_id", "axis", "pos", none.alias("low"), none.alias("high")))


def associate(labels: DataFrame, lines: DataFrame, maps: DataFrame) -> DataFrame:
    """Each label's nearest line of the family that its side of the frame asks for, within 0.3 spacings."""
    sides = matching.side_of_frame(labels, frames_of(lines))
    placed = labels.join(sides, ["map_id", "seq"])
    wanted = F.when(F.col("side").isin("top", "bottom"), "x").when(F.col("side").isin("left", "right"), "y").when(F.col("side") == "inside", F.col("printed"))
    placed = placed.withColumn("axis", wanted).filter(F.col("axis").isNotNull() & (F.col("printed").isNull() | (F.col("printed") == F.col("axis"))))
    spaced = fitting.line_spacing(lines).select("map_id", "axis", "spacing")
    size = F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height"))
    near = placed.join(lines.select("map_id", "axis", "line_no", "slope", "intercept", "pos"), ["map_id", "axis"])
    at = F.when(F.col("axis") == "x", F.abs(F.col("intercept") + F.col("slope") * F.col("cy") - F.col("cx"))).otherwise(F.abs(F.col("intercept") + F.col("slope") * F.col("cx") - F.col("cy")))
    first = Window.partitionBy("map_id", "seq").orderBy(F.round("distance", 9), "pos", "line_no")
    best = near.withColumn("distance", at).withColumn("place", F.row_number().over(first)).filter("place = 1")
    limit = F.coalesce(0.3 * F.col("spacing"), 0.05 * size)
    return best.join(spaced, ["map_id", "axis"]).join(maps.select("map_id", "width", "height"), "map_id").filter(F.col("distance") <= limit).select("map_id", "seq", "kind", "axis", "line_no", "pos", "value", "complete", "spacing")


def _nearest_step(raw: Column, kind: Column) -> Column:
    """The round step nearest to raw on a log scale, if within 8 per cent, else raw."""
    ten = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    grid = F.array(*(F.lit(f) * ten for f in (1.0, 2.0, 2.5, 5.0, 10.0)))
    arcs = F.array(*(F.lit(s / 3600) for s in ARC_STEPS))
    ranked = F.array_sort(F.transform(F.when(kind == "geo", arcs).otherwise(grid), lambda s: F.struct(F.round(F.abs(F.ln(s / raw)), 12), s.alias("step"))))
    step = ranked[0]["step"]
    return F.when(F.abs(step - raw) / raw < 0.08, step).otherwise(raw)


def axis_values(matched: DataFrame, lines: DataFrame, anchors: DataFrame | None = None, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Robust fit of both axes for either kind of coordinate, the kind with most inliers over both axes, and the value of
    every line under it. Geographic values are fitted without sign, which then follows from labels or direction.

    anchors(map_id, axis, line_no, kind, value) are values set by hand: they decide the kind of their map; two or more on an
    axis are its fit, whatever the labels say, one counts as a label more; a line set to null has no value. steps(map_id, axis, step) are known, else they follow from the
    values."""
    usable = matched.filter("complete and value is not null")
    if anchors is not None:
        usable, placed, two = _anchored(usable, lines, anchors)
    unsigned = F.when(F.col("kind") == "geo", F.abs("value")).otherwise(F.col("value"))
    keyed = usable.select(F.struct("map_id", "kind").alias("map_id"), "axis", F.col("seq"), "pos", unsigned.alias("value"))
    fits = stage(fitting.axis_fit(stage(keyed))).select("map_id.map_id", "map_id.kind", "axis", "n_inliers", "slope", "intercept")
    hints = usable.groupBy("map_id", "kind", "axis").agg((F.min("value") < 0).alias("negative"), F.first("spacing").alias("spacing"))
    fits = fits.join(hints, ["map_id", "kind", "axis"]).withColumn("fixed", F.lit(False))
    backwards = ((F.col("axis") == "x") & (F.col("slope") < 0)) | ((F.col("axis") == "y") & (F.col("slope") > 0))
    sign = F.when((F.col("kind") == "geo") & (F.col("negative") | backwards), -1.0).otherwise(1.0)
    if anchors is not None:
        fits = fits.join(two.select("map_id", "axis"), ["map_id", "axis"], "left_anti").unionByName(two)
        sign = F.when(F.col("fixed"), 1.0).otherwise(sign)
    both = Window.partitionBy("map_id", "kind")
    fits = fits.withColumns({"slope": F.col("slope") * sign, "intercept": F.col("intercept") * sign}).withColumn("n_axes", F.count("*").over(both)).withColumn("total", F.sum("n_inliers").over(both))
    order = Window.partitionBy("map_id").orderBy(F.desc(F.col("n_axes") == 2), F.desc("total"), F.desc("kind"))
    fits = fits.withColumn("place", F.dense_rank().over(order)).filter("place = 1").drop("place", "n_axes", "total")
    # the step: the least gap between the values that the inliers' lines carry, else one spacing
    joined = usable.drop("spacing").join(fits.select("map_id", "kind", "axis", "slope", "intercept", "spacing"), ["map_id", "kind", "axis"])
    signed = F.when(F.col("kind") == "geo", F.abs("value") * F.when(F.col("intercept") + F.col("slope") * F.col("pos") < 0, -1.0).otherwise(1.0)).otherwise(F.col("value"))
    good = joined.withColumn("value", signed).filter(F.abs(F.col("value") - F.col("intercept") - F.col("slope") * F.col("pos")) < F.abs("slope") * 0.25 * F.col("spacing"))
    good = good.select("map_id", "axis", "value")
    if anchors is not None:
        good = good.unionByName(placed.select("map_id", "axis", "value"))
    held = good.groupBy("map_id", "axis").agg(F.array_sort(F.collect_set(F.round("value", 9))).alias("vs"))
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("vs") - 1), lambda k: F.get("vs", k) - F.get("vs", k - 1)), lambda g: g > 1e-9)
    gaps = F.when(F.size("vs") > 1, F.array_min(gaps))
    given = steps
    steps = fits.join(held, ["map_id", "axis"]).withColumn("raw", F.coalesce(gaps, F.abs("slope") * F.col("spacing"))).withColumn("step", _nearest_step(F.col("raw"), F.col("kind")))
    if given is not None:
        known = given.select("map_id", "axis", F.col("step").cast("double").alias("known"))
        steps = steps.join(known, ["map_id", "axis"], "left").withColumn("step", F.coalesce("known", "step"))
    fits = stage(steps.select("map_id", "axis", "kind", "n_inliers", "slope", "intercept", "step"))
    values = fitting.snap_values(lines.select("map_id", "axis", "line_no", "pos"), fits, fits.select("map_id", "axis", "step"))
    if anchors is not None:
        by_hand = anchors.select("map_id", "axis", F.col("line_no").cast("long").alias("line_no"), F.col("value").alias("by_hand"), F.lit(True).alias("touched"))
        values = values.join(by_hand, ["map_id", "axis", "line_no"], "left")
        values = values.withColumn("value", F.when(F.col("touched"), F.col("by_hand")).otherwise(F.col("value"))).drop("by_hand", "touched")
    return fits, values


def _anchored(usable: DataFrame, lines: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labels with single anchors among them, all anchors at their lines' places, and the fits of two and more."""
    placed = anchors.filter("value is not null").join(lines.select("map_id", "axis", "line_no", "pos"), ["map_id", "axis", "line_no"])
    placed = placed.join(fitting.line_spacing(lines).select("map_id", "axis", "spacing"), ["map_id", "axis"], "left")
    placed = stage(placed.withColumn("n", F.count("*").over(Window.partitionBy("map_id", "axis"))))
    kinds = placed.groupBy("map_id").agg(F.max("kind").alias("wanted"))
    usable = usable.join(kinds, "map_id", "left").filter("wanted is null or kind = wanted").drop("wanted")
    single = placed.filter("n = 1").select("map_id", F.lit(-1).alias("seq"), "kind", "axis", "line_no", "pos", "value", F.lit(True).alias("complete"), "spacing")
    two = placed.filter("n > 1").groupBy("map_id", "kind", "axis").agg(
        F.count("*").alias("n_inliers"), F.regr_slope("value", "pos").alias("slope"), F.regr_intercept("value", "pos").alias("intercept"),
        (F.min("value") < 0).alias("negative"), F.first("spacing").alias("spacing"), F.lit(True).alias("fixed"),
    )
    return usable.unionByName(single.select(usable.columns)), placed, two.filter("slope is not null")


def legends_of(items: DataFrame, fits: DataFrame, points: DataFrame) -> DataFrame:
    """The first datum, zone and scale in each map's text, with the kind of its values and what its points say: of degrees
    the middle, which decides zone and hemisphere whatever the text says, of metres the highest northing."""
    read = items.select(
        "map_id", "seq", text.find_datum(F.upper(text.normalize(F.col("text")))).alias("datum"),
        text.find_zone(F.col("text")).alias("zone"), text.find_scale(F.col("text")).alias("scale"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    legend = read.groupBy("map_id").agg(first("datum"), first("zone"), first("scale"))
    extent = points.groupBy("map_id").agg(F.avg("x").alias("longitude"), F.avg("y").alias("latitude"), F.max("y").alias("northing"))
    geo = F.col("kind") == "geo"
    return fits.groupBy("map_id").agg(F.first("kind").alias("kind")).join(extent, "map_id", "left").join(legend, "map_id", "left").select(
        "map_id", "kind", "datum", F.when(~geo, F.col("zone.zone")).alias("zone"), F.when(geo, F.col("latitude") < 0).otherwise(F.col("zone.south")).alias("south"),
        F.when(geo, F.col("longitude")).alias("longitude"), F.when(~geo, F.col("northing")).alias("northing"), "scale",
    )


def hinted(legends: DataFrame, region_hint: str | None, default_datum: str | None) -> DataFrame:
    """Legends in metres without a zone take the zones of a hint ("17S,18S"), one row each; those without a datum the default
    one. What they take counts as known, so that a single hint decides."""
    if default_datum:
        legends = legends.withColumn("datum", F.coalesce("datum", F.lit(default_datum)))
    if not region_hint:
        return legends
    known = F.filter(text.region_hints(F.lit(region_hint)), lambda h: h["zone"].isNotNull())
    lacks = (F.col("kind") == "utm") & F.col("zone").isNull() & (F.size(known) > 0)
    each = legends.filter(lacks).withColumn("hint", F.explode(known))
    taken = each.withColumns({"zone": F.col("hint.zone"), "south": F.coalesce("south", "hint.south")}).drop("hint")
    return legends.filter(~lacks).unionByName(taken)


def systems_of(legends: DataFrame, points: DataFrame, region_hint: str | None = None, default_datum: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """legends and control points as printed -> the candidate systems, their ranks by affine error, and the one of each map:
    the first confident one, before it the geographic one for values in degrees, and in its place a projected one whose
    error is clearly less. kind is that of the printed values, made that of the system."""
    kinds = legends.select("map_id", "kind")
    systems = stage(crs.crs_candidates(hinted(legends.drop("scale"), region_hint, default_datum)).distinct().join(kinds, "map_id"))
    order = F.struct(F.when(F.col("confident"), 0).otherwise(1), F.when(F.col("made") == "geo", 0).otherwise(1), "epsg")
    first = systems.groupBy("map_id", "kind").agg(F.min_by("epsg", order).alias("first"), F.min_by("made", order).alias("made"), F.max("confident").alias("confident"), F.count("*").alias("n_systems"))
    ranks = stage(refine.system_ranks(points, systems.select("map_id", "epsg", "kind")))
    better = ranks.filter("replaces").select("map_id", F.col("epsg").alias("better"))
    chosen = first.join(better, "map_id", "left").withColumn("epsg", F.coalesce("better", "first")).withColumn("made", F.when(F.col("better").isNotNull(), "utm").otherwise(F.col("made")))
    return systems, ranks, stage(chosen.drop("better", "first"))


@dataclass
class Evaluated:
    """Lines with values: what the labels say of each map's lines, and the control points as printed."""

    drawn: DataFrame
    fits: DataFrame
    values: DataFrame
    bounds: DataFrame
    points: DataFrame


def evaluate(maps: DataFrame, labels: DataFrame, lines: DataFrame, anchors: DataFrame | None = None, steps: DataFrame | None = None) -> Evaluated:
    """Labels belong to lattice lines where a family has a lattice; a robust fit of each axis gives every line its value, and
    values set by hand stand."""
    drawn = stage(geometry(lines, maps))
    regular = stage(refine.grid_lines(drawn))
    matched = stage(associate(labels, regular, maps))
    fits, values = axis_values(matched, drawn, anchors, steps)
    values = stage(values.filter("value is not null"))
    bounds = stage(maps.join(frames_of(regular), "map_id"))
    points = stage(matching.crossings(drawn.join(values, ["map_id", "axis", "line_no"]), bounds))
    return Evaluated(drawn, fits, values, bounds, points)


def georeference(maps: DataFrame, items: DataFrame, lines: DataFrame, region_hint: str | None = None, default_datum: str | None = None) -> Georeferenced:
    """maps(map_id, width, height, dpi), items(map_id, seq, text, x0, y0, x1, y1), lines(map_id, axis, line_no, slope,
    intercept). Ids may be of any type. Maps without a fit get a status all the same."""
    labels = stage(labels_of(items))
    return conclude(maps, items, labels, evaluate(maps, labels, lines), region_hint, default_datum)


def set_systems(chosen: DataFrame, legends: DataFrame, by_hand: DataFrame) -> DataFrame:
    """chosen systems with those of by_hand(map_id, epsg), one a map, in their place; they count as confident."""
    geographic = by_hand.select("epsg").distinct().join(crs.zones_of(by_hand.select("epsg").distinct()), "epsg", "left_anti").select("epsg", F.lit("geo").alias("made"))
    rows = legends.select("map_id", "kind").distinct().join(by_hand, "map_id").join(geographic, "epsg", "left")
    values = {"made": F.coalesce("made", F.lit("utm")), "confident": F.lit(True), "n_systems": F.lit(1)}
    rows = rows.withColumns(values).select(*(F.col(f.name).cast(f.dataType) for f in chosen.schema))
    return stage(chosen.join(by_hand.select("map_id"), "map_id", "left_anti").select(chosen.columns).unionByName(rows))


def stands(proposed: Column, said: Column, epsg: Column) -> Column:
    """Whether a submission agrees with the system that its map ends with; one that names none, or that gives up, does."""
    return ~proposed.isin("ok", "needs_review") | (F.coalesce(said, F.lit(0)) == 0) | said.eqNullSafe(epsg)


def conclude(
    maps: DataFrame, items: DataFrame, labels: DataFrame, found: Evaluated, region_hint: str | None = None, default_datum: str | None = None,
    by_hand: DataFrame | None = None, submitted: DataFrame | None = None,
) -> Georeferenced:
    """Of a map in degrees the system that it was drawn in is the one with clearly least affine error; lines whose points all
    stand off to one side lose their value, one a round; the kind of transformation follows from the error of leaving points
    out. A hint of zones and a default datum serve maps whose text says neither. Systems
    by_hand(map_id, epsg) stand; what is submitted(map_id, proposed, said, confidence) counts where it agrees with the system."""
    drawn, fits, values, bounds, points = found.drawn, found.fits, found.values, found.bounds, found.points
    legends = stage(legends_of(items, fits, points))
    systems, ranks, chosen = systems_of(legends, points, region_hint, default_datum)
    if by_hand is not None:
        chosen = set_systems(chosen, legends, by_hand)
    gcps, values, dropped = refine.consistent(drawn, values, bounds, chosen.filter("epsg is not null").select("map_id", "epsg", "kind"))
    models = gcps.groupBy("map_id").agg(F.max("kind").alias("model"), F.max("n").alias("n"), F.max("rmse").alias("rmse"), F.max("loo").alias("loo"), F.max(F.hypot("rx", "ry")).alias("worst"))
    models = stage(models.filter("n is not null"))
    affine = fitting.affine_fit(gcps)
    middle = gcps.filter("epsg is not null").groupBy("map_id", "epsg").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    area = stage(crs.area_of_use(stage(middle)).select("map_id", "in_area"))
    degrees = (F.col("label_kind") == "geo") & F.coalesce(F.col("made") == "geo", F.lit(True))
    state = stage(
        maps.join(models.drop("worst"), "map_id", "left").join(affine.drop("n", "rmse", "worst"), "map_id", "left").join(chosen.drop("kind"), "map_id", "left")
        .join(legends.select("map_id", F.col("kind").alias("label_kind"), "scale"), "map_id", "left").join(area, "map_id", "left")
        .select(
            "map_id", "n", "rmse", "loo", "mirrored", F.degrees(F.atan2("b", "a")).alias("rotation"), "pixel_x", "pixel_y",
            F.when(degrees, "deg").otherwise("m").alias("units"), F.col("scale").cast("double"), F.col("dpi").cast("double"),
            F.when(F.col("confident") | (F.col("n_systems") == 1) | (F.col("label_kind") == "geo"), F.col("epsg")).alias("epsg"), "in_area", F.coalesce("confident", F.lit(False)).alias("confident"),
        )
    )
    valued = drawn.join(values, ["map_id", "axis", "line_no"]).select("map_id", "axis", "line_no", "pos", "value")
    checks = rules.check_rows(state, valued)
    passed = rules.passed(state, valued)
    seen = labels.groupBy("map_id").agg(F.bool_or("complete").alias("has_coordinates"))
    read = items.groupBy("map_id").agg(F.lit(True).alias("has_text"))
    if submitted is None:
        submitted = state.select("map_id", F.lit(None).cast("string").alias("proposed"), F.lit(None).cast("long").alias("said"), F.lit(None).cast("double").alias("confidence")).limit(0)
    agreed = F.coalesce(stands(F.col("proposed"), F.col("said"), F.col("epsg")), F.lit(False))
    proposal = (
        state.join(submitted, "map_id", "left").join(passed, "map_id").join(seen, "map_id", "left").join(read, "map_id", "left")
        .select("map_id", F.col("n").isNotNull().alias("has_fit"), "passed", F.when(agreed, F.col("proposed")).alias("proposed"), F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("has_coordinates", F.lit(False)).alias("has_coordinates"), F.when(agreed, F.col("confidence")).alias("confidence"), "epsg")
    )
    status = rules.status(proposal).join(state.select("map_id", "epsg", "n", "rmse", "loo"), "map_id").join(models.select("map_id", "model"), "map_id", "left")
    return Georeferenced(labels, fits, values, gcps, affine, models, dropped, ranks, legends, systems, checks, status)
