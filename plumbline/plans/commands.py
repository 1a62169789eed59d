"""Values, systems and results set by hand: a table of commands replayed over the maps that it names, and over no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import crs
from .georeference import Georeferenced, conclude, evaluate, labels_of, stands
from .stages import stage


def anchors_of(commands: DataFrame) -> DataFrame:
    """commands(map_id, seq, line: V3 or H2, value as written, `none` to exclude the line) -> map_id, axis, line_no, kind, value.
    The last command of a line counts; one whose value or line cannot be read is passed over."""
    word = F.lower(F.trim("value"))
    excluded = F.col("value").isNull() | word.isin("", "none", "null", "-")
    number = F.when(~excluded, text.parse_value(F.col("value")))
    read = commands.select(
        "map_id", "seq", F.when(F.col("line").rlike(r"^V\d+$"), "x").when(F.col("line").rlike(r"^H\d+$"), "y").alias("axis"),
        F.regexp_extract("line", r"^[VH](\d+)$", 1).try_cast("long").alias("line_no"), excluded.alias("excluded"), number.alias("value"),
    )
    read = read.filter("axis is not null and line_no is not null and (excluded or value is not null)")
    last = Window.partitionBy("map_id", "axis", "line_no").orderBy(F.desc("seq"))
    read = read.withColumn("place", F.row_number().over(last)).filter("place = 1")
    return read.select("map_id", "axis", "line_no", F.when(F.abs("value") <= 180, "geo").when(F.col("value").isNotNull(), "utm").alias("kind"), "value")


def steps_of(commands: DataFrame) -> DataFrame:
    """The known steps among the commands, whose line is `step x` or `step y`: map_id, axis, step; the last one counts."""
    read = commands.select("map_id", "seq", F.regexp_extract("line", "^step ([xy])$", 1).alias("axis"), F.col("value").try_cast("double").alias("step"))
    read = read.filter("axis <> '' and step > 0")
    return read.groupBy("map_id", "axis").agg(F.max_by("step", "seq").alias("step"))


def assign(maps: DataFrame, items: DataFrame, lines: DataFrame, commands: DataFrame, region_hint: str | None = None, default_datum: str | None = None) -> Georeferenced:
    """The plan over the maps that commands name, with their values set and the rest of each grid following from them."""
    anchors = stage(anchors_of(commands))
    steps = stage(steps_of(commands))
    touched = stage(anchors.select("map_id").union(steps.select("map_id")).distinct())
    own = lambda df: df.join(touched, "map_id", "left_semi")
    labels = stage(labels_of(own(items)))
    return conclude(own(maps), own(items), labels, evaluate(own(maps), labels, own(lines), anchors, steps), region_hint, default_datum)


# What a submission may say.
RESULTS = ("ok", "needs_review", "no_coordinates", "failed")


def checked(commands: DataFrame) -> DataFrame:
    """commands(map_id, seq, command: set_crs or submit_result, epsg, evidence, status, confidence) with the reason that
    refuses one: a system must have a known code and evidence, a submission one of RESULTS. Rows with a null map_id go."""
    codes = commands.select("epsg").filter("epsg is not null").distinct()
    known = crs.crs_names(codes).filter(~F.col("name").endswith("(unknown)")).select("epsg", F.lit(True).alias("known"))
    is_set, is_result = F.col("command") == "set_crs", F.col("command") == "submit_result"
    reason = (
        F.when(is_set & F.col("known").isNull(), "unknown system").when(is_set & (F.coalesce(F.trim("evidence"), F.lit("")) == ""), "no evidence")
        .when(is_result & ~F.coalesce(F.col("status").isin(*RESULTS), F.lit(False)), "unknown result").when(~F.coalesce(is_set | is_result, F.lit(False)), "unknown command")
    )
    read = commands.filter("map_id is not null").join(F.broadcast(known), "epsg", "left")  # at most the codes of the dimension
    return read.select("map_id", "seq", "command", F.col("epsg").cast("long").alias("epsg"), "evidence", "status", F.col("confidence").cast("double").alias("confidence"), reason.alias("reason"))


def decide(maps: DataFrame, items: DataFrame, lines: DataFrame, commands: DataFrame, region_hint: str | None = None, default_datum: str | None = None) -> tuple[Georeferenced, DataFrame]:
    """The plan over the maps that commands name, with systems set and results submitted; and the refused commands(map_id, seq,
    reason). Of each map the last system and the last result that are not refused count; a result must name the system that
    its map ends with, or none. A system does nothing for a map without a fit. An ok stands only if the checks pass."""
    read = stage(checked(commands))
    valid = read.filter("reason is null")
    by_hand = stage(valid.filter("command = 'set_crs'").groupBy("map_id").agg(F.max_by("epsg", "seq").alias("epsg")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    last = F.max_by(F.struct(F.col("status").alias("proposed"), F.col("epsg").alias("said"), F.when(F.col("confidence").isNotNull(), confidence).alias("confidence"), "seq"), "seq")
    results = stage(valid.filter("command = 'submit_result'").groupBy("map_id").agg(last.alias("r")).select("map_id", "r.*"))
    touched = stage(read.select("map_id").distinct())
    own = lambda df: df.join(touched, "map_id", "left_semi")
    labels = stage(labels_of(own(items)))
    found = evaluate(own(maps), labels, own(lines))
    result = conclude(own(maps), own(items), labels, found, region_hint, default_datum, by_hand, results.drop("seq"))
    ended = results.join(result.status.select("map_id", "epsg"), "map_id")
    other = ended.filter(~stands(F.col("proposed"), F.col("said"), F.col("epsg"))).select("map_id", "seq", F.lit("another system").alias("reason"))
    return result, read.filter("reason is not null").select("map_id", "seq", "reason").unionByName(other)
