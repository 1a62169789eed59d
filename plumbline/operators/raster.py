"""Grid lines from gray rasters, as a relation of stripes.

A map's raster is cut into overlapping stripes of rows, so that a large map is many rows and many tasks. Small numpy
helpers measure one stripe at a time; everything across stripes is Spark's: profiles are summed by angle and bin, the
angle with the largest sum of squares, refined by a second pass of small steps around it, is the skew, local maxima of its profile are lines, and each line is fitted, with
trimming, through the centers of darkness that its stripes report.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fitting import trimmed_line

ROWS, MARGIN = 128, 12
#: Skew angles tried, in degrees: half range and step; then around each map's best one.
SKEW, SKEW_STEP, FINE_STEP = 6.0, 0.25, 0.02
#: A line covers this share of the map's side; candidates lie this far apart.
SUPPORT, APART = 0.4, 12
#: Half window around a line, in pixels, and pixels between its stations.
HALF, STATION = 6, 16
#: Arm of a drawn cross.
ARM = 15


def stripes(images: DataFrame) -> DataFrame:
    """images(map_id, width, height, pixels: one byte each, row by row) -> stripes with MARGIN rows around each."""
    n = F.ceil(F.col("height") / ROWS).cast("int")
    cut = images.withColumn("stripe", F.explode(F.sequence(F.lit(0), n - 1)))
    top = F.greatest(F.lit(0), F.col("stripe") * ROWS - MARGIN)
    bottom = F.least(F.col("height"), (F.col("stripe") + 1) * ROWS + MARGIN)
    return cut.select("map_id", "width", "height", "stripe", top.alias("top"), F.substring("pixels", top * F.col("width") + 1, (bottom - top) * F.col("width")).alias("pixels"))


def _image(pixels: bytes, width: int) -> np.ndarray:
    """Darkness of each pixel below the stripe's median."""
    gray = np.frombuffer(pixels, np.uint8).reshape(-1, width).astype(np.float32)
    return np.clip(np.median(gray) - gray, 0, None)


def _own(stripe: int, top: int, n: int) -> slice:
    """The stripe's own rows without its margins."""
    return slice(stripe * ROWS - top, min(n, (stripe + 1) * ROWS - top))


def profiles(cut: DataFrame, reach: float = SKEW, step: float = SKEW_STEP) -> DataFrame:
    """Dark pixels by axis, angle and bin: along lines sheared by each angle within reach of the column around, or zero."""
    angles = np.arange(-reach, reach + step / 2, step)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("map_id", "axis", "angle", "bin", "n")}
            for r in batch.to_pylist():
                dark = _image(r["pixels"], r["width"])
                own = _own(r["stripe"], r["top"], len(dark))
                y, x = np.nonzero(dark[own] > 40)
                y = y + r["top"] + own.start
                for k, a in enumerate(np.tan(np.radians(angles + r.get("around", 0.0)))):
                    for axis, v in (("x", x + (y - r["height"] / 2) * a), ("y", y - (x - r["width"] / 2) * a)):
                        bins, n = np.unique(np.rint(v).astype(np.int64), return_counts=True)
                        out["map_id"] += [r["map_id"]] * len(bins)
                        out["axis"] += [axis] * len(bins)
                        out["angle"] += [k] * len(bins)
                        out["bin"] += bins.tolist()
                        out["n"] += n.tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([("map_id", pa.int64()), ("axis", pa.string()), ("angle", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())]))

    return cut.mapInArrow(run, "map_id long, axis string, angle int, bin long, n long").groupBy("map_id", "axis", "angle", "bin").agg(F.sum("n").alias("n"))


def best_angles(summed: DataFrame) -> DataFrame:
    """map_id and the angle whose profiles, of both axes together, have the largest sum of squares."""
    score = summed.groupBy("map_id", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    return score.withColumn("place", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("score"), "angle"))).filter("place = 1").select("map_id", "angle")


def candidates(summed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The local maxima, at each map's best fine angle, of its profiles that are long enough; sizes has the column around."""
    best = best_angles(summed)
    near = Window.partitionBy("map_id", "axis").orderBy("bin").rangeBetween(-APART, APART)
    # a line may spread over neighbouring bins
    pair = F.sum("n").over(Window.partitionBy("map_id", "axis").orderBy("bin").rangeBetween(-1, 1))
    rows = summed.join(best, ["map_id", "angle"]).withColumn("s", pair).withColumn("top", F.max(F.struct("s", -F.col("bin"))).over(near))
    peaks = rows.filter((F.col("top.s") == F.col("s")) & (F.col("top.col2") == -F.col("bin"))).join(sizes, "map_id")
    side = F.when(F.col("axis") == "x", F.col("height")).otherwise(F.col("width"))
    slope = F.tan(F.radians(F.col("around") + F.col("angle") * FINE_STEP - SKEW_STEP))
    return peaks.filter(F.col("s") >= SUPPORT * side).select("map_id", "axis", "bin", slope.alias("shear"))


def samples(cut: DataFrame, lines: DataFrame) -> DataFrame:
    """Centers of darkness at stations along each candidate: group_id (map, axis, bin), t along the line, v across."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("group_id", "t", "v")}
            for r in batch.to_pylist():
                dark = _image(r["pixels"], r["width"])
                own = _own(r["stripe"], r["top"], len(dark))
                reach = np.arange(-HALF, HALF + 1)
                for line in r["lines"]:
                    vertical = line["axis"] == "x"
                    if vertical:
                        t = np.arange(r["top"] + own.start, r["top"] + own.stop, 4)
                        at = np.rint(line["bin"] - (t - r["height"] / 2) * line["shear"]).astype(int)
                        good = (at >= HALF) & (at < r["width"] - HALF)
                    else:
                        t = np.arange(0, r["width"], STATION)
                        at = np.rint(line["bin"] + (t - r["width"] / 2) * line["shear"]).astype(int)
                        good = (at >= r["top"] + own.start) & (at < r["top"] + own.stop) & (at - HALF >= r["top"]) & (at + HALF < r["top"] + len(dark))
                    t, at = t[good], at[good]
                    if not len(t):
                        continue
                    across = at[:, None] + reach
                    w = dark[(t - r["top"])[:, None], across] if vertical else dark[across - r["top"], t[:, None]]
                    w = np.where(w > 0.4 * w.max(axis=1, keepdims=True), w, 0)
                    seen = w.max(axis=1) > 40
                    center = (w * across)[seen].sum(axis=1) / w[seen].sum(axis=1)
                    out["group_id"] += [f"{r['map_id']}:{line['axis']}:{line['bin']}"] * int(seen.sum())
                    out["t"] += t[seen].astype(float).tolist()
                    out["v"] += center.tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([("group_id", pa.string()), ("t", pa.float64()), ("v", pa.float64())]))

    held = lines.groupBy("map_id").agg(F.collect_list(F.struct("axis", "bin", "shear")).alias("lines"))
    return cut.join(held, "map_id").mapInArrow(run, "group_id string, t double, v double")


def detect_lines(images: DataFrame) -> DataFrame:
    """images -> map_id, axis, line_no in order of position, slope and intercept (x by y of vertical lines, y by x)."""
    cut = stripes(images)
    around = best_angles(profiles(cut)).select("map_id", (F.col("angle") * SKEW_STEP - SKEW).alias("around"))
    fine = profiles(cut.join(around, "map_id"), SKEW_STEP, FINE_STEP)
    found = candidates(fine, images.select("map_id", "width", "height").join(around, "map_id"))
    fitted = trimmed_line(samples(cut, found))
    part = F.split("group_id", ":")
    lines = fitted.select(part[0].cast("long").alias("map_id"), part[1].alias("axis"), part[2].cast("long").alias("bin"), "slope", "intercept", "n_kept")
    order = Window.partitionBy("map_id", "axis").orderBy("bin")
    return lines.withColumn("line_no", F.row_number().over(order).cast("long")).select("map_id", "axis", "line_no", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_kept")


def synthetic_maps(specs: DataFrame, crosses: bool = False) -> DataFrame:
    """specs(map_id, width, height, rotation, step) -> images with a rotated grid (or only its crossings), clutter and
    noise; line k crosses the middle at step k."""

    def run(batches):
        for batch in batches:
            pixels = []
            for r in batch.to_pylist():
                rng = np.random.default_rng(r["map_id"])
                y, x = np.mgrid[0 : r["height"], 0 : r["width"]].astype(np.float32)
                gray = 235 + rng.normal(0, 5, x.shape).astype(np.float32)
                m = math.tan(math.radians(r["rotation"]))
                u = [x + (y - r["height"] / 2) * m, y - (x - r["width"] / 2) * m]
                off = [np.abs(v - r["step"] * np.rint(v / r["step"])) / math.hypot(1, m) for v in u]
                drawn = [np.clip(1.5 - off[k], 0, 1) * (np.rint(u[k] / r["step"]) > 0) for k in (0, 1)]
                if crosses:
                    drawn = [drawn[k] * (off[1 - k] <= ARM) * (np.rint(u[1 - k] / r["step"]) > 0) for k in (0, 1)]
                gray -= 150 * np.maximum(*drawn)
                for _ in range(30):
                    a, b = rng.integers(0, r["height"] - 12), rng.integers(0, r["width"] - 40)
                    gray[a : a + 8, b : b + int(rng.integers(8, 36))] -= 90
                pixels.append(np.clip(gray, 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("map_id"), batch.column("width"), batch.column("height"), pa.array(pixels, pa.binary())], ["map_id", "width", "height", "pixels"])

    return specs.select("map_id", F.col("width").cast("int"), F.col("height").cast("int"), "rotation", "step").mapInArrow(run, "map_id long, width int, height int, pixels binary")
