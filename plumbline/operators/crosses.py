"""Grid crosses: sheets that print only the crossings of their grid.

Stripes of a raster report the centers of crosses, found where long horizontal and vertical dark runs meet; the rest is
relational: the skew is the median angle between neighbours, turned positions form columns and rows where the gap to the
previous member stays small, groups of too few members go, and the rest are parallel lines of one slope.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import _image, _own

#: Shortest and longest arm to arm, in pixels, and the gap that parts two columns or rows.
SHORT, LONG = 13, 80
GAP = 4.0
#: Thickest arm, in pixels.
THICK = 5


def _runs(dark: np.ndarray) -> np.ndarray:
    """Length of the horizontal run that each dark pixel belongs to."""
    height, width = dark.shape
    padded = np.zeros((height, width + 2), dtype=np.int8)
    padded[:, 1:-1] = dark
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1]
    out = np.zeros(dark.shape, dtype=np.int32)
    n = last - first
    out[np.repeat(row, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(n, n)
    return out


def centers(dark: np.ndarray) -> list[tuple[float, float, int]]:
    """(x, y, arm to arm) of the crosses in an image of darkness."""
    ink = dark > 40
    across, down = _runs(ink), _runs(ink.T).T
    meet = (across >= SHORT) & (down >= SHORT) & (across <= LONG) & (down <= LONG)
    found = []
    y, x = np.nonzero(meet)
    taken = np.zeros(len(y), dtype=bool)
    for i in range(len(y)):
        if taken[i]:
            continue
        near = (np.abs(y - y[i]) <= SHORT // 2) & (np.abs(x - x[i]) <= SHORT // 2)
        taken |= near
        cx, cy = int(round(x[near].mean())), int(round(y[near].mean()))
        arm = int(min(across[cy, cx] or SHORT, down[cy, cx] or SHORT)) // 2
        a, b, c, d = cx - arm, cx + arm + 1, cy - arm, cy + arm + 1
        if a < 0 or c < 0 or b > dark.shape[1] or d > dark.shape[0]:
            continue
        # the arms without the middle, each across its own direction
        off = max(3, arm // 3)
        upright = np.concatenate([dark[c : cy - off, cx - 4 : cx + 5], dark[cy + off + 1 : d, cx - 4 : cx + 5]]).sum(axis=0)
        level = np.concatenate([dark[cy - 4 : cy + 5, a : cx - off], dark[cy - 4 : cy + 5, cx + off + 1 : b]], axis=1).sum(axis=1)
        if len(upright) == 9 and len(level) == 9 and upright.sum() > 0 and level.sum() > 0:
            w, v = (np.where(s > 0.4 * s.max(), s, 0) for s in (upright, level))
            if max((w > 0).sum(), (v > 0).sum()) > THICK:
                continue  # a block, or a cross that one covers
            found.append((cx + float((w * np.arange(-4, 5)).sum() / w.sum()), cy + float((v * np.arange(-4, 5)).sum() / v.sum()), 2 * arm + 1))
    return found


def crosses(cut: DataFrame) -> DataFrame:
    """stripes -> map_id, x, y, arm of each cross, reported by the stripe that owns its row."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("map_id", "x", "y", "arm")}
            for r in batch.to_pylist():
                dark = _image(r["pixels"], r["width"])
                own = _own(r["stripe"], r["top"], len(dark))
                for x, y, arm in centers(dark):
                    if own.start <= y < own.stop:
                        for k, v in zip(out, (r["map_id"], x, y + r["top"], arm)):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("map_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("arm", pa.int64())]))

    return cut.mapInArrow(run, "map_id long, x double, y double, arm long")


def skew(points: DataFrame) -> DataFrame:
    """map_id and the slope of the rows: the median over each cross's nearest neighbour to its right."""
    a, b = points.select("map_id", "x", "y"), points.select("map_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = a.join(b, "map_id").filter((F.col("x2") > F.col("x") + 10) & (F.abs(F.col("y2") - F.col("y")) < 0.12 * (F.col("x2") - F.col("x"))))
    slope = ((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope")
    nearest = pairs.groupBy("map_id", "x", "y").agg(F.min_by(slope, F.col("x2") - F.col("x")).alias("slope"))
    return nearest.groupBy("map_id").agg(F.median("slope").alias("skew"))


def lines_of_crosses(points: DataFrame) -> DataFrame:
    """crosses(map_id, x, y) -> map_id, axis, line_no, slope, intercept, n_kept, as raster.detect_lines gives them."""
    turned = points.join(skew(points), "map_id")
    both = turned.select("map_id", F.lit("x").alias("axis"), (F.col("x") + F.col("y") * F.col("skew")).alias("u"), F.col("y").alias("t"), F.col("x").alias("v")).union(
        turned.select("map_id", F.lit("y").alias("axis"), (F.col("y") - F.col("x") * F.col("skew")).alias("u"), F.col("x").alias("t"), F.col("y").alias("v"))
    )
    order = Window.partitionBy("map_id", "axis").orderBy("u")
    starts = F.when(F.col("u") - F.lag("u").over(order) <= GAP, 0).otherwise(1)
    groups = both.withColumn("starts", starts).withColumn("line_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = groups.groupBy("map_id", "axis", "line_no").agg(F.count("*").alias("n"))
    middle = size.groupBy("map_id", "axis").agg(F.median("n").alias("middle"))
    kept = size.join(middle, ["map_id", "axis"]).filter((F.col("n") >= 2) & (F.col("n") >= F.floor(0.4 * F.col("middle")))).select("map_id", "axis", "line_no")
    held = groups.join(kept, ["map_id", "axis", "line_no"])
    # the lines of a family are parallel: one slope over all, then each line through the middle of its crosses
    own = held.groupBy("map_id", "axis", "line_no").agg((F.covar_pop("t", "v") * F.count("*")).alias("tv"), (F.var_pop("t") * F.count("*")).alias("tt"))
    slopes = own.groupBy("map_id", "axis").agg((F.sum("tv") / F.sum("tt")).alias("slope")).filter("slope is not null")
    rest = held.join(slopes, ["map_id", "axis"]).withColumn("rest", F.col("v") - F.col("slope") * F.col("t"))
    fitted = rest.groupBy("map_id", "axis", "line_no", "slope").agg(F.median("rest").alias("intercept"), F.count("*").alias("n_kept"))
    number = F.row_number().over(Window.partitionBy("map_id", "axis").orderBy("line_no")).cast("long")
    return fitted.withColumn("line_no", number).select("map_id", "axis", "line_no", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_kept")
