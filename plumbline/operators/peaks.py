"""Peaks of a profile: plateaus, least height, distance by priority, prominence and width; one pass and two stacks each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maxima(v: np.ndarray) -> np.ndarray:
    """Places of local maxima; of a plateau the middle one, the left of two. The ends are none."""
    if len(v) < 3:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # first place of each run of equal values
    end = np.concatenate([start[1:], [len(v)]]) - 1
    level = v[start]
    top = np.zeros(len(start), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (start[top] + end[top]) // 2


def apart(places: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay if the highest go first and each removes those nearer than distance; the later wins ties."""
    kept = np.ones(len(places), bool)
    for i in np.lexsort((places, height))[::-1]:
        if kept[i]:
            near = np.abs(places - places[i]) < distance
            near[i] = False
            kept &= ~near
    return kept


def bases(v: np.ndarray) -> np.ndarray:
    """For each place the least value on the way left to the first higher one (or the end), by a stack."""
    low, stack = np.empty(len(v)), []
    for i, x in enumerate(v.tolist()):
        least = x
        while stack and stack[-1][0] <= x:
            least = min(least, stack.pop()[1])
        low[i] = least
        stack.append((x, least))
    return low


def prominences(v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How far a peak stands above the higher of its two bases."""
    if not len(places):
        return np.zeros(0)
    return v[places] - np.maximum(bases(v)[places], bases(v[::-1])[::-1][places])


def find(v: np.ndarray, height: float = -np.inf, distance: float = 1, prominence: float = 0.0) -> np.ndarray:
    """Places of the peaks that reach a height, then keep their distance, then stand out."""
    v = np.asarray(v, float)
    at = maxima(v)
    at = at[v[at] >= height]
    at = at[apart(at, v[at], distance)]
    return at[prominences(v, at) >= prominence]


def widths(v: np.ndarray, places: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Width of each peak at `share` of its prominence below the top, ends interpolated."""
    level, out = v[places] - share * prominences(v, places), np.zeros(len(places))
    for k, (p, h) in enumerate(zip(places, level)):
        i = j = p
        while i > 0 and v[i] > h:
            i -= 1
        while j < len(v) - 1 and v[j] > h:
            j += 1
        left = i + (h - v[i]) / (v[i + 1] - v[i]) if v[i] < h else float(i)
        right = j - (h - v[j]) / (v[j - 1] - v[j]) if v[j] < h else float(j)
        out[k] = right - left
    return out


def profile_peaks(points: DataFrame, height: float, distance: float, prominence: float) -> DataFrame:
    """points(group_id, t, v), a profile in order of t -> group_id, place (from 1), t, height and prominence of its peaks. A
    profile is as long as a side of an image."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("group", "place", "t", "height", "prominence")}
            for row, (t, v) in enumerate(zip(batch.column("t"), batch.column("v"))):
                t, v = t.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
                at = find(v, height, distance, prominence)
                for c, x in zip(out, (np.full(len(at), row), at + 1, t[at], v[at], prominences(v, at))):
                    out[c].append(x)
            flat = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("group_id").take(pa.array(flat["group"].astype(np.int64))), pa.array(flat["place"].astype(np.int64)), *(pa.array(flat[c].astype(float)) for c in ("t", "height", "prominence"))],
                ["group_id", "place", "t", "height", "prominence"],
            )

    held = points.filter("t is not null and v is not null").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    found = held.select("group_id", F.col("p.t").cast("array<double>").alias("t"), F.col("p.v").cast("array<double>").alias("v")).mapInArrow(
        run, f"group_id {points.schema['group_id'].dataType.simpleString()}, place long, t double, height double, prominence double"
    )
    return found.select("group_id", "place", "t", F.round("height", 6).alias("height"), F.round("prominence", 6).alias("prominence"))


#: The same for a second engine, peak by peak: a greedy choice by height as a fold over the sorted peaks.
PEAKS_SECOND = """
WITH numbered AS (SELECT group_id, t, v, row_number() OVER (PARTITION BY group_id ORDER BY t, v) AS place FROM points WHERE t IS NOT NULL AND v IS NOT NULL),
steps AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM numbered WINDOW w AS (PARTITION BY group_id ORDER BY place)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY group_id ORDER BY place) AS run FROM steps),
levels AS (SELECT group_id, run, min(v) AS v, min(place) AS a, max(place) AS b FROM runs GROUP BY group_id, run),
tops AS (SELECT *, lag(v) OVER w AS before_, lead(v) OVER w AS after_ FROM levels WINDOW w AS (PARTITION BY group_id ORDER BY run)),
peaks AS MATERIALIZED (SELECT group_id, (a + b) // 2 AS place, v FROM tops WHERE v > before_ AND v > after_ AND v >= {height}),
chosen AS MATERIALIZED (
  SELECT group_id, unnest(list_reduce(list(place ORDER BY v DESC, place DESC), lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: abs(q - p) < {distance})) = 0 THEN list_append(kept, p) ELSE kept END, CAST([] AS BIGINT[]))) AS place
  FROM peaks GROUP BY group_id),
bounds AS (
  SELECT c.group_id, c.place, n.t, n.v,
         (SELECT coalesce(max(m.place), 0) FROM numbered m WHERE m.group_id = c.group_id AND m.place < c.place AND m.v > n.v) AS lo,
         (SELECT coalesce(min(m.place), 1000000000) FROM numbered m WHERE m.group_id = c.group_id AND m.place > c.place AND m.v > n.v) AS hi
  FROM chosen c JOIN numbered n ON n.group_id = c.group_id AND n.place = c.place),
based AS (
  SELECT b.group_id, b.place, b.t, b.v, min(CASE WHEN m.place <= b.place THEN m.v END) AS left_, min(CASE WHEN m.place >= b.place THEN m.v END) AS right_
  FROM bounds b JOIN numbered m ON m.group_id = b.group_id AND m.place > b.lo AND m.place < b.hi GROUP BY b.group_id, b.place, b.t, b.v)
SELECT group_id, CAST(place AS BIGINT) AS place, t, round(v, 6) AS height, round(v - greatest(left_, right_), 6) AS prominence FROM based WHERE v - greatest(left_, right_) >= {prominence}
"""
