"""The two fits that try every pair of a family: one row a family, and families of one size as one array.

Labels or lines of a map and axis meet in one shuffle as an array in a row. A task takes the rows of an Arrow batch that have
equally many members and measures all pairs of all of them at once, about CELLS numbers at a time, so that neither pairs nor
their votes become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that one step of the work holds.
CELLS = 1 << 21


def in_rows(df: DataFrame, *members: str) -> DataFrame:
    """map_id, axis and the family's members as arrays, in order of the first of them."""
    held = df.filter(F.col(members[0]).isNotNull()).groupBy("map_id", "axis").agg(F.array_sort(F.collect_list(F.struct(*members))).alias("held"))
    return held.select("map_id", "axis", *(F.col(f"held.{m}").alias(m) for m in members))


def by_size(batch: pa.RecordBatch, members: list[str], cells: Callable[[int], int]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and members (rows by members) of the batch's families of one size; cells gives what one of them takes."""
    columns = [batch.column(m) for m in members]
    size = np.diff(columns[0].offsets.to_numpy())
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    first = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        rows, step = np.flatnonzero(size == n), max(1, CELLS // max(1, cells(int(n))))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            at = first[part][:, None] + np.arange(n)
            yield part, [f[at] for f in flat]


def _blocks(pairs: int, cells: int) -> Iterator[slice]:
    """The pairs in blocks of so many that each takes `cells` numbers and all together CELLS."""
    step = max(1, CELLS // max(1, cells))
    return (slice(k, k + step) for k in range(0, pairs, step))


def _first(keys: list[np.ndarray]) -> np.ndarray:
    """In each row the place of the least of the tuples that stand beside each other in keys, the first key counting most."""
    return np.lexsort(keys[::-1], axis=1)[:, 0]


def fit_axes(pos: np.ndarray, seq: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each family (rows by labels, in order of pos): inliers of the best pair, slope, intercept and worst distance."""
    pairs, value, rows = np.triu_indices(pos.shape[1], 1), value.astype(float), np.arange(len(pos))
    take = lambda x, k: np.take_along_axis(x, k, 1)
    with np.errstate(all="ignore"):
        gaps = np.sort(np.where((g := np.diff(pos, axis=1)) > 1e-6, g, np.nan), axis=1)
        n_gaps = np.isfinite(gaps).sum(axis=1)[:, None]
        spacing = (take(gaps, np.maximum(n_gaps - 1, 0) // 2) + take(gaps, np.minimum(n_gaps // 2, gaps.shape[1] - 1))) / 2
        best = None
        for part in _blocks(len(pairs[0]), pos.size):
            i, j = pairs[0][part], pairs[1][part]
            swap = seq[:, i] > seq[:, j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            rise, run = take(value, b) - take(value, a), take(pos, b) - take(pos, a)
            slope = rise / run
            intercept = take(value, a) - slope * take(pos, a)
            off = np.abs(value[:, None] - intercept[..., None] - slope[..., None] * pos[:, None])
            inlier = off < (np.abs(slope) * 0.25 * spacing)[..., None]
            place = np.broadcast_to(np.rint(pos * 10)[:, None], off.shape)
            apart = np.where(inlier, place, np.inf).min(axis=2) != np.where(inlier, place, -np.inf).max(axis=2)
            sound = (np.abs(run) >= 1e-6) & (rise != 0) & np.isfinite(slope) & (take(seq, a) < take(seq, b)) & apart
            keys = [-np.where(sound, inlier.sum(axis=2), -1), np.round(np.where(inlier, off, 0).sum(axis=2), 6), take(seq, a), take(seq, b), slope, intercept]
            at = _first(keys[:4])
            found = [k[rows, at][:, None] for k in keys]
            best = found if best is None else [take(np.hstack(x), _first([np.hstack(y) for y in zip(best[:4], found[:4])])[:, None]) for x in zip(best, found)]
        n, slope, intercept = -best[0][:, 0], best[4], best[5]
        off = np.abs(value - intercept - slope * pos)
        kept, count = off < np.abs(slope) * 0.25 * spacing, np.maximum(n, 1)
        mean = lambda x: np.where(kept, x, 0).sum(axis=1) / count
        dx, dy = pos - mean(pos)[:, None], value - mean(value)[:, None]
        fitted = np.where(kept, dx * dy, 0).sum(axis=1) / np.where(kept, dx * dx, 0).sum(axis=1)
        return n, fitted, mean(value) - fitted * mean(pos), np.where(kept, off, 0).max(axis=1)


def axis_fits(labels: DataFrame) -> DataFrame:
    """labels(map_id, axis, seq, pos, value) -> map_id, axis, n_inliers, slope, intercept, worst."""

    def run(batches):
        for batch in batches:
            for rows, (pos, seq, value) in by_size(batch, ["pos", "seq", "value"], lambda n: n * n):
                if pos.shape[1] < 2:
                    continue
                n, *found = fit_axes(pos, seq, value)
                good = n > 0
                at = pa.array(rows[good])
                columns = [batch.column("map_id").take(at), batch.column("axis").take(at), pa.array(n[good], pa.int64()), *(pa.array(f[good], pa.float64()) for f in found)]
                yield pa.RecordBatch.from_arrays(columns, ["map_id", "axis", "n_inliers", "slope", "intercept", "worst"])

    kind = labels.schema["map_id"].dataType.simpleString()
    held = in_rows(labels.withColumns({"pos": F.col("pos").cast("double"), "value": F.col("value").cast("double")}), "pos", "seq", "value")
    return held.mapInArrow(run, f"map_id {kind}, axis string, n_inliers long, slope double, intercept double, worst double")


def find_lattices(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each family (rows by lines, ascending): the best step, nan if there is none, and the lines on its lattice."""
    n, rows = pos.shape[1], np.arange(len(pos))
    pairs = np.triu_indices(n, 1)
    take = lambda x, k: np.take_along_axis(x, k, 1)
    apart = pos[:, None, :] - pos[:, :, None]

    def members(off: np.ndarray, step: np.ndarray) -> np.ndarray:
        k = np.rint(off / step)
        return np.abs(off - k * step) <= np.maximum(2.5, 0.012 * step) + 0.003 * step * np.abs(k)

    best = [np.full((len(pos), 1), v) for v in (1.0, -np.inf, np.inf)]  # less members, step, anchor
    for part in _blocks(len(pairs[0]), pos.size * n):
        step = np.rint((pos[:, pairs[1][part]] - pos[:, pairs[0][part]]) * 10) / 10
        sound = step >= 4
        count = members(apart[:, None], np.where(sound, step, 4.0)[:, :, None, None]).sum(axis=3)
        keys = [np.where(sound[:, :, None], -count, 1.0), np.broadcast_to(-step[:, :, None], count.shape), np.broadcast_to(pos[:, None], count.shape)]
        keys = [k.reshape(len(pos), -1) for k in keys]
        at = _first(keys)
        found = [k[rows, at][:, None] for k in keys]
        first = _first([np.hstack(y) for y in zip(best, found)])[:, None]
        best = [take(np.hstack(x), first) for x in zip(best, found)]
    count, step, anchor = -best[0], -best[1], best[2]
    on = np.ones(pos.shape, bool)
    real = (count[:, 0] >= 3) & (2 * count[:, 0] >= n)
    on[real] = members(pos[real] - anchor[real], step[real])
    return np.where(count[:, 0] > 0, step[:, 0], np.nan), on


def lattices(lines: DataFrame) -> DataFrame:
    """lines(map_id, axis, line_no, pos) -> map_id, axis, line_no, step, on_lattice."""

    def run(batches):
        for batch in batches:
            for rows, (pos, number) in by_size(batch, ["pos", "line_no"], lambda n: n * n):
                step, on = find_lattices(pos)
                at = pa.array(np.repeat(rows, pos.shape[1]))
                steps = np.repeat(step, pos.shape[1])
                columns = [batch.column("map_id").take(at), batch.column("axis").take(at), pa.array(number.ravel(), pa.int64()), pa.array(steps, pa.float64(), mask=np.isnan(steps)), pa.array(on.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["map_id", "axis", "line_no", "step", "on_lattice"])

    kind = lines.schema["map_id"].dataType.simpleString()
    held = in_rows(lines.withColumn("pos", F.col("pos").cast("double")), "pos", "line_no")
    return held.mapInArrow(run, f"map_id {kind}, axis string, line_no long, step double, on_lattice boolean")
