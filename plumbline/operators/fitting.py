"""Fits over the lines and labels of many maps: robust axis fit, spacing, lattice, steps, snapping, affine fit.

Every operator is keyed by map (and axis), so one shuffle by map serves all its joins, windows and sums; a map holds tens
of lines and labels, which bounds the pairs. Distances are pixels, values are world units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.portable import apply
from . import families

#: spacing: median gap between neighbouring lines of a family.
SPACING = """
SELECT map_id, axis, CAST(count(*) AS BIGINT) AS n_lines, round(median(gap), 6) AS spacing
FROM (SELECT map_id, axis, lead(pos) OVER (PARTITION BY map_id, axis ORDER BY pos) - pos AS gap FROM {lines}) g
GROUP BY map_id, axis
"""

#: axis_fit: the pair of labels whose line has most inliers, then least error, then comes first; least squares over
#: those inliers. Pairs at one position or of one value make no line; several labels of one line count each.
AXIS_FIT = """
WITH spaced AS (
  SELECT map_id, axis, median(CASE WHEN gap > 1e-6 THEN gap END) AS spacing
  FROM (SELECT map_id, axis, lead(pos) OVER (PARTITION BY map_id, axis ORDER BY pos) - pos AS gap FROM {labels}) g
  GROUP BY map_id, axis),
pairs AS (
  SELECT a.map_id, a.axis, a.seq AS i, b.seq AS j, (b.value - a.value) / nullif(b.pos - a.pos, 0) AS slope,
         a.value - (b.value - a.value) / nullif(b.pos - a.pos, 0) * a.pos AS intercept, spacing
  FROM {labels} a JOIN {labels} b ON a.map_id = b.map_id AND a.axis = b.axis AND a.seq < b.seq
  JOIN spaced s ON a.map_id = s.map_id AND a.axis = s.axis
  WHERE abs(b.pos - a.pos) >= 1e-6 AND b.value <> a.value),
votes AS (
  SELECT p.map_id, p.axis, i, j, slope, intercept, spacing, count(*) AS n, round(sum(abs(c.value - intercept - slope * c.pos)), 6) AS error
  FROM pairs p JOIN {labels} c ON p.map_id = c.map_id AND p.axis = c.axis
  WHERE abs(c.value - intercept - slope * c.pos) < abs(slope) * 25e-2 * spacing
  GROUP BY p.map_id, p.axis, i, j, slope, intercept, spacing
  HAVING min(RINT[c.pos * 1e1]) <> max(RINT[c.pos * 1e1])),
best AS (
  SELECT * FROM (
    SELECT v.*, row_number() OVER (PARTITION BY map_id, axis ORDER BY n DESC, error, i, j) AS place FROM votes v) r
  WHERE place = 1)
SELECT b.map_id, b.axis, CAST(count(*) AS BIGINT) AS n_inliers, ROUND[regr_slope(c.value, c.pos)|6] AS slope,
       ROUND[regr_intercept(c.value, c.pos)|4] AS intercept, ROUND[max(abs(c.value - b.intercept - b.slope * c.pos))|4] AS worst
FROM best b JOIN {labels} c ON b.map_id = c.map_id AND b.axis = c.axis
WHERE abs(c.value - b.intercept - b.slope * c.pos) < abs(b.slope) * 25e-2 * b.spacing
GROUP BY b.map_id, b.axis
"""

#: lattice: of all steps between two lines and all anchors, the one with most members; the larger step, then the first
#: anchor, wins ties. A lattice of fewer than three lines, or than half of them, is none: all lines count.
LATTICE = """
WITH steps AS (
  SELECT DISTINCT a.map_id, a.axis, RINT[(b.pos - a.pos) * 1e1] / 1e1 AS step
  FROM {lines} a JOIN {lines} b ON a.map_id = b.map_id AND a.axis = b.axis AND a.pos < b.pos
  WHERE RINT[(b.pos - a.pos) * 1e1] / 1e1 >= 4),
tried AS (
  SELECT s.map_id, s.axis, s.step, a.pos AS anchor, c.line_no,
         abs(c.pos - a.pos - RINT[(c.pos - a.pos) / s.step] * s.step)
           <= greatest(25e-1, 12e-3 * s.step) + 3e-3 * s.step * abs(RINT[(c.pos - a.pos) / s.step]) AS member
  FROM steps s JOIN {lines} a ON s.map_id = a.map_id AND s.axis = a.axis
  JOIN {lines} c ON s.map_id = c.map_id AND s.axis = c.axis),
scored AS (
  SELECT map_id, axis, step, anchor, sum(CASE WHEN member THEN 1 ELSE 0 END) AS n, count(*) AS n_lines
  FROM tried GROUP BY map_id, axis, step, anchor),
best AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY map_id, axis ORDER BY n DESC, step DESC, anchor) AS place FROM scored s) r
  WHERE place = 1)
SELECT l.map_id, l.axis, CAST(l.line_no AS BIGINT) AS line_no, round(b.step, 4) AS step,
       CASE WHEN b.n IS NULL OR b.n < 3 OR b.n * 2 < b.n_lines THEN true ELSE t.member END AS on_lattice
FROM {lines} l LEFT JOIN best b ON l.map_id = b.map_id AND l.axis = b.axis
LEFT JOIN tried t ON b.map_id = t.map_id AND b.axis = t.axis AND b.step = t.step AND b.anchor = t.anchor AND t.line_no = l.line_no
"""

#: nice_step: the least gap between distinct known values, taken to the nearest round step if within 8 per cent.
NICE_STEP = """
WITH gaps AS (
  SELECT map_id, axis, value - lag(value) OVER (PARTITION BY map_id, axis ORDER BY value) AS gap
  FROM (SELECT DISTINCT map_id, axis, value FROM {labels} WHERE value IS NOT NULL) v),
raw AS (SELECT map_id, axis, min(gap) AS raw FROM gaps WHERE gap > 1e-9 GROUP BY map_id, axis),
near AS (
  SELECT map_id, axis, raw, factor * power(1e1, floor(log10(raw))) AS step,
         row_number() OVER (PARTITION BY map_id, axis ORDER BY round(abs(ln(factor * power(1e1, floor(log10(raw))) / raw)), 12), factor) AS place
  FROM raw CROSS JOIN (VALUES (1e0), (2e0), (25e-1), (5e0), (1e1)) AS f(factor))
SELECT map_id, axis, ROUND[raw|6] AS raw_step, ROUND[CASE WHEN abs(step - raw) / raw < 8e-2 THEN step ELSE raw END|6] AS step,
       abs(step - raw) / raw < 8e-2 AS is_nice
FROM near WHERE place = 1
"""

#: snap: the value of every line by an axis fit, taken to the nearest multiple of the step if that is close enough.
SNAP = """
WITH predicted AS (
  SELECT l.map_id, l.axis, l.line_no, f.slope, f.intercept + f.slope * l.pos AS guess, s.step,
         RINT[(f.intercept + f.slope * l.pos) / s.step] * s.step AS snapped
  FROM {lines} l JOIN {fits} f ON l.map_id = f.map_id AND l.axis = f.axis
  JOIN {steps} s ON l.map_id = s.map_id AND l.axis = s.axis)
SELECT map_id, axis, CAST(line_no AS BIGINT) AS line_no,
       CASE WHEN abs(guess - snapped) <= abs(slope) * greatest(2e0, 6e-3 * abs(step / slope)) THEN round(snapped, 9) END AS value
FROM predicted WHERE slope <> 0
"""

#: The same with the fits and steps of a map as one row, so that lines stay where their map is.
SNAP_SPARK = """
WITH known AS (
  SELECT map_id, collect_list(struct(f.axis, f.slope, f.intercept, s.step)) AS known FROM {fits} f JOIN {steps} s USING (map_id, axis) WHERE f.slope <> 0 GROUP BY map_id),
met AS (SELECT map_id, axis, line_no, pos, inline(filter(known, k -> k.axis = l.axis)) AS (axis_, slope, intercept, step) FROM {lines} l JOIN known USING (map_id)),
predicted AS (SELECT map_id, axis, line_no, slope, intercept + slope * pos AS guess, step, RINT[(intercept + slope * pos) / step] * step AS snapped FROM met)
SELECT map_id, axis, CAST(line_no AS BIGINT) AS line_no,
       CASE WHEN abs(guess - snapped) <= abs(slope) * greatest(2e0, 6e-3 * abs(step / slope)) THEN round(snapped, 9) END AS value
FROM predicted
"""

#: affine_fit: least squares from centred sums; residuals in world units and pixels.
_COEFFICIENTS = """
sums AS (
  SELECT map_id, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(x) AS wx, avg(y) AS wy,
         var_pop(px) AS uu, var_pop(py) AS vv, covar_pop(px, py) AS uv,
         covar_pop(px, x) AS ux, covar_pop(py, x) AS vx, covar_pop(px, y) AS uy, covar_pop(py, y) AS vy
  FROM {gcps} GROUP BY map_id),
solved AS (
  SELECT s.*, uu * vv - uv * uv AS det, (vv * ux - uv * vx) / (uu * vv - uv * uv) AS a, (uu * vx - uv * ux) / (uu * vv - uv * uv) AS b,
         (vv * uy - uv * vy) / (uu * vv - uv * uv) AS c, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS d
  FROM sums s WHERE n >= 4 AND uu * vv - uv * uv > 1e-6 * uu * vv)
"""
AFFINE_FIT = f"""
WITH {_COEFFICIENTS},
residual AS (
  SELECT g.map_id, s.n, a, b, c, d, wx - a * mx - b * my AS e, wy - c * mx - d * my AS f,
         x - wx - a * (px - mx) - b * (py - my) AS rx, y - wy - c * (px - mx) - d * (py - my) AS ry
  FROM {{gcps}} g JOIN solved s ON g.map_id = s.map_id)
SELECT map_id, CAST(max(n) AS BIGINT) AS n, ROUND[max(a)|6] AS a, ROUND[max(b)|6] AS b, ROUND[max(c)|6] AS c, ROUND[max(d)|6] AS d,
       ROUND[sqrt(avg(rx * rx + ry * ry))|5] AS rmse, ROUND[max(sqrt(rx * rx + ry * ry))|5] AS worst,
       ROUND[sqrt(max(a) * max(a) + max(b) * max(b))|6] AS pixel_x, ROUND[sqrt(max(c) * max(c) + max(d) * max(d))|6] AS pixel_y,
       max(a) * max(d) - max(b) * max(c) > 0 AS mirrored
FROM residual GROUP BY map_id
"""

#: affine_loo: each point left out in turn, in closed form: the residual grows by 1 / (1 - h) and the inverse changes by
#: one rank.
AFFINE_LOO = f"""
WITH {_COEFFICIENTS},
hat AS (
  SELECT g.map_id, s.n, x - wx - a * (px - mx) - b * (py - my) AS rx, y - wy - c * (px - mx) - d * (py - my) AS ry,
         1e0 / s.n + (vv * (px - mx) * (px - mx) - 2 * uv * (px - mx) * (py - my) + uu * (py - my) * (py - my)) / (det * s.n) AS h
  FROM {{gcps}} g JOIN solved s ON g.map_id = s.map_id)
SELECT map_id, CAST(count(*) AS BIGINT) AS n_used, ROUND[sqrt(avg((rx * rx + ry * ry) / ((1 - h) * (1 - h))))|2] AS loo_rmse
FROM hat WHERE h < 1 - 1e-9 GROUP BY map_id
"""

#: gcp_outliers: points whose residual exceeds 1.5 and three times the map's median.
OUTLIERS = f"""
WITH {_COEFFICIENTS},
residual AS (
  SELECT g.map_id, g.gcp_id, sqrt(power(x - wx - a * (px - mx) - b * (py - my), 2) + power(y - wy - c * (px - mx) - d * (py - my), 2)) AS r
  FROM {{gcps}} g JOIN solved s ON g.map_id = s.map_id),
middle AS (SELECT map_id, median(r) AS m FROM residual GROUP BY map_id)
SELECT r.map_id, r.gcp_id, round(r.r, 4) AS residual FROM residual r JOIN middle m ON r.map_id = m.map_id WHERE r.r > greatest(15e-1, 3 * m.m)
"""

#: inconsistent_lines: one round of dropping the line whose residuals share a sign and stand off from all others'.
INCONSISTENT = """
WITH each AS (
  SELECT l.map_id, l.line_no, r.residual, CASE WHEN r.line_no = l.line_no THEN 1 ELSE 0 END AS own
  FROM (SELECT DISTINCT map_id, line_no FROM {residuals}) l JOIN {residuals} r ON l.map_id = r.map_id),
middle AS (
  SELECT map_id, line_no, median(CASE WHEN own = 1 THEN residual END) AS offset_, median(CASE WHEN own = 0 THEN residual END) AS rest,
         sum(own) AS mine, sum(1 - own) AS others, min(CASE WHEN own = 1 THEN sign(residual) END) AS least, max(CASE WHEN own = 1 THEN sign(residual) END) AS most
  FROM each GROUP BY map_id, line_no),
spread AS (
  SELECT e.map_id, e.line_no, 14826e-4 * median(abs(e.residual - m.rest)) AS mad
  FROM each e JOIN middle m ON e.map_id = m.map_id AND e.line_no = m.line_no WHERE own = 0 GROUP BY e.map_id, e.line_no),
picked AS (
  SELECT m.map_id, m.line_no, offset_, mad, row_number() OVER (PARTITION BY m.map_id ORDER BY round(abs(offset_), 9) DESC, m.line_no) AS place
  FROM middle m JOIN spread s ON m.map_id = s.map_id AND m.line_no = s.line_no
  WHERE mine >= 2 AND others >= 4 AND least = most AND abs(offset_) > greatest(15e-1, 4 * mad))
SELECT map_id, CAST(line_no AS BIGINT) AS line_no, round(offset_, 5) AS offset_, round(mad, 5) AS mad FROM picked WHERE place = 1
"""

#: The same inside a map's row, which holds its residuals. _MIDDLE is the median of a sorted array.
_MIDDLE = "(5e-1 * get({0}, (size({0}) - 1) div 2) + 5e-1 * get({0}, size({0}) div 2))".format
INCONSISTENT_SPARK = f"""
WITH sheet AS (SELECT map_id, collect_list(struct(line_no, residual)) AS residuals FROM {{residuals}} WHERE map_id IS NOT NULL GROUP BY map_id),
each AS (
  SELECT map_id, residuals, inline_outer(transform(array_distinct(filter(residuals.line_no, k -> k IS NOT NULL)), k -> named_struct('line_no', k,
           'own', array_sort(transform(filter(residuals, r -> r.line_no = k AND r.residual IS NOT NULL), r -> r.residual)),
           'other', array_sort(transform(filter(residuals, r -> NOT r.line_no <=> k AND r.residual IS NOT NULL), r -> r.residual)),
           'mine', size(filter(residuals, r -> r.line_no = k)))))
  FROM sheet),
likely AS (
  SELECT map_id, line_no, {_MIDDLE("own")} AS offset_, {_MIDDLE("other")} AS rest, other FROM each
  WHERE mine >= 2 AND size(residuals) - mine >= 4 AND sign(get(own, 0)) = sign(get(own, size(own) - 1))),
away AS (SELECT map_id, line_no, offset_, array_sort(transform(other, r -> abs(r - rest))) AS away FROM likely),
spread AS (SELECT map_id, line_no, offset_, 14826e-4 * {_MIDDLE("away")} AS mad FROM away),
picked AS (
  SELECT map_id, min(struct(-round(abs(offset_), 9) AS less, line_no, offset_, mad)) AS p FROM spread WHERE abs(offset_) > greatest(15e-1, 4 * mad) GROUP BY map_id)
SELECT map_id, CAST(p.line_no AS BIGINT) AS line_no, round(p.offset_, 5) AS offset_, round(p.mad, 5) AS mad FROM picked
"""

#: trimmed_line: a least-squares line over the points kept so far, then the points within max(1, 2.5 MAD) of it are kept;
#: four rounds, of which those after the last change change nothing. A round that would keep fewer than two points keeps what
#: there was; without two points more than 1 apart the line of the round before stays, at first the level median. All
#: windows share one partition by group, so one shuffle and one sort serve every round.
def trimmed_text(rounds: int = 4) -> str:
    steps, over = ["start AS (SELECT group_id, t, v, true AS keep, 0e0 AS m, median(v) OVER (PARTITION BY group_id) AS q FROM {points})"], "OVER (PARTITION BY group_id)"
    before = "start"
    for k in range(1, rounds + 1):
        kept = "CASE WHEN keep THEN {} END".format
        fits = f"count({kept('t')}) {over} >= 2 AND max({kept('t')}) {over} - min({kept('t')}) {over} > 1"
        steps += [
            f"""line{k} AS (
  SELECT group_id, t, v, keep, CASE WHEN {fits} THEN regr_slope({kept("v")}, {kept("t")}) {over} ELSE m END AS m,
         CASE WHEN {fits} THEN regr_intercept({kept("v")}, {kept("t")}) {over} ELSE q END AS q FROM {before})""",
            f"off{k} AS (SELECT *, round(v - m * t - q, 9) AS r FROM line{k})",
            f"mid{k} AS (SELECT *, median({kept('r')}) {over} AS center FROM off{k})",
            f"near{k} AS (SELECT *, abs(r) <= greatest(1e0, 25e-1 * 14826e-4 * median({kept('abs(r - center)')}) {over}) AS near FROM mid{k})",
            f"round{k} AS (SELECT group_id, t, v, m, q, CASE WHEN count(CASE WHEN near THEN 1 END) {over} >= 2 THEN near ELSE keep END AS keep FROM near{k})",
        ]
        before = f"round{k}"
    return f"""WITH {", ".join(steps)}
SELECT group_id, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, round(max(m), 6) AS slope, round(max(q), 4) AS intercept FROM {before} GROUP BY group_id
"""


#: model_choice: affine; projective from 8 points if leaving one out errs over 1 and the new error is below 0.6 of the
#: old; then quadratic from 20 points if what was picked still errs over 1.5 and the new error is below half of that. Too
#: few points or a small enough error end the search; a kind that is not better does not.
MODEL_CHOICE = """
WITH first_ AS (SELECT map_id, n, loo_affine, loo_projective, loo_poly2, coalesce(n >= 8 AND loo_affine > 1, false) AS tried FROM {errors}),
second_ AS (SELECT f.*, tried AND coalesce(loo_projective < 6e-1 * loo_affine, false) AS better FROM first_ f),
third_ AS (SELECT s.*, CASE WHEN better THEN loo_projective ELSE loo_affine END AS base FROM second_ s)
SELECT map_id, CASE WHEN tried AND n >= 20 AND base > 15e-1 AND coalesce(loo_poly2 < 5e-1 * base, false) THEN 'poly2'
                    WHEN better THEN 'projective' ELSE 'affine' END AS kind
FROM third_
"""


def line_spacing(lines: DataFrame) -> DataFrame:
    """lines(map_id, axis, pos) -> n_lines and spacing of each family; spacing is null for a single line."""
    return apply(SPACING, lines=lines)


def axis_fit(labels: DataFrame, rounded: bool = False) -> DataFrame:
    """labels(map_id, axis, seq, pos, value) -> robust slope and intercept of each axis."""
    found = families.axis_fits(labels)
    return found.withColumns({c: F.round(c, 6 if c == "slope" else 4) for c in ("slope", "intercept", "worst")}) if rounded else found


def lattice_flags(lines: DataFrame) -> DataFrame:
    """lines(map_id, axis, line_no, pos) -> whether each line lies on its family's lattice, and the step."""
    return families.lattices(lines).withColumn("step", F.round("step", 4))


def nice_step(labels: DataFrame, rounded: bool = False) -> DataFrame:
    """labels(map_id, axis, value) -> grid step of each axis."""
    return apply(NICE_STEP, rounded, labels=labels)


def snap_values(lines: DataFrame, fits: DataFrame, steps: DataFrame) -> DataFrame:
    """lines, fits(slope, intercept), steps(step), all by map_id and axis -> value of every line, null if none is near."""
    return apply(SNAP_SPARK, lines=lines, fits=fits, steps=steps)


def affine_fit(gcps: DataFrame, rounded: bool = False) -> DataFrame:
    """gcps(map_id, gcp_id, px, py, x, y) -> affine coefficients and errors; maps without four points in general place go."""
    return apply(AFFINE_FIT, rounded, gcps=gcps)


def affine_loo(gcps: DataFrame, rounded: bool = False) -> DataFrame:
    """gcps -> leave-one-out error of the affine fit."""
    return apply(AFFINE_LOO, rounded, gcps=gcps)


def gcp_outliers(gcps: DataFrame) -> DataFrame:
    return apply(OUTLIERS, gcps=gcps)


def inconsistent_lines(residuals: DataFrame) -> DataFrame:
    """residuals(map_id, line_no, residual) -> at most one line of each map to drop."""
    return apply(INCONSISTENT_SPARK, residuals=residuals)


def trimmed_line(points: DataFrame) -> DataFrame:
    """points(group_id, t, v) -> trimmed least-squares line."""
    return apply(trimmed_text(), points=points)


def model_choice(errors: DataFrame) -> DataFrame:
    """errors(map_id, n, loo_affine, loo_projective, loo_poly2) -> kind of transformation."""
    return apply(MODEL_CHOICE, errors=errors)
