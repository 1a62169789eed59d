"""Rules and reports: coherence checks, status, batch summaries, usage, replay of edits, search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.portable import apply

#: checks: one row for each coherence check of a map; a map without a fit has one failed check.
CHECKS = """
WITH rising AS (
  SELECT map_id, axis, bool_and(CASE WHEN axis = 'x' THEN step > 0 ELSE step < 0 END) AS ok, count(*) AS n
  FROM (SELECT map_id, axis, value - lag(value) OVER (PARTITION BY map_id, axis ORDER BY pos, line_no) AS step FROM {lines} WHERE value IS NOT NULL) s
  WHERE step IS NOT NULL GROUP BY map_id, axis),
rows_ AS (
  SELECT map_id, 'fit' AS name, false AS ok, true AS critical FROM {fits} WHERE n IS NULL
  UNION ALL SELECT map_id, 'control points' AS name, n >= 6 AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL
  UNION ALL SELECT map_id, 'fit error' AS name, rmse <= 2 AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL
  UNION ALL SELECT map_id, 'cross validation' AS name, loo <= 3 AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL AND loo IS NOT NULL
  UNION ALL SELECT map_id, 'orientation' AS name, NOT mirrored AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL
  UNION ALL SELECT map_id, 'rotation' AS name, abs(rotation) < 10 AS ok, false AS critical FROM {fits} WHERE n IS NOT NULL
  UNION ALL SELECT map_id, 'square pixel' AS name, coalesce(abs(pixel_x / nullif(pixel_y, 0) - 1) < 3e-2, false) AS ok, false AS critical FROM {fits} WHERE n IS NOT NULL AND units = 'm'
  UNION ALL SELECT map_id, 'declared scale' AS name, abs((pixel_x + pixel_y) / 2 / (scale * 254e-4 / dpi) - 1) < 5e-2 AS ok, false AS critical
            FROM {fits} WHERE n IS NOT NULL AND units = 'm' AND scale > 0 AND dpi > 0
  UNION ALL SELECT f.map_id, concat('monotonic ', axis) AS name, r.ok AS ok, true AS critical FROM {fits} f JOIN rising r ON f.map_id = r.map_id WHERE f.n IS NOT NULL
  UNION ALL SELECT map_id, 'reference system' AS name, epsg IS NOT NULL AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL
  UNION ALL SELECT map_id, 'area of use' AS name, in_area AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL AND epsg IS NOT NULL
  UNION ALL SELECT map_id, 'system evidence' AS name, confident AS ok, true AS critical FROM {fits} WHERE n IS NOT NULL)
"""
CHECK_ROWS = CHECKS + "SELECT map_id, name, coalesce(ok, false) AS ok, critical FROM rows_"
PASSED = CHECKS + "SELECT map_id, bool_and(coalesce(ok, false) OR NOT critical) AS passed, CAST(sum(CASE WHEN critical AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM rows_ GROUP BY map_id"

#: status: what is proposed stands, but only passed checks sign an ok; without a fit the evidence decides.
STATUS = """
SELECT map_id,
  CASE WHEN NOT has_fit THEN CASE WHEN proposed IN ('no_coordinates', 'failed') THEN proposed WHEN NOT has_text AND proposed IS NULL THEN 'needs_review'
                                  WHEN NOT has_coordinates THEN 'no_coordinates' ELSE 'needs_review' END
       WHEN coalesce(proposed, CASE WHEN passed THEN 'ok' ELSE 'needs_review' END) = 'ok' AND NOT passed THEN 'needs_review'
       ELSE coalesce(proposed, CASE WHEN passed THEN 'ok' ELSE 'needs_review' END) END AS status,
  coalesce(confidence, CASE WHEN NOT has_fit THEN 0e0 WHEN passed THEN 9e-1 WHEN epsg IS NOT NULL THEN 5e-1 ELSE 3e-1 END) AS confidence
FROM {maps}
"""

#: summary: maps and mean error by status; usage: token counters of a run; rollup: an extension over two levels.
SUMMARY = "SELECT status, CAST(count(*) AS BIGINT) AS n_maps, round(avg(rmse), 4) AS rmse, round(max(rmse), 4) AS worst FROM {maps} GROUP BY status"
USAGE = """
SELECT run_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS out_chars,
       CAST(max(turn) AS BIGINT) AS last_turn, max(length(text)) AS longest FROM {events} GROUP BY run_id
"""
ROLLUP = "SELECT kind, source, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY ROLLUP (kind, source)"

#: overrides: the last edit of each line wins; an excluded line loses its value, a set one takes it.
OVERRIDES = """
WITH last_edit AS (
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY map_id, line_no ORDER BY seq DESC) AS place FROM {edits} e) r WHERE place = 1)
SELECT l.map_id, CAST(l.line_no AS BIGINT) AS line_no, CASE WHEN e.action = 'exclude' THEN NULL WHEN e.action = 'set' THEN e.value ELSE l.value END AS value,
       CASE WHEN e.action IS NULL THEN 'fit' ELSE 'edit' END AS source
FROM {lines} l LEFT JOIN last_edit e ON l.map_id = e.map_id AND l.line_no = e.line_no
"""


def check_rows(fits: DataFrame, lines: DataFrame) -> DataFrame:
    """fits(map_id, n, rmse, loo, mirrored, rotation, pixel_x, pixel_y, units, scale, dpi, epsg, in_area, confident),
    lines(map_id, axis, line_no, pos, value) -> checks. An area that could not be judged (null) is a failed check."""
    return apply(CHECK_ROWS, fits=fits, lines=lines)


def passed(fits: DataFrame, lines: DataFrame) -> DataFrame:
    return apply(PASSED, fits=fits, lines=lines)


def status(maps: DataFrame) -> DataFrame:
    """maps(map_id, has_fit, passed, proposed, has_text, has_coordinates, confidence, epsg) -> status and confidence."""
    return apply(STATUS, maps=maps)


def summary(maps: DataFrame) -> DataFrame:
    return apply(SUMMARY, maps=maps)


def usage(events: DataFrame) -> DataFrame:
    return apply(USAGE, events=events)


def rollup(events: DataFrame) -> DataFrame:
    return apply(ROLLUP, events=events)


def overrides(lines: DataFrame, edits: DataFrame) -> DataFrame:
    return apply(OVERRIDES, lines=lines, edits=edits)
