"""Matching and grouping of printed evidence: labels to lines, crossings, clusters, phrases, duplicates, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.portable import apply

#: nearest_line: each label takes the nearest line of its family within 0.3 spacings; the first line wins ties.
NEAREST = """
WITH spaced AS (
  SELECT map_id, axis, median(gap) AS spacing
  FROM (SELECT map_id, axis, lead(pos) OVER (PARTITION BY map_id, axis ORDER BY pos) - pos AS gap FROM {lines}) g
  GROUP BY map_id, axis),
near AS (
  SELECT b.map_id, b.axis, b.seq, l.line_no, abs(b.pos - l.pos) AS distance,
         row_number() OVER (PARTITION BY b.map_id, b.axis, b.seq ORDER BY round(abs(b.pos - l.pos), 9), l.pos, l.line_no) AS place
  FROM {labels} b JOIN {lines} l ON b.map_id = l.map_id AND b.axis = l.axis)
SELECT n.map_id, n.axis, CAST(n.seq AS BIGINT) AS seq, CAST(CASE WHEN distance <= 3e-1 * spacing THEN line_no END AS BIGINT) AS line_no,
       round(distance, 6) AS distance
FROM near n JOIN spaced s ON n.map_id = s.map_id AND n.axis = s.axis WHERE place = 1
"""

#: The same inside a map's row, which holds its labels and lines: no row of a pair is shuffled or sorted. Outer generators keep
#: Spark from adding a filter that computes the array again.
NEAREST_SPARK = """
WITH sheet AS (SELECT map_id, collect_list(struct(axis, pos, line_no)) AS lines FROM {lines} WHERE map_id IS NOT NULL GROUP BY map_id),
printed AS (SELECT map_id, collect_list(struct(axis, seq, pos)) AS labels FROM {labels} WHERE map_id IS NOT NULL GROUP BY map_id),
families AS (
  SELECT map_id, labels, transform(array_distinct(lines.axis), a -> named_struct('axis', a, 'lines', filter(lines, l -> l.axis = a),
           'pos', array_sort(transform(filter(lines, l -> l.axis = a AND l.pos IS NOT NULL), l -> l.pos)))) AS families
  FROM printed JOIN sheet USING (map_id)),
spaced AS (
  SELECT map_id, labels, transform(families, f -> named_struct('axis', f.axis, 'lines', f.lines,
           'gaps', array_sort(zip_with(slice(f.pos, 2, size(f.pos)), slice(f.pos, 1, greatest(size(f.pos) - 1, 0)), (b, a) -> b - a)))) AS families
  FROM families),
tried AS (
  SELECT map_id, inline_outer(flatten(transform(families, f -> transform(filter(labels, b -> b.axis = f.axis), b -> named_struct('axis', f.axis, 'seq', b.seq,
           'spacing', 5e-1 * get(f.gaps, (size(f.gaps) - 1) div 2) + 5e-1 * get(f.gaps, size(f.gaps) div 2),
           'best', array_min(transform(f.lines, l -> struct(coalesce(round(abs(b.pos - l.pos), 9), double('inf')) AS near, l.pos AS pos, l.line_no AS line_no, abs(b.pos - l.pos) AS distance)))))))) FROM spaced),
kept AS (SELECT map_id, axis, seq, min(struct(best, spacing)) AS m FROM tried WHERE axis IS NOT NULL GROUP BY map_id, axis, seq)
SELECT map_id, axis, CAST(seq AS BIGINT) AS seq, CAST(CASE WHEN m.best.distance <= 3e-1 * m.spacing THEN m.best.line_no END AS BIGINT) AS line_no,
       round(m.best.distance, 6) AS distance
FROM kept
"""

#: crossings: control points where valued lines of the two families meet, inside the image and the widened frame.
CROSSINGS = """
WITH upright AS (SELECT map_id, line_no, a, b, c, value FROM {lines} WHERE axis = 'x' AND value IS NOT NULL),
level_ AS (SELECT map_id, line_no, a, b, c, value FROM {lines} WHERE axis = 'y' AND value IS NOT NULL),
met AS (
  SELECT v.map_id, v.line_no AS v_no, h.line_no AS h_no, v.value AS x, h.value AS y, v.a * h.b - h.a * v.b AS det,
         (v.b * h.c - h.b * v.c) AS nx, (h.a * v.c - v.a * h.c) AS ny
  FROM upright v JOIN level_ h ON v.map_id = h.map_id),
placed AS (SELECT map_id, v_no, h_no, x, y, nx / det AS px, ny / det AS py FROM met WHERE abs(det) >= 1e-9)
SELECT m.map_id, concat('V', CAST(v_no AS STRING), 'H', CAST(h_no AS STRING)) AS gcp_id, round(px, 5) AS px, round(py, 5) AS py, round(x, 9) AS x, round(y, 9) AS y
FROM placed m JOIN {maps} p ON m.map_id = p.map_id
WHERE px >= 0 AND px < width AND py >= 0 AND py < height
  AND px BETWEEN x0 - 2e-2 * greatest(width, height) AND x1 + 2e-2 * greatest(width, height)
  AND py BETWEEN y0 - 2e-2 * greatest(width, height) AND y1 + 2e-2 * greatest(width, height)
"""

#: islands: a new cluster where the gap to the previous member exceeds the tolerance; small clusters go.
ISLANDS = """
WITH steps AS (
  SELECT group_id, v, CASE WHEN v - lag(v) OVER (PARTITION BY group_id ORDER BY v) <= {tolerance_} THEN 0 ELSE 1 END AS starts FROM {points}),
numbered AS (SELECT group_id, v, sum(starts) OVER (PARTITION BY group_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM steps),
sized AS (SELECT group_id, cluster, count(*) AS n, avg(v) AS center, min(v) AS low, max(v) AS high FROM numbered GROUP BY group_id, cluster),
middle AS (SELECT group_id, median(n) AS m FROM sized GROUP BY group_id)
SELECT s.group_id, CAST(s.cluster AS BIGINT) AS cluster, CAST(n AS BIGINT) AS n, round(center + 1e-7, 5) AS center, round(low, 5) AS low, round(high, 5) AS high
FROM sized s JOIN middle m ON s.group_id = m.group_id WHERE n >= 2 AND n >= floor(4e-1 * m)
"""

#: phrases: tokens of one row join while the gap is below 0.9 heights; below 0.12 heights without a space.
PHRASES = """
WITH gaps AS (
  SELECT map_id, row_no, seq, text, x0, x1, height,
         (x0 - lag(x1) OVER (PARTITION BY map_id, row_no ORDER BY x0, seq)) / greatest(height, lag(height) OVER (PARTITION BY map_id, row_no ORDER BY x0, seq)) AS gap
  FROM {tokens}),
numbered AS (
  SELECT g.*, sum(CASE WHEN gap < 9e-1 THEN 0 ELSE 1 END) OVER (PARTITION BY map_id, row_no ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phrase
  FROM gaps g)
"""
PHRASES_SPARK = (
    PHRASES
    + """
SELECT map_id, CAST(row_no AS BIGINT) AS row_no, CAST(phrase AS BIGINT) AS phrase, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1, CAST(count(*) AS BIGINT) AS n_tokens,
       array_join(transform(array_sort(collect_list(struct(x0, seq, CASE WHEN gap >= 12e-2 AND gap < 9e-1 THEN concat(' ', text) ELSE text END AS piece))), p -> p.piece), '') AS text
FROM numbered GROUP BY map_id, row_no, phrase
"""
)
PHRASES_SECOND = (
    PHRASES
    + """
SELECT map_id, CAST(row_no AS BIGINT) AS row_no, CAST(phrase AS BIGINT) AS phrase, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1, CAST(count(*) AS BIGINT) AS n_tokens,
       string_agg(CASE WHEN gap >= 12e-2 AND gap < 9e-1 THEN concat(' ', text) ELSE text END, '' ORDER BY x0, seq) AS text
FROM numbered GROUP BY map_id, row_no, phrase
"""
)

#: box_duplicates: readings come in order of seq; one that overlaps a kept box by more than half of their union is the first
#: such box read again, and takes its place if it is better (confidence, then length of text). Blank texts go. The fold runs
#: inside the map's row, which holds hundreds of boxes.
_OVER = "greatest(0e0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0e0, least(k.y1, b.y1) - greatest(k.y0, b.y0))"
_BOTH = "(k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)"
DUPLICATES = f"""
WITH sheets AS (
  SELECT map_id, array_sort(collect_list(struct(seq, text, conf, x0, y0, x1, y1))) AS boxes FROM {{boxes}} WHERE trim(text) <> '' GROUP BY map_id),
folded AS (
  SELECT map_id, explode(aggregate(boxes, filter(boxes, b -> false), (kept, b) ->
    transform(array(array_position(transform(kept, k -> {_OVER} > 5e-1 * ({_BOTH} - {_OVER})), true)), hit ->
      CASE WHEN hit = 0 THEN concat(kept, array(b))
           WHEN b.conf > kept[CAST(hit AS INT) - 1].conf OR b.conf = kept[CAST(hit AS INT) - 1].conf AND length(b.text) > length(kept[CAST(hit AS INT) - 1].text)
             THEN concat(slice(kept, 1, CAST(hit AS INT) - 1), array(b), slice(kept, CAST(hit AS INT) + 1, size(kept)))
           ELSE kept END)[0])) AS b
  FROM sheets)
SELECT map_id, CAST(b.seq AS BIGINT) AS seq, b.text AS text, round(b.conf, 4) AS conf FROM folded
"""

#: frame: medians of the ends of the lattice lines of both families; null below ten pixels.
FRAME = """
WITH ends AS (
  SELECT map_id, median(CASE WHEN axis = 'y' THEN low END) AS x0, median(CASE WHEN axis = 'y' THEN high END) AS x1,
         median(CASE WHEN axis = 'x' THEN low END) AS y0, median(CASE WHEN axis = 'x' THEN high END) AS y1,
         min(CASE WHEN axis = 'x' THEN pos END) AS vx0, max(CASE WHEN axis = 'x' THEN pos END) AS vx1,
         min(CASE WHEN axis = 'y' THEN pos END) AS hy0, max(CASE WHEN axis = 'y' THEN pos END) AS hy1
  FROM {lines} GROUP BY map_id),
filled AS (SELECT map_id, coalesce(x0, vx0) AS x0, coalesce(x1, vx1) AS x1, coalesce(y0, hy0) AS y0, coalesce(y1, hy1) AS y1 FROM ends)
SELECT map_id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM filled WHERE x1 - x0 >= 10 AND y1 - y0 >= 10
"""

#: side: corner outside both axes, else the side a box lies outside of, else the nearest edge within its 4 per cent band.
SIDE = """
WITH ratios AS (
  SELECT b.map_id, b.seq, cx < x0 OR cx > x1 AS out_x, cy < y0 OR cy > y1 AS out_y, cx < x0 AS left_, cy < y0 AS top_,
         (cy - y0) / (4e-2 * (y1 - y0)) AS t, (y1 - cy) / (4e-2 * (y1 - y0)) AS b, (cx - x0) / (4e-2 * (x1 - x0)) AS l, (x1 - cx) / (4e-2 * (x1 - x0)) AS r
  FROM {boxes} b JOIN {frames} f ON b.map_id = f.map_id)
SELECT map_id, CAST(seq AS BIGINT) AS seq,
       CASE WHEN out_x AND out_y THEN 'corner' WHEN out_y THEN CASE WHEN top_ THEN 'top' ELSE 'bottom' END WHEN out_x THEN CASE WHEN left_ THEN 'left' ELSE 'right' END
            WHEN least(t, b, l, r) > 1 THEN 'inside' WHEN t <= least(b, l, r) THEN 'top' WHEN b <= least(l, r) THEN 'bottom' WHEN l <= r THEN 'left' ELSE 'right' END AS side
FROM ratios
"""

#: reading_order: rows of twenty pixels, then left to right, at most `most` items of a map.
READING = """
WITH placed AS (
  SELECT map_id, seq, text, row_number() OVER (PARTITION BY map_id ORDER BY RINT[cy / 2e1], cx, seq) AS place FROM {boxes})
SELECT map_id, CAST(place AS BIGINT) AS place, CAST(seq AS BIGINT) AS seq, text FROM placed WHERE place <= MOST
"""

#: profile_peaks: local maxima of a moving sum of three that reach the least height, and the group's spread.
PEAKS = """
WITH summed AS (
  SELECT group_id, t, sum(v) OVER (PARTITION BY group_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM {points}),
around AS (
  SELECT group_id, t, s, lag(s) OVER (PARTITION BY group_id ORDER BY t) AS before_, lead(s) OVER (PARTITION BY group_id ORDER BY t) AS after_ FROM summed),
height AS (SELECT group_id, avg(s) + stddev_pop(s) AS least_ FROM summed GROUP BY group_id)
SELECT a.group_id, CAST(t AS BIGINT) AS t, round(s, 5) AS height FROM around a JOIN height h ON a.group_id = h.group_id WHERE s > before_ AND s > after_ AND s >= least_
"""

#: ridge_center: depth below the 85th percentile, and the centroid of what exceeds 0.4 of the deepest.
RIDGE_SPARK = """
WITH base AS (SELECT group_id, percentile(v, 85e-2) AS p FROM {points} GROUP BY group_id),
depth AS (SELECT p.group_id, t, b.p - v AS d FROM {points} p JOIN base b ON p.group_id = b.group_id),
top AS (SELECT group_id, max(d) AS deepest FROM depth GROUP BY group_id)
SELECT d.group_id, round(max(deepest), 5) AS contrast, round(sum(t * d) / sum(d), 5) AS center
FROM depth d JOIN top m ON d.group_id = m.group_id WHERE deepest > 0 AND d > 4e-1 * deepest GROUP BY d.group_id
"""
RIDGE_SECOND = RIDGE_SPARK.replace("percentile(v, 85e-2)", "quantile_cont(v, 0.85)")

#: tick_lines: a tick on one side of the frame and the nearest on the other, measured from the frame's corner on each side,
#: make a line; a tick of the far side may serve twice.
TICKS = """
WITH pairs AS (
  SELECT a.map_id, CASE WHEN a.side = 'top' THEN 'x' ELSE 'y' END AS axis, a.pos AS here, b.pos AS there,
         CASE WHEN a.side = 'top' THEN y0 ELSE x0 END AS low, CASE WHEN a.side = 'top' THEN y1 ELSE x1 END AS high,
         row_number() OVER (PARTITION BY a.map_id, a.side, a.pos ORDER BY round(abs((b.pos - b.origin) - (a.pos - a.origin)), 9), b.pos) AS place,
         abs((b.pos - b.origin) - (a.pos - a.origin)) AS off, greatest(4e0, 4e-3 * CASE WHEN a.side = 'top' THEN x1 - x0 ELSE y1 - y0 END) AS limit_
  FROM {ticks} a JOIN {ticks} b ON a.map_id = b.map_id AND (a.side = 'top' AND b.side = 'bottom' OR a.side = 'left' AND b.side = 'right')
  JOIN {frames} f ON a.map_id = f.map_id WHERE y1 > y0 AND x1 > x0)
SELECT map_id, axis, CAST(row_number() OVER (PARTITION BY map_id, axis ORDER BY here) AS BIGINT) AS line_no,
       round((there - here) / (high - low), 8) AS slope, round(here - (there - here) / (high - low) * low, 5) AS intercept
FROM pairs WHERE place = 1 AND off <= limit_
"""
#: The same inside a map's row, which holds its ticks: each takes the least of the other side by distance and place; of ticks at one place the first stays.
TICKS_SPARK = """
WITH sides AS (
  SELECT map_id, collect_list(CASE WHEN side = 'top' THEN struct(pos, origin) END) AS top, collect_list(CASE WHEN side = 'bottom' THEN struct(pos, origin) END) AS bottom,
         collect_list(CASE WHEN side = 'left' THEN struct(pos, origin) END) AS left_, collect_list(CASE WHEN side = 'right' THEN struct(pos, origin) END) AS right_
  FROM {ticks} WHERE map_id IS NOT NULL AND pos IS NOT NULL AND origin IS NOT NULL GROUP BY map_id),
families AS (
  SELECT map_id, inline(array(
    named_struct('axis', 'x', 'near', top, 'far', bottom, 'low', y0, 'high', y1, 'limit_', greatest(4e0, 4e-3 * (x1 - x0))),
    named_struct('axis', 'y', 'near', left_, 'far', right_, 'low', x0, 'high', x1, 'limit_', greatest(4e0, 4e-3 * (y1 - y0)))))
  FROM sides JOIN {frames} USING (map_id) WHERE y1 > y0 AND x1 > x0),
best AS (
  SELECT map_id, axis, low, high, limit_, array_sort(transform(near, a -> struct(a.pos AS here, array_min(transform(far, b -> struct(
           round(abs((b.pos - b.origin) - (a.pos - a.origin)), 9) AS gap, b.pos AS there, abs((b.pos - b.origin) - (a.pos - a.origin)) AS off))) AS best))) AS ticks
  FROM families),
numbered AS (
  SELECT map_id, axis, low, high, aggregate(ticks, slice(ticks, 1, 1), (kept, p) -> CASE WHEN element_at(kept, -1).here = p.here THEN kept ELSE concat(kept, array(p)) END,
           kept -> filter(kept, p -> p.best.off <= limit_)) AS kept
  FROM best)
SELECT map_id, axis, CAST(place + 1 AS BIGINT) AS line_no,
       round((p.best.there - p.here) / (high - low), 8) AS slope, round(p.here - (p.best.there - p.here) / (high - low) * low, 5) AS intercept
FROM numbered LATERAL VIEW OUTER posexplode(kept) e AS place, p WHERE place IS NOT NULL
"""


def tick_lines(ticks: DataFrame, frames: DataFrame) -> DataFrame:
    """ticks(map_id, side, pos, origin) on the four sides of frames(map_id, x0, y0, x1, y1) -> lines as detect_lines gives."""
    return apply(TICKS_SPARK, ticks=ticks, frames=frames)


def nearest_line(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """labels(map_id, axis, seq, pos), lines(map_id, axis, line_no, pos) -> each label's line, null if none is near."""
    return apply(NEAREST_SPARK, labels=labels, lines=lines)


def crossings(lines: DataFrame, maps: DataFrame) -> DataFrame:
    """lines(map_id, axis, line_no, a, b, c, value), maps(map_id, width, height, x0, y0, x1, y1) -> control points."""
    return apply(CROSSINGS, lines=lines, maps=maps)


def islands(points: DataFrame, tolerance: float) -> DataFrame:
    """points(group_id, v) -> clusters."""
    return apply(ISLANDS.replace("{tolerance_}", repr(float(tolerance)) + "D"), points=points)


def phrases(tokens: DataFrame) -> DataFrame:
    """tokens(map_id, row_no, seq, text, x0, x1, height) -> joined phrases of each row."""
    return apply(PHRASES_SPARK, tokens=tokens)


def box_duplicates(boxes: DataFrame) -> DataFrame:
    """boxes(map_id, seq, text, x0, y0, x1, y1, conf) -> the boxes that stay, as if they were read one by one."""
    return apply(DUPLICATES, boxes=boxes)


def frame_of_lines(lines: DataFrame) -> DataFrame:
    """lines(map_id, axis, pos, low, high) -> frame of each map."""
    return apply(FRAME, lines=lines)


def side_of_frame(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    return apply(SIDE, boxes=boxes, frames=frames)


def reading_order(boxes: DataFrame, most: int = 60) -> DataFrame:
    """boxes(map_id, seq, text, cx, cy) -> the first `most` items of each map as they are read."""
    return apply(READING.replace("MOST", str(most)), boxes=boxes)


def profile_peaks(points: DataFrame) -> DataFrame:
    return apply(PEAKS, points=points)


def ridge_center(points: DataFrame) -> DataFrame:
    return apply(RIDGE_SPARK, points=points)
