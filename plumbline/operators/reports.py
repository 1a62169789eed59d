"""What a reader of a map's state gets: summaries, capped lists, searches by kind, set operations over readings, decoded
responses, flat rows. Lists are capped by place within their map, so that every map keeps its own first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as reading
from ..plans.portable import apply

#: Caps of the lists that a reader gets: items searched, items found, labels, control points, worst points, readings of a region.
SEARCHED, FOUND, LABELS, POINTS, WORST, REGION = 400, 60, 100, 80, 6, 80
#: Characters of a traced result.
TRACED = 4000
# The columns of the batch's flat summary, each with its path in a map's document.
SUMMARY_COLUMNS = {
    "map": "$.map", "status": "$.status", "confidence": "$.confidence", "epsg": "$.crs.epsg", "crs": "$.crs.name", "n_gcps": "$.transform.n_gcps", "rmse_px": "$.transform.rmse_px", "rmse_m": "$.transform.rmse_m",
    "fit": "$.transform.kind", "agent_turns": "$.agent.turns", "input_tokens": "$.agent.usage.input_tokens", "output_tokens": "$.agent.usage.output_tokens",
    "cache_read_tokens": "$.agent.usage.cache_read_input_tokens", "seconds": "$.seconds", "trace_url": "$.trace.url", "notes": "$.notes",
}

#: map_summary: counts of a map's labels by side and state, of its lines, and of its enabled control points.
SUMMARY = """
WITH by_label AS (
  SELECT map_id, count(*) AS n_labels, sum(CASE WHEN side = 'top' THEN 1 ELSE 0 END) AS n_top, sum(CASE WHEN side = 'bottom' THEN 1 ELSE 0 END) AS n_bottom,
         sum(CASE WHEN side = 'left' THEN 1 ELSE 0 END) AS n_left, sum(CASE WHEN side = 'right' THEN 1 ELSE 0 END) AS n_right,
         sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS n_ok, sum(CASE WHEN status = 'outlier' THEN 1 ELSE 0 END) AS n_outliers, sum(CASE WHEN complete THEN 0 ELSE 1 END) AS n_abbreviated
  FROM {labels} GROUP BY map_id),
by_line AS (
  SELECT map_id, sum(CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS n_vertical, sum(CASE WHEN axis = 'y' THEN 1 ELSE 0 END) AS n_horizontal, count(value) AS n_valued FROM {lines} GROUP BY map_id),
by_point AS (SELECT map_id, sum(CASE WHEN enabled THEN 1 ELSE 0 END) AS n_points FROM {gcps} GROUP BY map_id)
SELECT m.map_id, CAST(coalesce(n_labels, 0) AS BIGINT) AS n_labels, CAST(coalesce(n_top, 0) AS BIGINT) AS n_top, CAST(coalesce(n_bottom, 0) AS BIGINT) AS n_bottom,
       CAST(coalesce(n_left, 0) AS BIGINT) AS n_left, CAST(coalesce(n_right, 0) AS BIGINT) AS n_right, CAST(coalesce(n_ok, 0) AS BIGINT) AS n_ok, CAST(coalesce(n_outliers, 0) AS BIGINT) AS n_outliers,
       CAST(coalesce(n_abbreviated, 0) AS BIGINT) AS n_abbreviated, CAST(coalesce(n_vertical, 0) AS BIGINT) AS n_vertical, CAST(coalesce(n_horizontal, 0) AS BIGINT) AS n_horizontal,
       CAST(coalesce(n_valued, 0) AS BIGINT) AS n_valued, CAST(coalesce(n_points, 0) AS BIGINT) AS n_points
FROM {maps} m LEFT JOIN by_label b ON m.map_id = b.map_id LEFT JOIN by_line l ON m.map_id = l.map_id LEFT JOIN by_point p ON m.map_id = p.map_id
"""

#: label_list: the first labels of each map by side and place along it.
LABEL_LIST = """
WITH placed AS (
  SELECT map_id, seq, side, text, row_number() OVER (PARTITION BY map_id ORDER BY side, CASE WHEN side IN ('top', 'bottom') THEN cx ELSE cy END, seq) AS place FROM {labels})
SELECT map_id, CAST(place AS BIGINT) AS place, CAST(seq AS BIGINT) AS seq, side, text FROM placed WHERE place <= MOST
"""

#: worst_points: control points by residual, largest first; the first few are the worst.
WORST_POINTS = """
WITH placed AS (SELECT map_id, gcp_id, residual, row_number() OVER (PARTITION BY map_id ORDER BY residual DESC, gcp_id) AS place FROM {points})
SELECT map_id, gcp_id, round(residual, 4) AS residual, CAST(place AS BIGINT) AS place, place <= WORST AS worst FROM placed WHERE place <= MOST
"""

#: tallest: the middle of the five tallest peaks of each group, which others are measured by.
TALLEST = """
WITH placed AS (SELECT group_id, height, row_number() OVER (PARTITION BY group_id ORDER BY height DESC) AS place FROM {peaks})
SELECT group_id, CAST(count(*) AS BIGINT) AS n, round(median(height), 6) AS usual FROM placed WHERE place <= 5 GROUP BY group_id
"""

#: centroid: the middle of a map's enabled control points; tile_counts: new items by tile, and their running sum.
CENTROID = "SELECT map_id, CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM {gcps} WHERE enabled GROUP BY map_id"
TILE_COUNTS = """
WITH counted AS (SELECT map_id, tile, count(*) AS n_read, sum(CASE WHEN added THEN 1 ELSE 0 END) AS n_added FROM {items} GROUP BY map_id, tile)
SELECT map_id, CAST(tile AS BIGINT) AS tile, CAST(n_read AS BIGINT) AS n_read, CAST(n_added AS BIGINT) AS n_added,
       CAST(sum(n_added) OVER (PARTITION BY map_id ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_so_far
FROM counted
"""

#: full_text: a map's texts in one, by row and column of their centers.
FULL_TEXT_SPARK = "SELECT map_id, array_join(transform(array_sort(collect_list(struct(cy, cx, seq, text))), i -> i.text), ' ') AS text FROM {items} GROUP BY map_id"
FULL_TEXT_SECOND = "SELECT map_id, string_agg(text, ' ' ORDER BY cy, cx, seq) AS text FROM {items} GROUP BY map_id"

#: reading_sets: values of two readings of each map: in both, in the first alone, in either.
READING_SETS = """
WITH a AS (SELECT DISTINCT map_id, value FROM {first} WHERE value IS NOT NULL), b AS (SELECT DISTINCT map_id, value FROM {later} WHERE value IS NOT NULL),
both_ AS (SELECT * FROM a INTERSECT SELECT * FROM b), only_ AS (SELECT * FROM a EXCEPT SELECT * FROM b), either AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT map_id, value, 'both' AS part FROM both_ UNION ALL SELECT map_id, value, 'first' AS part FROM only_ UNION ALL SELECT map_id, value, 'either' AS part FROM either
"""

#: edited_points: points that an edit adds, removes or switches; of a point's edits the last counts.
EDITED_POINTS = """
WITH last_edit AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY map_id, gcp_id ORDER BY seq DESC) AS place FROM {edits} e) r WHERE place = 1)
SELECT g.map_id, g.gcp_id, round(g.px, 4) AS px, round(g.py, 4) AS py, CASE WHEN e.action = 'disable' THEN false WHEN e.action = 'enable' THEN true ELSE g.enabled END AS enabled, 'grid' AS source
FROM {gcps} g LEFT JOIN last_edit e ON g.map_id = e.map_id AND g.gcp_id = e.gcp_id WHERE coalesce(e.action, '') NOT IN ('remove', 'add')
UNION ALL SELECT map_id, gcp_id, round(px, 4) AS px, round(py, 4) AS py, true AS enabled, 'manual' AS source FROM last_edit WHERE action = 'add'
"""

#: upright: whether an affine fit lies along the axes, so that the image need not be resampled; line_names: a map's valued
#: and free lines as short texts.
UPRIGHT = "SELECT map_id, kind = 'affine' AND abs(degrees(atan2(b, a))) < 2e-3 AND abs(degrees(atan2(c, -d))) < 2e-3 AS upright FROM {fits}"
LINE_NAMES = """
SELECT map_id, axis, CAST(line_no AS BIGINT) AS line_no,
       concat(CASE WHEN axis = 'x' THEN 'V' ELSE 'H' END, CAST(line_no AS STRING), '@', CAST(CAST(RINT[pos] AS BIGINT) AS STRING), CASE WHEN value IS NULL THEN '' ELSE concat('=', CAST(CAST(RINT[value] AS BIGINT) AS STRING)) END) AS name
FROM {lines}
"""


def map_summary(maps: DataFrame, labels: DataFrame, lines: DataFrame, gcps: DataFrame) -> DataFrame:
    """maps(map_id), labels(map_id, side, status, complete), lines(map_id, axis, value), gcps(map_id, enabled) -> counts."""
    return apply(SUMMARY, maps=maps, labels=labels, lines=lines, gcps=gcps)


def label_list(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """labels(map_id, seq, side, text, cx, cy) -> at most `most` of each map."""
    return apply(LABEL_LIST.replace("MOST", str(most)), labels=labels)


def worst_points(points: DataFrame, most: int = POINTS, worst: int = WORST) -> DataFrame:
    """points(map_id, gcp_id, residual) -> at most `most` of each map, the `worst` first ones marked."""
    return apply(WORST_POINTS.replace("MOST", str(most)).replace("WORST", str(worst)), points=points)


def tallest(peaks: DataFrame) -> DataFrame:
    return apply(TALLEST, peaks=peaks)


def centroid(gcps: DataFrame) -> DataFrame:
    return apply(CENTROID, gcps=gcps)


def tile_counts(items: DataFrame) -> DataFrame:
    """items(map_id, tile, added) -> items read and added by tile."""
    return apply(TILE_COUNTS, items=items)


def full_text(items: DataFrame) -> DataFrame:
    """items(map_id, seq, text, cx, cy) -> one text for each map, whose items a map bounds."""
    return apply(FULL_TEXT_SPARK, items=items)


def reading_sets(first: DataFrame, later: DataFrame) -> DataFrame:
    """first, later(map_id, value) -> (map_id, value, part)."""
    return apply(READING_SETS, first=first, later=later)


def edited_points(gcps: DataFrame, edits: DataFrame) -> DataFrame:
    """gcps(map_id, gcp_id, px, py, enabled), edits(map_id, gcp_id, seq, action, px, py) -> the points after all edits."""
    return apply(EDITED_POINTS, gcps=gcps, edits=edits)


def upright(fits: DataFrame) -> DataFrame:
    """fits(map_id, kind, a, b, c, d) -> whether each may go out unresampled."""
    return apply(UPRIGHT, fits=fits)


def line_names(lines: DataFrame) -> DataFrame:
    return apply(LINE_NAMES, lines=lines)


def tells(text: Column, kind: str) -> Column:
    """Whether a text tells something of a kind: utm, geo, datum, zone or scale."""
    if kind in ("utm", "geo"):
        return F.exists(reading.parse_candidates(text), lambda c: c["kind"] == kind)
    return {"datum": reading.find_datum, "zone": reading.find_zone, "scale": reading.find_scale}[kind](text).isNotNull()


def search_kind(items: DataFrame, kind: str, searched: int = SEARCHED, found: int = FOUND) -> DataFrame:
    """items(map_id, place, text), place in reading order -> the first `found` of each map's first `searched` items that tell
    something of the kind, with how many there are."""
    from pyspark.sql import Window

    near = items.filter(F.col("place") <= searched).filter(tells(F.col("text"), kind))
    of_map = Window.partitionBy("map_id")
    ranked = near.withColumn("total", F.count("*").over(of_map)).withColumn("rank_", F.row_number().over(of_map.orderBy("place")))
    return ranked.filter(F.col("rank_") <= found).select("map_id", F.col("place").cast("long"), "text", F.col("total").cast("long"))


def flat_rows(documents: DataFrame) -> DataFrame:
    """documents(document, a map's JSON) -> the flat summary, all columns as text; null where the document has no such part;
    notes are joined by bars."""
    notes = F.from_json(F.get_json_object("document", "$.notes"), "array<string>")
    value = lambda c, path: F.concat_ws(" | ", F.coalesce(notes, F.array().cast("array<string>"))) if c == "notes" else F.get_json_object("document", path)
    return documents.select(*(value(c, path).alias(c) for c, path in SUMMARY_COLUMNS.items()))


_TOKEN = "struct<text:string,pages:array<struct<width:double,height:double,tokens:array<struct<segments:array<struct<start:int,end:int>>,vertices:array<struct<x:double,y:double>>,confidence:double>>>>>"


def decode_tokens(responses: DataFrame) -> DataFrame:
    """responses(map_id, response: JSON of a text and pages of tokens) -> tokens: text by its segments, corners in pixels,
    confidence. A response that is no JSON gives no token."""
    page = responses.select("map_id", F.from_json("response", _TOKEN).alias("r")).select("map_id", F.col("r.text").alias("all_"), F.posexplode("r.pages").alias("page", "p"))
    token = page.select("map_id", "page", "all_", "p.width", "p.height", F.posexplode("p.tokens").alias("seq", "t"))
    text = F.array_join(F.transform("t.segments", lambda s: F.substr(F.col("all_"), s["start"] + 1, s["end"] - s["start"])), "")
    xs, ys = F.transform("t.vertices", lambda v: v["x"] * F.col("width")), F.transform("t.vertices", lambda v: v["y"] * F.col("height"))
    box = [F.round(f(v), 4).alias(n) for n, f, v in (("x0", F.array_min, xs), ("y0", F.array_min, ys), ("x1", F.array_max, xs), ("y1", F.array_max, ys))]
    return token.select("map_id", F.col("page").cast("long"), F.col("seq").cast("long"), F.trim(text).alias("text"), *box, F.round("t.confidence", 4).alias("conf")).filter("text <> ''")


def text_rows(tokens: DataFrame) -> DataFrame:
    """tokens(map_id, seq, x0, v0, v1), extents across the reading direction -> each token's row: in order of their middle, a
    token joins the first row whose last token it overlaps by more than half of the lesser height, else begins a new one.
    A fold over each map's sorted array, which a map bounds."""
    ordered = tokens.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct(((F.col("v0") + F.col("v1")) / 2).alias("mid"), F.col("x0"), F.col("seq"), F.col("v0"), F.col("v1")))).alias("ts"))
    start = F.array().cast("array<struct<v0:double,v1:double,seqs:array<bigint>>>")

    def add(rows: Column, t: Column) -> Column:
        overlaps = lambda r: F.least(r["v1"], t["v1"]) - F.greatest(r["v0"], t["v0"]) > 0.5 * F.least(r["v1"] - r["v0"], t["v1"] - t["v0"])
        first = F.array_position(F.transform(rows, overlaps), True)
        one = F.array(t["seq"].cast("bigint"))
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == first, F.struct(t["v0"].alias("v0"), t["v1"].alias("v1"), F.concat(r["seqs"], one).alias("seqs"))).otherwise(r))
        return F.when(first > 0, grown).otherwise(F.concat(rows, F.array(F.struct(t["v0"].alias("v0"), t["v1"].alias("v1"), one.alias("seqs")))))

    rows = ordered.select("map_id", F.posexplode(F.aggregate("ts", start, add)).alias("row_no", "r"))
    return rows.select("map_id", F.col("row_no").cast("long"), F.explode("r.seqs").alias("seq"))


def trace_rows(events: DataFrame, most: int = TRACED) -> DataFrame:
    """events(run_id, turn, role, text) -> one JSON line for each, its text cut to what a trace keeps."""
    return events.select("run_id", "turn", F.to_json(F.struct("turn", "role", F.substring("text", 1, most).alias("text"), F.length("text").alias("length"))).alias("line"))
