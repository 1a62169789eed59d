"""All queries of the map operators over the shared tables, with their SQL for an independent engine.

The shared tables hold no maps, so that adapters read them as such by fixed arithmetic: an order is a map, its line
items are its lines and labels. They prove the operators, not the accuracy of a map.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import crosses, crs, fitting, layout, matching, peaks, raster, reports, rules, sheets, transforms
from ..sources import deliverables
from .georeference import georeference
from .portable import second_engine

FLAGSHIP = "q01_robust_axis_fit"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- adapters
_ITEMS = """SELECT l_orderkey AS map_id, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount) AS rn FROM lineitem"""
LABELS = f"""SELECT map_id, 'x' AS axis, rn AS seq, rn * 1e2 + (l_tax - 4e-2) * 1e1 AS pos,
  3e5 + 1e3 * rn + CASE WHEN l_discount >= 9e-2 THEN 1e3 * (l_partkey % 7 + 1) ELSE 0e0 END AS value FROM ({_ITEMS}) i
UNION ALL SELECT map_id, 'y' AS axis, rn AS seq, rn * 8e1 + (l_tax - 4e-2) * 5e0 AS pos,
  86e5 - 1e3 * rn + CASE WHEN l_discount <= 1e-2 THEN 1e3 * (l_suppkey % 5 + 1) ELSE 0e0 END AS value FROM ({_ITEMS}) i"""
LINES = f"""SELECT map_id, 'x' AS axis, rn AS line_no, rn * 1e2 + CASE WHEN l_suppkey % 11 = 0 THEN 37e0 ELSE 0e0 END AS pos FROM ({_ITEMS}) i
UNION ALL SELECT map_id, 'y' AS axis, rn AS line_no, rn * 8e1 + CASE WHEN l_partkey % 9 = 0 THEN 23e0 ELSE 0e0 END AS pos FROM ({_ITEMS}) i"""
WIDE_LABELS = f"SELECT map_id, axis, seq, pos + CASE WHEN seq % 3 = 0 THEN 41e0 ELSE 3e0 END AS pos FROM ({LABELS}) b"
GCPS = f"""SELECT map_id, concat('P', CAST(rn AS STRING)) AS gcp_id, rn * 1e2 + l_quantity AS px, (rn * rn % 5) * 8e1 + l_tax * 1e3 AS py,
  3e5 + 5e0 * (rn * 1e2 + l_quantity) + 2e-1 * ((rn * rn % 5) * 8e1 + l_tax * 1e3) + (l_discount - 5e-2) * 2e1 AS x,
  86e5 + 1e-1 * (rn * 1e2 + l_quantity) - 5e0 * ((rn * rn % 5) * 8e1 + l_tax * 1e3) + (l_partkey % 7 - 3) * 5e-1 AS y FROM ({_ITEMS}) i"""
VALUED = f"""SELECT map_id, axis, line_no, CASE WHEN axis = 'x' THEN 1e0 ELSE 1e-2 END AS a, CASE WHEN axis = 'x' THEN 2e-2 ELSE 1e0 END AS b, -pos AS c,
  CASE WHEN line_no % 4 <> 0 THEN CASE WHEN axis = 'x' THEN 3e5 + 1e3 * line_no ELSE 86e5 - 1e3 * line_no END END AS value FROM ({LINES}) l"""
MAPS = "SELECT o_orderkey AS map_id, 500 + o_orderkey % 300 AS width, 400 + o_custkey % 200 AS height, 2e1 AS x0, 2e1 AS y0, 45e1 AS x1, 35e1 AS y1 FROM orders"
RESIDUALS = f"SELECT map_id, rn % 4 AS line_no, (l_discount - 5e-2) * 1e1 + CASE WHEN rn % 4 = 1 THEN 3e0 ELSE 0e0 END AS residual FROM ({_ITEMS}) i"
EVENTS = "SELECT user_id AS group_id, value AS v FROM events WHERE value IS NOT NULL"
TIMED = "SELECT user_id AS group_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS t, value AS v FROM events WHERE value IS NOT NULL"
BOXES = f"""SELECT map_id, rn AS seq, concat(CAST(l_partkey AS STRING), ' m') AS text, (l_partkey % 40) * 4e0 AS x0, (l_suppkey % 5) * 3e0 AS y0,
  (l_partkey % 40) * 4e0 + 3e1 + l_quantity AS x1, (l_suppkey % 5) * 3e0 + 12e0 AS y1, round(l_discount * 5 + 4e-1, 4) AS conf FROM ({_ITEMS}) i"""
CENTERS = f"SELECT map_id, seq, text, x0 * 25e-1 AS cx, y0 * 3e1 AS cy FROM ({BOXES}) b"
FRAMED = f"SELECT map_id, axis, pos, 2e1 + line_no AS low, 4e2 + line_no * line_no AS high FROM ({LINES}) l"
TOKENS = f"""SELECT map_id, rn % 2 AS row_no, rn AS seq, CAST(l_partkey AS STRING) AS text, rn * 5e1 + l_quantity * 2e-1 AS x0, rn * 5e1 + 7e1 + l_discount * 3e2 AS x1, 12e0 AS height FROM ({_ITEMS}) i"""
VECTOR_SPARK = "SELECT vec_id AS group_id, CAST(t AS DOUBLE) AS t, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS t, v"
VECTOR_SECOND = "SELECT vec_id AS group_id, CAST(generate_subscripts(embedding, 1) - 1 AS DOUBLE) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
ERRORS = "SELECT o_orderkey AS map_id, o_custkey % 30 AS n, o_totalprice / 1e5 AS loo_affine, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice * 55e-2 / 1e5 END AS loo_projective, o_totalprice * 2e-1 / 1e5 AS loo_poly2 FROM orders"
FITS = """SELECT o_orderkey AS map_id, 'x' AS axis, 1e1 + (o_custkey % 3) * 1e-2 AS slope, 3e5 AS intercept FROM orders
UNION ALL SELECT o_orderkey AS map_id, 'y' AS axis, -125e-1 - (o_custkey % 4) * 1e-2 AS slope, 86e5 AS intercept FROM orders"""
STEPS = "SELECT o_orderkey AS map_id, 'x' AS axis, 1e3 AS step FROM orders UNION ALL SELECT o_orderkey AS map_id, 'y' AS axis, 5e2 AS step FROM orders"

#: Line items of one partition, so that the memory of a task does not follow the input.
PART_ROWS = 400_000


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    """The shared tables that the query names. Line items are dealt out by map, in parts of bounded size."""
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    if "lineitem" in found:
        parts = max(spark.sparkContext.defaultParallelism, -(-found["lineitem"].count() // PART_ROWS))
        found["lineitem"] = found["lineitem"].repartition(parts, "l_orderkey")
    return found


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An adapter's relation as a DataFrame."""
    for union, rows in ROWS.items():
        sql = sql.replace(union, rows)
    found = tables(spark, sf_dir, sql)
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself, such as JSON
    for t in found:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **found)


def register(name: str, operator: Callable[..., DataFrame], sql: str | None, second: dict[str, str] | None = None, **inputs: str) -> None:
    """A query: the operator over adapters; sql is its text for the second engine, over the same adapters."""
    QUERIES[name] = lambda spark, sf_dir: operator(**{k: relation(spark, sf_dir, v) for k, v in inputs.items()})
    if sql is not None:
        given = second if second and not set(second) & set(inputs) else {**inputs, **(second or {})}
        SQL[name] = second_engine(sql, **{k: v.replace("AS STRING", "AS VARCHAR") for k, v in given.items()})


register("q01_robust_axis_fit", partial(fitting.axis_fit, rounded=True), fitting.AXIS_FIT, labels=LABELS)
register("q02_label_nearest_line", matching.nearest_line, matching.NEAREST, labels=WIDE_LABELS, lines=LINES)
register("q03_line_spacing", fitting.line_spacing, fitting.SPACING, lines=LINES)
register("q04_lattice_flags", fitting.lattice_flags, fitting.LATTICE, lines=LINES)
register("q05_grid_step_nice", partial(fitting.nice_step, rounded=True), fitting.NICE_STEP, labels=LABELS)
register("q06_snap_values", fitting.snap_values, fitting.SNAP, lines=LINES, fits=FITS, steps=STEPS)
# a limit above the joins makes the second engine plan them without their keys, unless they are computed apart
CROSSINGS_SECOND = matching.CROSSINGS.replace("STRING", "VARCHAR").replace("placed AS (", "placed AS MATERIALIZED (")
register("q07_gcp_cross", matching.crossings, CROSSINGS_SECOND, lines=VALUED, maps=MAPS)
register("q08_affine_fit", partial(fitting.affine_fit, rounded=True), fitting.AFFINE_FIT, gcps=GCPS)
register("q09_affine_loo", partial(fitting.affine_loo, rounded=True), fitting.AFFINE_LOO, gcps=GCPS)
register("q10_gcp_outliers", fitting.gcp_outliers, fitting.OUTLIERS, gcps=GCPS)
register("q11_inconsistent_lines", fitting.inconsistent_lines, fitting.INCONSISTENT, residuals=RESIDUALS)
register("q12_auto_model_choice", fitting.model_choice, fitting.MODEL_CHOICE, errors=ERRORS)
register("q26_cluster_islands", lambda points: matching.islands(points, 2.5), matching.ISLANDS.replace("{tolerance_}", "2.5"), points=EVENTS)
register("q28_phrase_group", matching.phrases, matching.PHRASES_SECOND, tokens=TOKENS)
register(
    "q29_ocr_dedup_iou",
    matching.box_duplicates,
    """WITH ordered AS (SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY seq) AS rn, struct_pack(seq, text, conf, x0, y0, x1, y1) AS b FROM boxes WHERE trim(text) <> ''),
walk AS (
  SELECT map_id, rn, [b] AS kept FROM ordered WHERE rn = 1
  UNION ALL SELECT map_id, rn, CASE WHEN hit IS NULL THEN list_append(kept, b) WHEN (b.conf, length(b.text)) > (kept[hit].conf, length(kept[hit].text))
    THEN list_concat(list_append(kept[1:hit - 1], b), kept[hit + 1:]) ELSE kept END AS kept
  FROM (SELECT o.map_id, o.rn, o.b, w.kept, nullif(list_position(list_transform(w.kept, lambda k: 3 *
          greatest(0, least(k.x1, o.b.x1) - greatest(k.x0, o.b.x0)) * greatest(0, least(k.y1, o.b.y1) - greatest(k.y0, o.b.y0))
          > (k.x1 - k.x0) * (k.y1 - k.y0) + (o.b.x1 - o.b.x0) * (o.b.y1 - o.b.y0)), true), 0) AS hit
        FROM walk w JOIN ordered o ON o.map_id = w.map_id AND o.rn = w.rn + 1) s),
last_ AS (SELECT map_id, arg_max(kept, rn) AS kept FROM walk GROUP BY map_id)
SELECT map_id, CAST(k.seq AS BIGINT) AS seq, k.text AS text, round(k.conf, 4) AS conf FROM (SELECT map_id, unnest(kept) AS k FROM last_) u""",
    boxes=BOXES,
)
SQL["q29_ocr_dedup_iou"] = SQL["q29_ocr_dedup_iou"].replace("WITH boxes", "WITH RECURSIVE boxes", 1)
register("q31_reading_order_topk", matching.reading_order, matching.READING.replace("MOST", "60"), boxes=CENTERS)
register("q33_frame_from_lines", matching.frame_of_lines, matching.FRAME, lines=FRAMED)
register("q34_side_of_frame", matching.side_of_frame, matching.SIDE, boxes=CENTERS, frames=MAPS)
register("q35_mad_trim_line", fitting.trimmed_line, fitting.trimmed_text(), points=TIMED)
register("q36_percentile_ridge", matching.ridge_center, matching.RIDGE_SECOND, second={"points": VECTOR_SECOND}, points=VECTOR_SPARK)
register("q37_profile_peaks", matching.profile_peaks, matching.PEAKS, second={"points": VECTOR_SECOND}, points=VECTOR_SPARK)
# profiles with plateaus: amounts of a user's events in order, in steps of ten
STEPPED = "SELECT user_id AS group_id, CAST(event_id AS DOUBLE) AS t, floor(value / 1e1) * 1e1 AS v FROM events WHERE value IS NOT NULL"
_PEAK = {"height": 20.0, "distance": 3, "prominence": 15.0}
register(
    "q72_true_peaks", lambda points: peaks.profile_peaks(points, **_PEAK),
    re.sub("{(height|distance|prominence)}", lambda m: repr(_PEAK[m[1]]), peaks.PEAKS_SECOND), points=STEPPED,
)

# ---------------------------------------------------------------- systems, rules and deliverables
LEGENDS = """SELECT c_custkey AS map_id, CASE WHEN c_custkey % 4 = 0 THEN 'geo' ELSE 'utm' END AS kind,
  CASE c_custkey % 9 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'PSAD56' WHEN 2 THEN 'SIRGAS2000' WHEN 3 THEN 'SAD69' WHEN 4 THEN 'NAD27' WHEN 5 THEN 'ETRS89' WHEN 6 THEN 'ED50' END AS datum,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 25 + 11 AS INT) END AS zone, CASE WHEN c_custkey % 5 < 2 THEN true WHEN c_custkey % 5 = 2 THEN false END AS south,
  -78e0 + c_nationkey AS longitude, 86e5 + c_custkey * 1e3 AS northing FROM customer"""
GEOGRAPHIC = "SELECT c_custkey AS id, CAST(c_custkey % 60 + 1 AS INT) AS zone, c_custkey % 2 = 0 AS south, 6 * CAST(c_custkey % 60 + 1 AS INT) - 183 + (c_acctbal % 7) * 3e-1 AS lon, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 79 + abs(c_acctbal) % 1) AS lat FROM customer"
PROJECTED = "SELECT c_custkey AS id, CAST(c_custkey % 60 + 1 AS INT) AS zone, c_custkey % 2 = 0 AS south, 5e5 + c_acctbal * 45e0 AS easting, 2e6 + (c_custkey % 70) * 1e5 AS northing FROM customer"
CRS_ERRORS = "SELECT s.s_suppkey AS map_id, CASE n.n_nationkey % 5 WHEN 0 THEN 4326 ELSE 32700 + n.n_nationkey END AS epsg, CASE WHEN (s.s_suppkey + n.n_nationkey) % 6 <> 0 THEN 1e0 + ((s.s_suppkey * 7 + n.n_nationkey * 13) % 97) / 1e1 END AS rmse, n.n_nationkey AS seq FROM supplier s JOIN nation n ON n.n_nationkey % 4 <= s.s_suppkey % 4"
CHECKED = """SELECT o_orderkey AS map_id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 20 + 2 END AS n, o_totalprice / 1e5 AS rmse, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 8e4 END AS loo,
  o_orderkey % 17 = 0 AS mirrored, (o_custkey % 41 - 20) * 6e-1 AS rotation, 5e0 + (o_custkey % 9) * 5e-2 AS pixel_x, 5e0 AS pixel_y, CASE WHEN o_custkey % 4 = 0 THEN 'deg' ELSE 'm' END AS units,
  CASE WHEN o_custkey % 2 = 0 THEN 5e4 END AS scale, CASE WHEN o_orderkey % 2 = 0 THEN 254e0 END AS dpi, CASE WHEN o_orderkey % 8 <> 0 THEN 32718 END AS epsg, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 11 <> 0 END AS in_area, o_custkey % 6 <> 0 AS confident FROM orders"""
CHECK_LINES = f"SELECT map_id, axis, line_no, pos, CASE WHEN line_no % 5 <> 0 THEN CASE WHEN axis = 'x' THEN pos * 1e1 ELSE -pos * 1e1 END + CASE WHEN line_no = 3 AND map_id % 7 = 0 THEN -5e3 ELSE 0e0 END END AS value FROM ({LINES}) l"
PROPOSED = """SELECT o_orderkey AS map_id, o_custkey % 4 <> 0 AS has_fit, o_custkey % 3 <> 0 AS passed, CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'no_coordinates' WHEN 3 THEN 'failed' END AS proposed,
  o_custkey % 5 <> 0 AS has_text, o_orderkey % 5 <> 0 AS has_coordinates, CASE WHEN o_orderkey % 7 = 0 THEN 75e-2 END AS confidence, CASE WHEN o_custkey % 2 = 0 THEN 32718 END AS epsg FROM orders"""
STATUSES = "SELECT o_orderkey AS map_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'needs_review' ELSE 'failed' END AS status, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 50) / 1e1 END AS rmse FROM orders"
SIZES = "SELECT o_orderkey AS map_id, 500 + (o_custkey * 37) % 7000 AS width, 400 + (o_orderkey * 91) % 5200 AS height FROM orders"
TURNED = f"""SELECT map_id, seq, x0, y0, x1, y1, CAST((seq % 4) * 90 AS INT) AS rotation, 400 AS wc, 300 AS hc, CASE WHEN map_id % 3 = 0 THEN 2e0 WHEN map_id % 3 = 1 THEN 8e0 ELSE 1e0 END AS upscale, 1e1 * (map_id % 50) AS dx, 5e0 * (map_id % 40) AS dy FROM ({BOXES}) b"""
PLACED = f"SELECT map_id, seq, x0 * 2 - 1e1 AS x, y0 * 3e1 AS y, 640 AS width, 430 AS height FROM ({BOXES}) b"
TRUTHS = """SELECT o_orderkey AS map_id, 1000 + o_custkey % 500 AS width, 800 + o_custkey % 300 AS height, 5e0 AS a, 1e-1 AS b, 2e-1 AS c, -5e0 AS d, 1e2 AS e, 2e2 AS f,
  5e0 + (o_custkey % 7) * 1e-3 AS ta, 1e-1 AS tb, 2e-1 - (o_orderkey % 5) * 1e-3 AS tc, -5e0 AS td, 1e2 + (o_custkey % 11) AS te, 2e2 AS tf FROM orders"""
AFFINES = """SELECT o_orderkey AS map_id, CASE o_custkey % 5 WHEN 0 THEN 'tif' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'bmp' ELSE 'jp2' END AS suffix, 1000 + o_custkey % 500 AS width, 800 + o_custkey % 300 AS height,
  5e0 + (o_custkey % 7) * 1e-2 AS a, (o_custkey % 3) * 1e-2 AS b, (o_custkey % 3) * 1e-2 AS c, -5e0 - (o_custkey % 7) * 1e-2 AS d, 3e5 + o_custkey AS e, 86e5 - o_orderkey AS f FROM orders"""
TURNS = "SELECT conv_id AS run_id, turn, role, text FROM conversations"
EVENT_ROWS = "SELECT event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE 'grid' END AS source, value FROM events"
# an event edits the order of its number; keys meet as they are, without a count or a rank of all orders
_EDITED = "SELECT e.*, o_orderkey AS map_id FROM events e JOIN orders o ON o_orderkey = event_id WHERE value IS NOT NULL UNION ALL SELECT e.*, o_orderkey AS map_id FROM events e JOIN orders o ON o_custkey = user_id WHERE value IS NOT NULL AND event_id % 50 = o_orderkey % 50"
EDITS = f"SELECT map_id, event_id % 7 + 1 + 1000 * (event_id % 2) AS line_no, event_id AS seq, CASE WHEN event_type IN ('error', 'click') THEN 'exclude' ELSE 'set' END AS action, round(value, 2) AS value FROM ({_EDITED}) e"
EDIT_LINES = f"SELECT map_id, CASE WHEN axis = 'x' THEN line_no ELSE 1000 + line_no END AS line_no, pos * 1e1 AS value FROM ({LINES}) l"
ENABLED = f"SELECT map_id, gcp_id, px, py, x, y, px <> 1.5e2 AS enabled FROM ({GCPS}) g"
SHIFTS = f"SELECT map_id, min(gcp_id) AS gcp_id, 25e-2 AS dx, -5e-1 AS dy FROM ({GCPS}) g GROUP BY map_id"
PAGES = """SELECT page_id, concat(html, '<img src="data:image/png;base64,', regexp_replace(base64(CAST(html AS BINARY)), '[^A-Za-z0-9+/=]', ''), '">') AS html FROM pages"""
PAGES_SECOND = PAGES.replace("regexp_replace(base64(CAST(html AS BINARY)), '[^A-Za-z0-9+/=]', '')", "base64(encode(html))")
ARMS = "SELECT user_id AS group_id, value AS v FROM events WHERE value > 0"

register("q18_crs_candidates", crs.crs_candidates, crs.CANDIDATES, legends=LEGENDS)
register("q19_utm_forward", crs.utm_forward, crs.forward_text(), points=GEOGRAPHIC)
SHIFTED = """SELECT c_custkey AS id, -80e0 + c_nationkey + (c_acctbal % 7) * 1e-1 AS lon, (c_custkey % 160 - 80) + (c_acctbal % 3) * 1e-1 AS lat,
  CASE c_custkey % 5 WHEN 0 THEN 'PSAD56' WHEN 1 THEN 'SAD69' WHEN 2 THEN 'NAD27' WHEN 3 THEN 'ED50' ELSE 'WGS84' END AS source, CASE c_custkey % 4 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'PSAD56' WHEN 2 THEN 'ETRS89' ELSE 'none' END AS target FROM customer"""
register("q73_datum_shift", crs.shift_datum, crs.shift_text(), points=SHIFTED)
register("q20_utm_inverse_area", crs.utm_inverse, crs.inverse_text(), points=PROJECTED)
register("q21_rank_crs", crs.rank_crs, crs.RANK, candidates=CRS_ERRORS)
register("q22_validation_checks", rules.check_rows, rules.CHECK_ROWS, fits=CHECKED, lines=CHECK_LINES)
register("q22b_validation_passed", rules.passed, rules.PASSED, fits=CHECKED, lines=CHECK_LINES)
register("q23_decide_status", rules.status, rules.STATUS, maps=PROPOSED)
register("q39_batch_summary", rules.summary, rules.SUMMARY, maps=STATUSES)
register("q40_agent_usage", rules.usage, rules.USAGE, events=TURNS)
register("q41_trace_rollup", rules.rollup, rules.ROLLUP, events=EVENT_ROWS)
register("q45_command_overrides", rules.overrides, rules.OVERRIDES, lines=EDIT_LINES, edits=EDITS)

_TILE_AXIS = "SELECT map_id, {s} AS size, CAST(unnest(generate_series(0, CAST(greatest(1, ceil(({s} - 260) / 1940.0)) AS BIGINT) - 1)) * 1940 AS BIGINT) AS start FROM maps"
register(
    "q24_tiles",
    layout.tiles,
    f"SELECT a.map_id, a.start AS x, b.start AS y, CAST(least(2200, a.size - a.start) AS BIGINT) AS w, CAST(least(2200, b.size - b.start) AS BIGINT) AS h "
    f"FROM ({_TILE_AXIS.format(s='width')}) a JOIN ({_TILE_AXIS.format(s='height')}) b ON a.map_id = b.map_id",
    maps=SIZES,
)
register(
    "q25_unrotate_boxes",
    layout.unrotate_boxes,
    """WITH s AS (SELECT *, greatest(0.25, least(4.0, upscale)) AS k FROM boxes),
ends AS (SELECT map_id, seq, k, dx, dy,
  CASE rotation WHEN 0 THEN x0 WHEN 90 THEN y0 WHEN 180 THEN wc - 1 - x0 ELSE wc - 1 - y0 END AS ax, CASE rotation WHEN 0 THEN y0 WHEN 90 THEN hc - 1 - x0 WHEN 180 THEN hc - 1 - y0 ELSE x0 END AS ay,
  CASE rotation WHEN 0 THEN x1 WHEN 90 THEN y1 WHEN 180 THEN wc - 1 - x1 ELSE wc - 1 - y1 END AS bx, CASE rotation WHEN 0 THEN y1 WHEN 90 THEN hc - 1 - x1 WHEN 180 THEN hc - 1 - y1 ELSE x1 END AS by_ FROM s)
SELECT map_id, CAST(seq AS BIGINT) AS seq, round(least(ax, bx) / k + dx, 4) AS x0, round(least(ay, by_) / k + dy, 4) AS y0, round(greatest(ax, bx) / k + dx, 4) AS x1, round(greatest(ay, by_) / k + dy, 4) AS y1 FROM ends""",
    boxes=TURNED,
)
register(
    "q32_refgrid_cells",
    layout.grid_cells,
    """WITH placed AS (SELECT map_id, seq, 64 AS cell, CAST(least(ceil(width / 64.0) - 1, greatest(0, floor(x / 64))) AS INT) AS col_, CAST(least(ceil(height / 64.0) - 1, greatest(0, floor(y / 64))) AS INT) AS row_ FROM points)
SELECT map_id, CAST(seq AS BIGINT) AS seq, concat(chr(col_ + 65), CAST(row_ + 1 AS VARCHAR)) AS name, CAST(col_ * cell AS BIGINT) AS x0, CAST(row_ * cell AS BIGINT) AS y0 FROM placed""",
    points=PLACED,
)
register(
    "q38_truth_mesh_error",
    layout.mesh_error,
    """WITH mesh AS (SELECT f.*, (width - 1) * i / 8.0 AS x, (height - 1) * j / 8.0 AS y FROM fits f, generate_series(0, 8) AS g(i), generate_series(0, 8) AS h(j)),
q AS (SELECT map_id, power((a - ta) * x + (b - tb) * y + e - te, 2) + power((c - tc) * x + (d - td) * y + f - tf, 2) AS q FROM mesh)
SELECT map_id, round(sqrt(avg(q)), 5) AS rmse, round(sqrt(max(q)), 5) AS worst FROM q GROUP BY map_id""",
    fits=TRUTHS,
)
register(
    "q30_region_search",
    lambda items: layout.search(items, r"\d*7\d*[05] m", 50.0, 0.0, 300.0, 250.0).select("map_id", F.col("seq").cast("long"), "text"),
    "SELECT map_id, CAST(seq AS BIGINT) AS seq, text FROM items WHERE cx BETWEEN 50 AND 300 AND cy BETWEEN 0 AND 250 AND regexp_matches(text, '[0-9]*7[0-9]*[05] m')",
    items=CENTERS,
)
register(
    "q27_size_classes",
    layout.arm_classes,
    """WITH ranked AS (SELECT group_id, v, row_number() OVER (PARTITION BY group_id ORDER BY v) AS rn FROM arms),
walk AS (SELECT group_id, rn, v, v AS first_ FROM ranked WHERE rn = 1
  UNION ALL SELECT r.group_id, r.rn, r.v, CASE WHEN r.v <= 1.25e0 * w.first_ + 1 THEN w.first_ ELSE r.v END FROM walk w JOIN ranked r ON r.group_id = w.group_id AND r.rn = w.rn + 1)
SELECT group_id, round(first_, 4) AS first, CAST(count(*) AS BIGINT) AS n FROM walk GROUP BY group_id, first_ HAVING count(*) >= 4""",
    arms=ARMS,
)
SQL["q27_size_classes"] = SQL["q27_size_classes"].replace("WITH arms", "WITH RECURSIVE arms", 1)
register(
    "q42_points_rows",
    deliverables.point_rows,
    """SELECT g.map_id, g.gcp_id, printf('%.6f,%.6f,%.3f,%.3f,%d,%.4f,%.4f,%.4f', g.x, g.y, g.px, -g.py, CAST(enabled AS INT), CASE WHEN enabled THEN coalesce(dx, 0) ELSE 0 END,
  CASE WHEN enabled THEN coalesce(dy, 0) ELSE 0 END, CASE WHEN enabled THEN sqrt(coalesce(dx * dx + dy * dy, 0)) ELSE 0 END) AS line
FROM gcps g LEFT JOIN residuals r ON g.map_id = r.map_id AND g.gcp_id = r.gcp_id""",
    gcps=ENABLED,
    residuals=SHIFTS,
)
register(
    "q43_world_file",
    deliverables.world_file,
    """SELECT map_id, CASE lower(suffix) WHEN 'tif' THEN 'tfw' WHEN 'jpg' THEN 'jgw' WHEN 'png' THEN 'pgw' WHEN 'bmp' THEN 'bpw' ELSE 'wld' END AS suffix,
  concat_ws(chr(10), printf('%.10f', a), printf('%.10f', c), printf('%.10f', b), printf('%.10f', d), printf('%.10f', e), printf('%.10f', f)) AS text FROM fits""",
    fits=AFFINES,
)
register(
    "q43b_output_grid",
    deliverables.output_grid,
    """WITH border AS (SELECT f.*, CASE side WHEN 2 THEN 0.0 WHEN 3 THEN width ELSE t / 8.0 * width END - 0.5 AS x, CASE side WHEN 0 THEN 0.0 WHEN 1 THEN height ELSE t / 8.0 * height END - 0.5 AS y
  FROM fits f, generate_series(0, 3) AS g(side), generate_series(0, 8) AS h(t)),
box AS (SELECT map_id, min(a * x + b * y + e) AS x_min, max(a * x + b * y + e) AS x_max, min(c * x + d * y + f) AS y_min, max(c * x + d * y + f) AS y_max, sqrt(sqrt(any_value(a * a + b * b)) * sqrt(any_value(c * c + d * d))) AS res FROM border GROUP BY map_id)
SELECT map_id, round(x_min, 4) AS x_min, round(y_max, 4) AS y_max, round(res, 6) AS res, CAST(ceil(round((x_max - x_min) / res, 6)) AS BIGINT) AS width, CAST(ceil(round((y_max - y_min) / res, 6)) AS BIGINT) AS height FROM box""",
    fits=AFFINES,
)
register(
    "q44_strip_images",
    lambda raw: raw.select("page_id", deliverables.strip_images(F.col("html")).alias("html")),
    """WITH found AS (SELECT page_id, html, regexp_extract(html, 'data:image/[a-z]+;base64,[A-Za-z0-9+/=]+') AS m FROM raw)
SELECT page_id, replace(html, m, concat('[image omitted: ', CAST(length(m) * 3 // 4096 AS VARCHAR), ' KB, id ', substring(sha1(substring(m, 1, 8192)), 1, 10), ']')) AS html FROM found""",
    second={"raw": PAGES_SECOND},
    raw=PAGES,
)

# ---------------------------------------------------------------- text: the texts are made from numbers that SQL knows
DMS_TEXTS = """SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 6 = 0 THEN 'LAT. ' ELSE '' END, CAST(c_custkey % 85 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '°' ELSE 'º' END, CAST(c_nationkey % 60 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '′' ELSE '''' END,
  CASE WHEN c_custkey % 4 = 0 THEN concat(CAST(c_custkey % 60 AS STRING), '"') ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN ' W' WHEN 1 THEN ' SUR' WHEN 2 THEN ' E' WHEN 3 THEN ' NORTE' ELSE '' END) AS text FROM customer"""
GRID_TEXTS = """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN concat(CAST(300 + s_suppkey AS STRING), ' ', '000 mE') WHEN 1 THEN concat('8 ', CAST(100 + s_suppkey % 900 AS STRING), ' 000 m N')
  WHEN 2 THEN concat('ESCALA 1:', CAST(s_suppkey AS STRING), ' 000') ELSE concat('cota ', CAST(s_suppkey AS STRING), ' msnm') END AS text FROM supplier"""
LEGEND_TEXTS = """SELECT n_nationkey AS id, concat('DATUM ', CASE n_nationkey % 5 WHEN 0 THEN 'W.G.S. 1984' WHEN 1 THEN 'PSAD 56' WHEN 2 THEN 'SIRGAS 2000' WHEN 3 THEN 'SAD-69' ELSE 'LOCAL' END,
  ' ZONA ', CAST(n_nationkey + 1 AS STRING), CASE n_nationkey % 3 WHEN 0 THEN ' SUR' WHEN 1 THEN 'L' ELSE '' END, ' - ESCALA 1:', CAST((n_nationkey + 1) * 25 AS STRING), ' 000') AS text FROM nation"""


def _dms(texts: DataFrame) -> DataFrame:
    found = texts.select("id", text.parse_candidates(F.col("text")).alias("c"))
    c = F.col("c")
    one = F.get(c, F.lit(0))
    return found.select("id", F.size(c).cast("long").alias("n"), F.round(one["value"], 9).alias("value"), one["axis"].alias("axis"), one["signed"].alias("signed"))


register(
    "q13_parse_dms",
    _dms,
    """SELECT c_custkey AS id, CAST(1 AS BIGINT) AS n, round((c_custkey % 85 + (c_nationkey % 60) / 60.0 + CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 60 ELSE 0 END / 3600.0) * CASE WHEN c_custkey % 5 IN (0, 1) THEN -1.0 ELSE 1.0 END, 9) AS value,
  CASE WHEN c_custkey % 5 IN (0, 2) THEN 'x' WHEN c_custkey % 5 IN (1, 3) THEN 'y' END AS axis, c_custkey % 5 <> 4 AS signed FROM customer""",
    second={"texts": "SELECT 1"},
    texts=DMS_TEXTS,
)
register(
    "q14_parse_utm",
    lambda texts: texts.select("id", text.parse_value(F.col("text")).alias("value"), F.size(text.parse_candidates(F.col("text"))).cast("long").alias("n")),
    """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey < 700 THEN (300 + s_suppkey) * 1e3 WHEN s_suppkey < 9700 THEN CAST((300 + s_suppkey) * 1000 AS DOUBLE) END WHEN 1 THEN 8e6 + (100 + s_suppkey % 900) * 1e3 END AS value,
  CAST(CASE WHEN s_suppkey % 4 < 2 THEN 1 ELSE 0 END AS BIGINT) AS n FROM supplier""",
    second={"texts": "SELECT 1"},
    texts=GRID_TEXTS,
)
register(
    "q15_format_dms",
    lambda values: values.select("id", text.format_dms(F.col("v")).alias("dms")),
    """WITH t AS (SELECT id, v, CAST(round_even(abs(v) * 3600, 0) AS BIGINT) AS s FROM values_)
SELECT id, concat(CASE WHEN v < 0 THEN '-' ELSE '' END, CAST(s // 3600 AS VARCHAR), '°', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), '''', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), '"') AS dms FROM t""",
    second={"values_": "SELECT c_custkey AS id, c_acctbal / 7e1 AS v FROM customer"},
    values="SELECT c_custkey AS id, c_acctbal / 7e1 AS v FROM customer",
)


def _legend(texts: DataFrame) -> DataFrame:
    zone = text.find_zone(F.col("text"))
    return texts.select("id", text.find_datum(F.col("text")).alias("datum"), zone["zone"].alias("zone"), zone["south"].alias("south"), text.find_scale(F.col("text")).alias("scale"))


register(
    "q16_legend_datum_zone_scale",
    _legend,
    """SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'PSAD56' WHEN 2 THEN 'SIRGAS2000' WHEN 3 THEN 'SAD69' END AS datum, CAST(n_nationkey + 1 AS INT) AS zone,
  CASE WHEN n_nationkey % 3 IN (0, 1) THEN true END AS south, CAST((n_nationkey + 1) * 25000 AS BIGINT) AS scale FROM nation""",
    second={"texts": "SELECT 1"},
    texts=LEGEND_TEXTS,
)

# ---------------------------------------------------------------- numpy kernels: no SQL
SPECS = "SELECT CAST(n_nationkey AS BIGINT) AS map_id, 700 AS width, 520 AS height, (n_nationkey - 12) * 2e-1 AS rotation, 90 + n_nationkey AS step FROM nation"
register("q46_projective_poly2_tps", transforms.fit_errors, None, gcps=GCPS)
register("q47b_detect_crosses_raster", lambda specs: crosses.lines_of_crosses(crosses.crosses(raster.stripes(raster.synthetic_maps(specs, crosses=True)))), None, specs=SPECS)
register("q47_detect_grid_raster", lambda specs: raster.detect_lines(raster.synthetic_maps(specs)), None, specs=SPECS)


# ---------------------------------------------------------------- the whole batch
# Sheets of 900 x 700 pixels: a line of either family and its label for each line item, some lines and values false, most
# legends complete.
SHEETS = "SELECT o_orderkey AS map_id, 900 AS width, 700 AS height, CAST(NULL AS DOUBLE) AS dpi FROM orders"
SHEET_LINES = f"SELECT map_id, axis, line_no, 0e0 AS slope, pos AS intercept FROM ({LINES}) l"
SHEET_ITEMS = f"""SELECT map_id, CASE WHEN axis = 'x' THEN seq ELSE seq + 100 END AS seq,
  trim(concat(CASE WHEN axis = 'y' THEN substring(digits, 1, 1) ELSE '' END, ' ', substring(digits, length(digits) - 5, 3), ' ', substring(digits, length(digits) - 2, 3))) AS text,
  CASE WHEN axis = 'x' THEN pos - 2e1 ELSE 2e1 END AS x0, CASE WHEN axis = 'x' THEN 2e1 ELSE pos - 8e0 END AS y0,
  CASE WHEN axis = 'x' THEN pos + 2e1 ELSE 6e1 END AS x1, CASE WHEN axis = 'x' THEN 36e0 ELSE pos + 8e0 END AS y1
  FROM (SELECT b.*, CAST(CAST(value AS BIGINT) AS STRING) AS digits FROM ({LABELS}) b) b
UNION ALL SELECT o_orderkey AS map_id, 999 AS seq, CASE o_custkey % 4 WHEN 0 THEN 'HOJA 12' WHEN 1 THEN 'UTM ZONA 18 SUR' ELSE 'UTM - ZONA 18 SUR - DATUM WGS 84' END AS text,
  3e2 AS x0, 66e1 AS y0, 5e2 AS x1, 68e1 AS y1 FROM orders"""


def _batch(maps: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    return georeference(maps, items, lines).status


register("q71_batch_status", _batch, None, maps=SHEETS, items=SHEET_ITEMS, lines=SHEET_LINES)


# ---------------------------------------------------------------- sheet geometry
REQUESTS = """SELECT o_orderkey AS map_id, 640 + o_custkey % 3 AS width, 430 AS height, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(o_custkey % 900 - 50 AS STRING), ',', CAST(o_orderkey % 500 AS STRING), ';80.5,60')
  WHEN 2 THEN concat(substring('ABCDEFGHIJKLM', CAST(o_custkey % 12 + 1 AS INT), 1), CAST(o_orderkey % 8 AS STRING)) WHEN 3 THEN '1,2,3' ELSE 'Full' END AS text FROM orders"""
PAIRS = "SELECT o_orderkey AS map_id, (o_custkey % 17) * 1e-2 AS dx, (o_orderkey % 13) * 2e-2 AS dy, (o_custkey % 60) * 1e0 AS latitude, o_orderkey % 2 = 0 AS degrees FROM orders"
POINT_EDITS = f"SELECT map_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'V1H2' WHEN 1 THEN 'V2' ELSE 'H1' END AS what, event_type <> 'error' AS enabled FROM ({_EDITED}) e"
POINTS = f"SELECT v.map_id, concat('V', CAST(v.line_no AS STRING), 'H', CAST(h.line_no AS STRING)) AS gcp_id FROM ({LINES}) v JOIN ({LINES}) h ON v.map_id = h.map_id AND v.axis = 'x' AND h.axis = 'y'"
NO_FRAMES = "SELECT o_orderkey AS map_id, 1e2 + o_custkey % 90 AS x0, 45e1 AS x1 FROM orders WHERE o_custkey % 3 <> 0"
TICKS = f"""SELECT map_id, 'top' AS side, rn * 1e2 + l_tax * 1e1 AS pos, 2e1 AS origin FROM ({_ITEMS}) i UNION ALL SELECT map_id, 'bottom' AS side, rn * 1e2 + 3e0 + l_discount * 6e1 AS pos, 23e0 AS origin FROM ({_ITEMS}) i
UNION ALL SELECT map_id, 'left' AS side, rn * 8e1 + l_tax * 2e1 AS pos, 2e1 AS origin FROM ({_ITEMS}) i UNION ALL SELECT map_id, 'right' AS side, rn * 8e1 + l_discount * 9e1 AS pos, 2e1 AS origin FROM ({_ITEMS}) i"""
#: What Spark reads instead of a union over one relation, which it would number and shuffle anew for each branch: the same rows, made
#: of each row at once.
ROWS = {
    LABELS: f"""SELECT map_id, e.axis, e.seq, e.pos, e.value FROM ({_ITEMS}) i
  LATERAL VIEW inline(array(named_struct('axis', 'x', 'seq', rn, 'pos', rn * 1e2 + (l_tax - 4e-2) * 1e1, 'value', 3e5 + 1e3 * rn + CASE WHEN l_discount >= 9e-2 THEN 1e3 * (l_partkey % 7 + 1) ELSE 0e0 END),
  named_struct('axis', 'y', 'seq', rn, 'pos', rn * 8e1 + (l_tax - 4e-2) * 5e0, 'value', 86e5 - 1e3 * rn + CASE WHEN l_discount <= 1e-2 THEN 1e3 * (l_suppkey % 5 + 1) ELSE 0e0 END))) e AS axis, seq, pos, value""",
    LINES: f"""SELECT map_id, e.axis, e.line_no, e.pos FROM ({_ITEMS}) i
  LATERAL VIEW inline(array(named_struct('axis', 'x', 'line_no', rn, 'pos', rn * 1e2 + CASE WHEN l_suppkey % 11 = 0 THEN 37e0 ELSE 0e0 END),
  named_struct('axis', 'y', 'line_no', rn, 'pos', rn * 8e1 + CASE WHEN l_partkey % 9 = 0 THEN 23e0 ELSE 0e0 END))) e AS axis, line_no, pos""",
    FITS: f"""SELECT o_orderkey AS map_id, e.axis, e.slope, e.intercept FROM orders
  LATERAL VIEW inline(array(named_struct('axis', 'x', 'slope', 1e1 + (o_custkey % 3) * 1e-2, 'intercept', 3e5),
  named_struct('axis', 'y', 'slope', -125e-1 - (o_custkey % 4) * 1e-2, 'intercept', 86e5))) e AS axis, slope, intercept""",
    STEPS: f"""SELECT o_orderkey AS map_id, e.axis, e.step FROM orders
  LATERAL VIEW inline(array(named_struct('axis', 'x', 'step', 1e3),
  named_struct('axis', 'y', 'step', 5e2))) e AS axis, step""",
    TICKS: f"""SELECT map_id, e.side, e.pos, e.origin FROM ({_ITEMS}) i
  LATERAL VIEW inline(array(named_struct('side', 'top', 'pos', rn * 1e2 + l_tax * 1e1, 'origin', 2e1),
  named_struct('side', 'bottom', 'pos', rn * 1e2 + 3e0 + l_discount * 6e1, 'origin', 23e0),
  named_struct('side', 'left', 'pos', rn * 8e1 + l_tax * 2e1, 'origin', 2e1),
  named_struct('side', 'right', 'pos', rn * 8e1 + l_discount * 9e1, 'origin', 2e1))) e AS side, pos, origin""",
}
register("q53_tick_lines", matching.tick_lines, matching.TICKS, ticks=TICKS, frames=MAPS)

register(
    "q48_regions",
    sheets.regions,
    """WITH p AS (SELECT map_id, text, width, height, lower(text) AS t, string_split(replace(text, ';', ','), ',') AS s, greatest(1, CAST(ceil(greatest(width, height) / 10.0) AS BIGINT)) AS cell FROM requests),
n AS (SELECT *, TRY_CAST(s[1] AS DOUBLE) AS a, TRY_CAST(s[2] AS DOUBLE) AS b, TRY_CAST(s[3] AS DOUBLE) AS c, TRY_CAST(s[4] AS DOUBLE) AS d, regexp_matches(t, '^[a-z][0-9]+$') AS named, ascii(upper(t)) - 65 AS col_, TRY_CAST(substring(t, 2) AS BIGINT) - 1 AS row_ FROM p),
m AS (SELECT *, greatest(0, least(floor(a), width - 1)) AS bx, greatest(0, least(floor(b), height - 1)) AS by_, named AND col_ >= 0 AND col_ < ceil(width / CAST(cell AS DOUBLE)) AND row_ >= 0 AND row_ < ceil(height / CAST(cell AS DOUBLE)) AS sound FROM n)
SELECT map_id, text, CAST(CASE WHEN t IN ('', 'full') THEN 0 WHEN len(s) = 4 THEN bx WHEN sound THEN col_ * cell END AS BIGINT) AS x, CAST(CASE WHEN t IN ('', 'full') THEN 0 WHEN len(s) = 4 THEN by_ WHEN sound THEN row_ * cell END AS BIGINT) AS y,
  CAST(CASE WHEN t IN ('', 'full') THEN width WHEN len(s) = 4 THEN least(width, greatest(ceil(a + c), bx + 1)) - bx WHEN sound THEN least(width, (col_ + 1) * cell) - col_ * cell END AS BIGINT) AS w,
  CAST(CASE WHEN t IN ('', 'full') THEN height WHEN len(s) = 4 THEN least(height, greatest(ceil(b + d), by_ + 1)) - by_ WHEN sound THEN least(height, (row_ + 1) * cell) - row_ * cell END AS BIGINT) AS h FROM m""",
    requests=REQUESTS,
)
register(
    "q49_pyramid_levels",
    sheets.pyramid_levels,
    """WITH l AS (SELECT map_id, width, height, unnest(generate_series(0, greatest(0, CAST(ceil(log2(greatest(width, height) / 2400.0)) AS BIGINT)))) AS level FROM maps)
SELECT map_id, CAST(level AS BIGINT) AS level, CAST(greatest(1, floor(width / power(2.0, level))) AS BIGINT) AS width, CAST(greatest(1, floor(height / power(2.0, level))) AS BIGINT) AS height FROM l""",
    maps=SIZES,
)
register(
    "q50_reading_jobs",
    sheets.reading_jobs,
    f"""WITH t AS (SELECT a.map_id, a.start AS x, b.start AS y, CAST(least(2200, a.size - a.start) AS BIGINT) AS w, CAST(least(2200, b.size - b.start) AS BIGINT) AS h, CAST(0 AS BIGINT) AS rotation
  FROM ({_TILE_AXIS.format(s='width')}) a JOIN ({_TILE_AXIS.format(s='height')}) b ON a.map_id = b.map_id),
e AS (SELECT m.map_id, width, height, CAST(coalesce(ceil(x0 + 2e-2 * width), ceil(12e-2 * width)) AS BIGINT) AS l, CAST(coalesce(floor(x1 - 2e-2 * width), floor(88e-2 * width)) AS BIGINT) AS r FROM maps m LEFT JOIN frames f ON m.map_id = f.map_id)
SELECT * FROM t UNION ALL SELECT map_id, 0 AS x, 0 AS y, l AS w, CAST(height AS BIGINT) AS h, 90 AS rotation FROM e WHERE l > 20
UNION ALL SELECT map_id, r AS x, 0 AS y, CAST(width - r AS BIGINT) AS w, CAST(height AS BIGINT) AS h, 90 AS rotation FROM e WHERE width - r > 20""",
    maps=SIZES,
    frames=NO_FRAMES,
)
register(
    "q51_distances",
    sheets.distances,
    """WITH d AS (SELECT map_id, CASE WHEN degrees THEN sqrt(power(dx * 111320e0 * cos(radians(latitude)), 2) + power(dy * 110540e0, 2)) ELSE sqrt(dx * dx + dy * dy) END AS m FROM pairs),
s AS (SELECT map_id, m, m / 10 AS t, power(1e1, floor(log10(m / 10))) AS ten FROM d WHERE m > 0)
SELECT map_id, round(m, 4) AS metres, round(CASE WHEN ten >= t * (1 - 1e-12) THEN ten WHEN 2 * ten >= t * (1 - 1e-12) THEN 2 * ten WHEN 5 * ten >= t * (1 - 1e-12) THEN 5 * ten ELSE 10 * ten END, 6) AS ruler FROM s""",
    pairs=PAIRS,
)
register(
    "q52_toggle_points",
    sheets.toggle_points,
    """WITH touched AS MATERIALIZED (SELECT g.map_id, g.gcp_id, e.seq, e.enabled FROM gcps g JOIN edits e ON g.map_id = e.map_id WHERE e.what = g.gcp_id OR starts_with(g.gcp_id, e.what || 'H') OR regexp_matches(g.gcp_id, '^V[0-9]+' || e.what || '$')),
last_ AS MATERIALIZED (SELECT map_id, gcp_id, arg_max(enabled, seq) AS enabled FROM touched GROUP BY map_id, gcp_id),
done AS MATERIALIZED (SELECT g.map_id, g.gcp_id, coalesce(l.enabled, true) AS enabled FROM gcps g LEFT JOIN last_ l ON g.map_id = l.map_id AND g.gcp_id = l.gcp_id)
SELECT map_id, gcp_id, enabled FROM done""",
    gcps=POINTS,
    edits=POINT_EDITS,
)
SQL["q52_toggle_points"] = SQL["q52_toggle_points"].replace("WITH gcps AS", "WITH gcps AS MATERIALIZED", 1)  # as with the crossings


# ---------------------------------------------------------------- reports
SIDED = f"""SELECT map_id, seq, text, cx, cy, CASE seq % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' ELSE 'right' END AS side,
  CASE WHEN cx > 2e2 THEN 'outlier' ELSE 'ok' END AS status, seq % 3 <> 0 AS complete FROM ({CENTERS}) c"""
RESIDUAL_POINTS = f"SELECT map_id, gcp_id, abs(px - 3e2) + abs(y - 86e5) * 1e-3 AS residual FROM ({GCPS}) g"
PEAKS_OF = "SELECT user_id AS group_id, value AS height FROM events WHERE value IS NOT NULL"
TILE_ITEMS = f"SELECT map_id, seq % 3 AS tile, conf > 5e-1 AS added FROM ({BOXES}) b"
VALUES_A = f"SELECT map_id, value FROM ({LABELS}) b"
VALUES_B = f"SELECT map_id, value - CASE WHEN seq % 2 = 0 THEN 1e3 ELSE 0e0 END AS value FROM ({LABELS}) b"
POINT_CHANGES = f"""SELECT map_id, concat('P', CAST(event_id % 5 + 1 AS STRING)) AS gcp_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'enable' WHEN 'click' THEN 'disable' WHEN 'error' THEN 'remove' ELSE 'add' END AS action, value AS px, value * 2 AS py FROM ({_EDITED}) e"""
KINDS_OF_FIT = """SELECT o_orderkey AS map_id, CASE WHEN o_custkey % 4 = 0 THEN 'projective' ELSE 'affine' END AS kind, 5e0 AS a, (o_custkey % 3) * 1e-4 AS b,
  (o_orderkey % 2) * 1e-4 AS c, -5e0 AS d FROM orders"""
MIDDLES = """SELECT c_custkey AS map_id, CASE c_custkey % 5 WHEN 0 THEN 4326 WHEN 1 THEN 32700 + CAST(c_custkey % 60 + 1 AS INT) WHEN 2 THEN 24878 WHEN 3 THEN 32600 + CAST(c_custkey % 60 + 1 AS INT) ELSE 999 END AS epsg,
  CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 4e1 + 1e-5 ELSE 5e5 + c_acctbal * 9e1 END AS x, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 1e2 ELSE 2e6 + (c_custkey % 80) * 1e5 END AS y FROM customer"""
CODES = f"SELECT DISTINCT epsg FROM ({MIDDLES}) m UNION SELECT CAST(4000 + n_nationkey * 10 AS INT) AS epsg FROM nation"
JSON_MAPS = """SELECT concat('{"map": "m', CAST(o_orderkey AS STRING), '", "status": "ok", "confidence": 0.9', CASE WHEN o_custkey % 2 = 0 THEN ', "crs": {"epsg": 32718, "name": "WGS84 / UTM 18S"}' ELSE '' END,
  CASE WHEN o_custkey % 3 <> 0 THEN concat(', "transform": {"kind": "affine", "n_gcps": ', CAST(o_custkey % 40 AS STRING), ', "rmse_px": 0.25, "rmse_m": 1.5}') ELSE '' END,
  CASE WHEN o_custkey % 5 = 0 THEN ', "agent": {"turns": 3, "usage": {"input_tokens": 3000, "output_tokens": 150, "cache_read_input_tokens": 1600}}, "seconds": 2.5' ELSE '' END,
  CASE WHEN o_custkey % 7 = 0 THEN ', "notes": ["no scale", "few points"], "trace": {"url": "http://trace/1"}' ELSE '' END, '}') AS document FROM orders"""
RESPONSES = """SELECT s_suppkey AS map_id, concat('{"text": "8 650 000 N', CAST(s_suppkey AS STRING), '", "pages": [{"width": 1000, "height": 500, "tokens": [',
  '{"segments": [{"start": 0, "end": 2}], "vertices": [{"x": 0.1, "y": 0.2}, {"x": 0.12, "y": 0.2}, {"x": 0.12, "y": 0.25}, {"x": 0.1, "y": 0.25}], "confidence": 0.9},',
  '{"segments": [{"start": 2, "end": 5}, {"start": 6, "end": 9}], "vertices": [{"x": 0.2, "y": 0.1}, {"x": 0.4, "y": 0.125}], "confidence": 0.', CAST(s_suppkey % 9 + 1 AS STRING), '}]}]}') AS response FROM supplier"""
ROW_TOKENS = f"SELECT map_id, seq, x0, y0 * 2 + seq AS v0, y0 * 2 + seq + 8e0 AS v1 FROM ({BOXES}) b"
SHORT_ITEMS = """SELECT s_nationkey AS map_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place,
  CASE s_suppkey % 4 WHEN 0 THEN concat(CAST(300 + s_suppkey % 500 AS STRING), ' 000 mE') WHEN 1 THEN concat(CAST(s_suppkey % 80 AS STRING), '°30''') WHEN 2 THEN 'DATUM PSAD 56' ELSE 'RIO' END AS text, {kind} AS kind_ FROM supplier"""


def _second(text: str, **caps: int) -> str:
    for k, v in caps.items():
        text = text.replace(k, str(v))
    return text.replace("AS STRING", "AS VARCHAR")


register("q54_map_summary", reports.map_summary, reports.SUMMARY, maps=MAPS, labels=SIDED, lines=VALUED, gcps=ENABLED)
register("q55_label_list", lambda labels: reports.label_list(labels, 5), _second(reports.LABEL_LIST, MOST=5), labels=SIDED)
register("q56_worst_points", lambda points: reports.worst_points(points, 5, 2), _second(reports.WORST_POINTS, MOST=5, WORST=2), points=RESIDUAL_POINTS)
register("q57_tallest_peaks", reports.tallest, reports.TALLEST, peaks=PEAKS_OF)
register("q58_centroid", reports.centroid, reports.CENTROID, gcps=ENABLED)
register("q59_tile_counts", reports.tile_counts, reports.TILE_COUNTS, items=TILE_ITEMS)
register("q60_full_text", reports.full_text, reports.FULL_TEXT_SECOND, items=CENTERS)
register("q61_reading_sets", reports.reading_sets, reports.READING_SETS, first=VALUES_A, later=VALUES_B)
register("q62_edited_points", reports.edited_points, reports.EDITED_POINTS, gcps=ENABLED, edits=POINT_CHANGES)
register("q63_upright", reports.upright, reports.UPRIGHT, fits=KINDS_OF_FIT)
register("q64_line_names", reports.line_names, _second(reports.LINE_NAMES), lines=CHECK_LINES)
register("q65_area_of_use", crs.area_of_use, crs.area_text(), middles=MIDDLES)
register("q66_crs_names", crs.crs_names, _second(crs.NAMES), codes=CODES)
_PATHS = ", ".join(f"json_extract_string(document, '{path}') AS {c}" for c, path in reports.SUMMARY_COLUMNS.items() if c != "notes")
register(
    "q67_flat_rows",
    reports.flat_rows,
    f"SELECT {_PATHS}, coalesce(array_to_string(CAST(json_extract(document, '$.notes') AS VARCHAR[]), ' | '), '') AS notes FROM documents_",
    second={"documents_": JSON_MAPS.replace("AS STRING", "AS VARCHAR")},
    documents=JSON_MAPS,
)
register(
    "q68_decode_tokens",
    reports.decode_tokens,
    """SELECT s_suppkey AS map_id, CAST(0 AS BIGINT) AS page, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 0 THEN '8' ELSE '650000' END AS text, CASE seq WHEN 0 THEN 100e0 ELSE 200e0 END AS x0, CASE seq WHEN 0 THEN 100e0 ELSE 50e0 END AS y0,
  CASE seq WHEN 0 THEN 120e0 ELSE 400e0 END AS x1, CASE seq WHEN 0 THEN 125e0 ELSE 625e-1 END AS y1, CASE seq WHEN 0 THEN 9e-1 ELSE round((s_suppkey % 9 + 1) / 10.0, 4) END AS conf FROM supplier, (VALUES (0), (1)) AS t(seq)""",
    second={"responses_": "SELECT 1"},
    responses=RESPONSES,
)
register(
    "q69_text_rows",
    reports.text_rows,
    """WITH ordered AS (SELECT map_id, seq, v0, v1, row_number() OVER (PARTITION BY map_id ORDER BY (v0 + v1) / 2, x0, seq) AS rn FROM tokens),
walk AS (
  SELECT map_id, rn, CAST(seq AS BIGINT) AS seq, CAST(0 AS BIGINT) AS row_no, [struct_pack(a := CAST(v0 AS DOUBLE), b := CAST(v1 AS DOUBLE))] AS rows_ FROM ordered WHERE rn = 1
  UNION ALL SELECT map_id, rn, seq, CAST(coalesce(hit, len(rows_) + 1) - 1 AS BIGINT) AS row_no,
    CASE WHEN hit IS NULL THEN list_append(rows_, last_) ELSE list_concat(list_append(rows_[1:hit - 1], last_), rows_[hit + 1:]) END AS rows_
  FROM (SELECT o.map_id, o.rn, CAST(o.seq AS BIGINT) AS seq, w.rows_, struct_pack(a := CAST(o.v0 AS DOUBLE), b := CAST(o.v1 AS DOUBLE)) AS last_,
          nullif(list_position(list_transform(w.rows_, lambda r: least(r.b, o.v1) - greatest(r.a, o.v0) > 0.5 * least(r.b - r.a, o.v1 - o.v0)), true), 0) AS hit
        FROM walk w JOIN ordered o ON o.map_id = w.map_id AND o.rn = w.rn + 1) s)
SELECT map_id, row_no, seq FROM walk""",
    tokens=ROW_TOKENS,
)
SQL["q69_text_rows"] = SQL["q69_text_rows"].replace("WITH tokens", "WITH RECURSIVE tokens", 1)
for _kind, _where in (("utm", "s_suppkey % 4 = 0"), ("geo", "s_suppkey % 4 = 1"), ("datum", "s_suppkey % 4 = 2")):
    register(
        f"q70_search_{_kind}",
        partial(reports.search_kind, kind=_kind, searched=30, found=4),
        """WITH near AS (SELECT map_id, place, text, count(*) OVER (PARTITION BY map_id) AS total, row_number() OVER (PARTITION BY map_id ORDER BY place) AS rank_ FROM items WHERE place <= 30 AND kind_)
SELECT map_id, CAST(place AS BIGINT) AS place, text, CAST(total AS BIGINT) AS total FROM near WHERE rank_ <= 4""",
        items=SHORT_ITEMS.format(kind=_where),
    )
