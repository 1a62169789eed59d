"""The warp: sheets resampled onto north-up canvases, in tiles.

A canvas holds the whole sheet at the sheet's own pixel size. Each of its pixels takes the value of the place on the sheet that
its map's transformation gives, bilinear between four pixels, white beyond the sheet. A sheet that lies along the axes keeps its
pixels: only its origin and pixel sizes are new.

Both sides are cut into squares of TILE pixels, so that no task holds a sheet, and pixels are shuffled twice, each once: a
square of the sheet goes to its key, where every tile that it touches takes what it holds of it, and these parts, which do not
overlap, meet at their tile. What a tile touches is computed for each of its pixels, so that bent sheets need no margin.

Cases: sheets without control points give nothing, rows with a null id neither. A sheet whose pixels do not fill its size,
whose id another sheet has, whose points lie on a line or are too few for their kind, or whose canvas has no finite size or one
above `longest`, is a row of errors(map_id, error); other sheets are untouched. Ids may be of any type, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from . import scan
from .transforms import predict

#: Side of the squares that canvases and sheets are cut into, and rows of a tile that are placed at a time.
TILE, BAND = 512, 32
# Longest side of a sheet or canvas, rotation in degrees below which nothing is resampled, white.
LONGEST, UPRIGHT, PAPER = 32_000, 2e-3, 255

CANVAS = "x_min double, y_max double, res_x double, res_y double, out_width int, out_height int, resampled boolean"


@dataclass
class Warped:
    """canvases(map_id, x_min, y_max, res_x, res_y, out_width, out_height, resampled, kind), tiles(map_id, tile_row, tile_col,
    x_min, y_max, res_x, res_y, width, height, channels, pixels) and errors(map_id, error). Origins are corners of pixels."""

    canvases: DataFrame
    tiles: DataFrame
    errors: DataFrame


def canvas_of(width: int, height: int, kind: str, points: np.ndarray, longest: int = LONGEST) -> tuple:
    """The north-up canvas of a sheet whose points are rows of px, py, x, y; raises where it has none."""
    pixel, world = points[:, :2], points[:, 2:]
    if not np.isfinite(points).all() or len(points) < 3 or any(np.linalg.matrix_rank((v - v.mean(axis=0)) / (np.abs(v - v.mean(axis=0)).max() or 1.0), tol=1e-9) < 2 for v in (pixel, world)):
        raise ValueError("control points do not span the sheet")
    base, right, down = predict("affine", pixel, world, np.array([[0.0, 0.0], [width, 0.0], [0.0, height]]))
    (a, c), (b, d) = (right - base) / width, (down - base) / height
    turned = max(abs(np.degrees(np.arctan2(c, a))), abs(np.degrees(np.arctan2(b, -d))))
    if kind == "affine" and turned < UPRIGHT:
        x, y = base - (a + b) / 2 * np.array([1.0, 0.0]) - (c + d) / 2 * np.array([0.0, 1.0])
        return float(x), float(y), float(a), float(-d), width, height, False
    t = np.linspace(0, 1, 9)
    border = np.concatenate([np.stack(np.broadcast_arrays(x, y), 1) for x, y in ((t * width, 0), (t * width, height), (0, t * height), (width, t * height))]) - 0.5
    placed = predict(kind, pixel, world, border)
    res = float(np.sqrt(np.hypot(a, c) * np.hypot(b, d)))
    (x0, y0), (x1, y1) = placed.min(axis=0), placed.max(axis=0)
    size = np.ceil(np.round(np.array([x1 - x0, y1 - y0]) / res, 6))
    if not np.isfinite(size).all() or max(*size, width, height) > longest:
        raise ValueError(f"the canvas would be longer than {longest} pixels")
    return float(x0), float(y1), res, res, int(size[0]), int(size[1]), True


def places_of(tile: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where the pixels of a tile lie on the sheet."""
    x = np.arange(tile["tile_col"] * TILE, min(tile["out_width"], (tile["tile_col"] + 1) * TILE), dtype=float)
    y = np.arange(tile["tile_row"] * TILE, min(tile["out_height"], (tile["tile_row"] + 1) * TILE), dtype=float)
    out = np.empty((len(y), len(x), 2))
    if not tile["resampled"]:
        out[...] = np.stack(np.meshgrid(x, y), axis=2)
        return out[..., 0], out[..., 1]
    points = np.array([(p["px"], p["py"], p["x"], p["y"]) for p in tile["points"]])
    for k in range(0, len(y), BAND):
        at = np.stack(np.meshgrid(tile["x_min"] + (x + 0.5) * tile["res_x"], tile["y_max"] - (y[k : k + BAND] + 0.5) * tile["res_y"]), axis=2)
        out[k : k + BAND] = predict(tile["kind"], points[:, 2:], points[:, :2], at.reshape(-1, 2)).reshape(at.shape)
    return out[..., 0], out[..., 1]


def _cells_of(tile: dict, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Number of the square of the sheet that holds each pixel of a tile, row by row; -1 beyond the sheet."""
    inside = (px > -1) & (px < tile["width"]) & (py > -1) & (py < tile["height"])
    across = -(-tile["width"] // TILE)
    column, row = (np.maximum(np.floor(np.where(inside, v, 0)).astype(np.int64), 0) // TILE for v in (px, py))
    return np.where(inside, row * across + column, -1)


def _part(tile: dict) -> tuple[bytes, bytes]:
    """What a tile takes from one square of the sheet: which of its pixels, and their values in order."""
    channels = tile["channels"]
    px, py = places_of(tile)
    mine = _cells_of(tile, px, py) == tile["cell"]
    cell = np.frombuffer(tile["cell_pixels"], np.uint8).reshape(TILE + 2, TILE + 2, channels).astype(np.float64)
    across = -(-tile["width"] // TILE)
    x, y = px[mine] - tile["cell"] % across * TILE + 1, py[mine] - tile["cell"] // across * TILE + 1
    i, j = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = (x - i)[:, None], (y - j)[:, None]
    upper, lower = (cell[j + k, i] * (1 - fx) + cell[j + k, i + 1] * fx for k in (0, 1))
    return np.packbits(mine).tobytes(), np.rint(upper * (1 - fy) + lower * fy).astype(np.uint8).tobytes()


def _mapped(df: DataFrame, kept: list[str], make: Callable[[dict], Iterator[tuple]], schema: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """For each row the rows that `make` gives, beside the columns kept. One row's worth is sent at a time."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                made = list(make(batch.slice(k, 1).to_pylist()[0]))
                if made:
                    held = [batch.column(c).take(pa.array([k] * len(made), pa.int64())) for c in kept]
                    columns = [pa.array([m[n] for m in made], kind) for n, (_, kind, _) in enumerate(schema)]
                    yield pa.RecordBatch.from_arrays(held + columns, [*kept, *(c for c, _, _ in schema)])

    spark_types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {t}" for c, _, t in schema]
    return df.mapInArrow(run, ", ".join(spark_types))


def _canvases(images: DataFrame, gcps: DataFrame, longest: int) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("px", "py", "x", "y"))).alias("points")
    models = gcps.groupBy("map_id").agg(F.coalesce(F.max("kind"), F.lit("affine")).alias("kind"), points)
    largest = lambda c: F.max(c).alias(c)
    sizes = images.groupBy("map_id").agg(F.count("*").alias("copies"), largest("width"), largest("height"), F.max(F.length("pixels")).alias("length"))

    def make(r: dict) -> Iterator[tuple]:
        area = (r["width"] or 0) * (r["height"] or 0)
        channels, rest = divmod(r["length"] or 0, area) if area > 0 else (0, 1)
        try:
            if r["copies"] > 1:
                raise ValueError("several sheets have this id")
            if rest or channels not in (1, 3) or min(r["width"], r["height"]) < 1:
                raise ValueError("pixels do not fill the sheet")
            points = np.array([(p["px"], p["py"], p["x"], p["y"]) for p in r["points"]], dtype=float)
            yield (*canvas_of(r["width"], r["height"], r["kind"], points, longest), channels, None)
        except Exception as e:  # noqa: BLE001  a sheet that has no canvas is a row, not the end of the batch
            yield (*[None] * 7, None, f"warp: {e}")

    kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = [(c.split()[0], kinds[c.split()[1]], c.split()[1]) for c in CANVAS.split(", ")] + [("channels", pa.int32(), "int"), ("error", pa.string(), "string")]
    return _mapped(sizes.join(models, "map_id"), ["map_id", "width", "height", "kind", "points"], make, schema)


def _cells(images: DataFrame, good: DataFrame) -> DataFrame:
    """The squares of the sheets with the pixels around them: map_id, cell, cell_pixels."""
    held = images.select("map_id", "height", "pixels").join(good.select("map_id", "channels", (F.col("width") * F.col("channels")).alias("width")), "map_id")
    cut = scan.stripes(held, TILE, 1).join(good.select("map_id", "channels"), "map_id")

    def make(r: dict) -> Iterator[tuple]:
        channels, width = r["channels"], r["width"] // r["channels"]
        gray = np.frombuffer(r["pixels"], np.uint8).reshape(-1, width, channels)
        across = -(-width // TILE)
        wide = np.full((TILE + 2, across * TILE + 2, channels), PAPER, np.uint8)
        above = 1 - (r["first"] - r["top"])
        wide[above : above + len(gray), 1 : width + 1] = gray
        for k in range(across):
            yield r["first"] // TILE * across + k, np.ascontiguousarray(wide[:, k * TILE : (k + 1) * TILE + 2]).tobytes()

    return _mapped(cut, ["map_id"], make, [("cell", pa.int64(), "long"), ("cell_pixels", pa.binary(), "binary")])


def warp(images: DataFrame, gcps: DataFrame, longest: int = LONGEST) -> Warped:
    """images(map_id, width, height, pixels: one or three bytes each, row by row) and gcps(map_id, px, py, x, y, kind) -> their
    canvases in tiles. The points are those of the map's transformation, in the chosen system, and a map holds few."""
    placed = stage(_canvases(images, gcps, longest))
    good = placed.filter("error is null").drop("error")
    last = lambda c: F.ceil(F.col(c) / TILE).cast("int") - 1
    tiles = good.withColumn("tile_row", F.explode(F.sequence(F.lit(0), last("out_height")))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), last("out_width"))))

    def touched(tile: dict) -> Iterator[tuple]:
        found = np.unique(_cells_of(tile, *places_of(tile)))
        yield from ((int(c),) for c in found)

    spread = tiles.repartition("map_id", "tile_row", "tile_col")
    touching = _mapped(spread, tiles.columns, touched, [("cell", pa.int64(), "long")])
    met = touching.join(_cells(images, good), ["map_id", "cell"], "left")

    def part(tile: dict) -> Iterator[tuple]:
        yield _part(tile) if tile["cell"] >= 0 else (b"", b"")

    kept = ["map_id", "tile_row", "tile_col", "x_min", "y_max", "res_x", "res_y", "out_width", "out_height", "channels"]
    parts = _mapped(met, kept, part, [("mask", pa.binary(), "binary"), ("held", pa.binary(), "binary")])

    def join(table: pa.Table) -> pa.Table:
        r = table.slice(0, 1).to_pylist()[0]
        width, height = (min(TILE, r[f"out_{v}"] - r[f"tile_{w}"] * TILE) for v, w in (("width", "col"), ("height", "row")))
        out = np.full((height * width, r["channels"]), PAPER, np.uint8)
        for mask, held in zip(table["mask"].to_pylist(), table["held"].to_pylist()):
            if mask:
                mine = np.unpackbits(np.frombuffer(mask, np.uint8), count=height * width).astype(bool)
                out[mine] = np.frombuffer(held, np.uint8).reshape(-1, r["channels"])
        x, y = r["x_min"] + r["tile_col"] * TILE * r["res_x"], r["y_max"] - r["tile_row"] * TILE * r["res_y"]
        values = [(x, pa.float64()), (y, pa.float64()), (r["res_x"], pa.float64()), (r["res_y"], pa.float64()), (width, pa.int32()), (height, pa.int32()), (r["channels"], pa.int32()), (out.tobytes(), pa.binary())]
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("map_id", "tile_row", "tile_col")]
        return pa.Table.from_arrays(keys + [pa.array([v], t) for v, t in values], names)

    names = ["map_id", "tile_row", "tile_col", "x_min", "y_max", "res_x", "res_y", "width", "height", "channels", "pixels"]
    kind = images.schema["map_id"].dataType.simpleString()
    schema = f"map_id {kind}, tile_row int, tile_col int, x_min double, y_max double, res_x double, res_y double, width int, height int, channels int, pixels binary"
    drawn = parts.groupBy("map_id", "tile_row", "tile_col").applyInArrow(join, schema)
    canvases = good.select("map_id", *(c.split()[0] for c in CANVAS.split(", ")), "kind")
    return Warped(canvases, drawn, placed.filter("error is not null").select("map_id", "error"))
