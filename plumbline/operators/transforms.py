"""Projective, quadratic and thin-plate transformations of control points: one small fit for each map and kind."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import CELLS, by_size
from .fitting import model_choice

#: Points that each kind needs at least.
LEAST = {"affine": 3, "projective": 4, "poly2": 7, "tps": 5}


def _basis(kind: str, p: np.ndarray) -> np.ndarray:
    x, y = p[..., 0], p[..., 1]
    columns = [np.ones_like(x), x, y]
    return np.stack(columns + ([x * x, x * y, y * y] if kind == "poly2" else []), axis=-1)


def _kernel(p: np.ndarray, centers: np.ndarray) -> np.ndarray:
    r2 = ((p[..., :, None, :] - centers[..., None, :, :]) ** 2).sum(axis=-1)
    return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0)


def _plate(p: np.ndarray) -> np.ndarray:
    """The thin plate's system over every map's points, terms of the plane last."""
    n, basis = p.shape[1], _basis("affine", p)
    system = np.zeros((len(p), n + 3, n + 3))
    system[:, :n, :n], system[:, :n, n:], system[:, n:, :n] = _kernel(p, p), basis, basis.swapaxes(1, 2)
    return system


def _decomposed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The singular values of every system of the stack, and which of them lstsq does not cut as too small."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return u, s, v, s > np.finfo(float).eps * max(a.shape[-2:]) * s[..., :1]


def _least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least solution of every system of the stack, with the cut of small singular values that lstsq makes."""
    u, s, v, large = _decomposed(a)
    inverse = np.where(large, 1 / np.where(large, s, 1), 0)
    return v.swapaxes(-1, -2) @ (inverse[..., None] * (u.swapaxes(-1, -2) @ b))


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of every system of the stack, nan for a singular one."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        sound = np.linalg.slogdet(a)[0] != 0
        out = np.full(b.shape, np.nan)
        out[sound] = np.linalg.solve(a[sound], b[sound])
        return out


def predictions(kind: str, source: np.ndarray, target: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The transformations fitted from source to target, at other points, for a stack of maps (maps by points by 2); nan
    for a map without a fit. Both sides are centered and scaled first."""
    middle, middle_t = source.mean(axis=1, keepdims=True), target.mean(axis=1, keepdims=True)
    spread, spread_t = np.abs(source - middle).mean(axis=(1, 2), keepdims=True), np.abs(target - middle_t).mean(axis=(1, 2), keepdims=True)
    spread, spread_t = np.where(spread == 0, 1, spread), np.where(spread_t == 0, 1, spread_t)
    s, t, q = (source - middle) / spread, (target - middle_t) / spread_t, (at - middle) / spread
    sound = np.isfinite(s).all(axis=(1, 2)) & np.isfinite(t).all(axis=(1, 2))
    s, t = np.where(sound[:, None, None], s, 0), np.where(sound[:, None, None], t, 0)
    n = s.shape[1]
    if kind == "projective":
        x, y = s[..., 0], s[..., 1]
        zero, one = np.zeros_like(x), np.ones_like(x)
        rows = np.concatenate(
            [np.stack([x, y, one, zero, zero, zero, -t[..., 0] * x, -t[..., 0] * y], -1), np.stack([zero, zero, zero, x, y, one, -t[..., 1] * x, -t[..., 1] * y], -1)], axis=1
        )
        h = _least_squares(rows, np.concatenate([t[..., 0], t[..., 1]], axis=1)[..., None])[..., 0]
        h = np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)
        out = np.concatenate([q, np.ones((*q.shape[:2], 1))], axis=2) @ h.swapaxes(1, 2)
        found = out[..., :2] / out[..., 2:]
    elif kind == "tps":
        w = _solved(_plate(s), np.concatenate([t, np.zeros((len(t), 3, 2))], axis=1))
        found = _kernel(q, s) @ w[:, :n] + _basis("affine", q) @ w[:, n:]
    else:
        found = _basis(kind, q) @ _least_squares(_basis(kind, s), t)
    return np.where(sound[:, None, None], found * spread_t + middle_t, np.nan)


def predict(kind: str, source: np.ndarray, target: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The transformation of one map, fitted from source to target, at other points."""
    if len(source) < LEAST[kind]:
        raise np.linalg.LinAlgError("too few points")
    found = predictions(kind, source[None], target[None], at[None])[0]
    if np.isnan(found).all() and len(found):
        raise np.linalg.LinAlgError("no fit")
    return found


def _fit_off(kind: str, world: np.ndarray, pixel: np.ndarray) -> np.ndarray:
    """Residuals of the fit over all points, for a stack of maps."""
    return predictions(kind, world, pixel, world) - pixel


def _loo_direct(kind: str, world: np.ndarray, pixel: np.ndarray) -> np.ndarray:
    """Error of leaving each point out, each by its own fit, for a stack of maps."""
    maps, n = world.shape[:2]
    square = np.zeros((maps, n))
    step = max(1, CELLS // _cells(kind, n))  # fits at a time
    for r in range(0, maps, max(1, step // n)):
        rows = slice(r, r + max(1, step // n))
        for c in range(0, n, step):
            left = np.arange(c, min(c + step, n))
            keep = np.stack([np.delete(np.arange(n), k) for k in left])
            w, p = world[rows][:, keep].reshape(-1, n - 1, 2), pixel[rows][:, keep].reshape(-1, n - 1, 2)
            found = predictions(kind, w, p, world[rows][:, left].reshape(-1, 1, 2)).reshape(-1, len(left), 2)
            square[rows, c : c + step] = ((found - pixel[rows][:, left]) ** 2).sum(axis=2)
    return np.sqrt(square.mean(axis=1))


def _cells(kind: str, n: int) -> int:
    """Numbers that one map's fit takes."""
    return (n + 3) ** 2 if kind == "tps" else 40 * n


def _left_out(kind: str, world: np.ndarray, pixel: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Error of leaving each point out, for a stack of maps that have a fit. Kinds that are linear in their terms need one fit
    for all: a residual grows by 1 / (1 - leverage); a plate, which leaves none, errs by a point's weight over its place on
    the diagonal of the system's inverse. A point that alone holds a term up leaves no fit without it, and its map is fitted
    without each of its points, as projective maps are."""
    maps, n = world.shape[:2]
    loo, direct = np.full(maps, np.nan), np.ones(maps, bool)
    if n <= LEAST[kind] + 1:
        return loo
    if kind != "projective":
        off = world - world.mean(axis=1, keepdims=True)
        spread = np.abs(off).mean(axis=(1, 2), keepdims=True)
        off = off / np.where(spread == 0, 1, spread)
        u, _, _, large = _decomposed(_basis(kind, off))
        if kind == "tps":
            inverse = _solved(_plate(off), np.broadcast_to(np.eye(n + 3), (maps, n + 3, n + 3)))[:, :n, :n]
            residual, slack = inverse @ (pixel - pixel.mean(axis=1, keepdims=True)), np.diagonal(inverse, axis1=1, axis2=2)
            least = np.where(large.all(axis=1), np.abs(slack).min(axis=1) / np.abs(slack).max(axis=1), 0)
        else:
            slack = 1 - (u**2 * large[:, None]).sum(axis=2)
            least = slack.min(axis=1)
        direct = ~(least > 1e-9)
        loo = np.sqrt(((residual / slack[..., None]) ** 2).sum(axis=2).mean(axis=1))
    if direct.any():
        loo[direct] = _loo_direct(kind, world[direct], pixel[direct])
    return loo


def _by_map(gcps: DataFrame) -> DataFrame:
    """A row for each map with its points' ids and coordinates as arrays, in order of the ids."""
    point = F.struct(F.col("gcp_id").isNull().alias("last"), "gcp_id", *(F.col(c).cast("double").alias(c) for c in ("px", "py", "x", "y")))
    held = gcps.groupBy("map_id").agg(F.array_sort(F.collect_list(point)).alias("held"))
    return held.select("map_id", *(F.col(f"held.{c}").alias(c) for c in ("gcp_id", "px", "py", "x", "y")))


def fit_errors(gcps: DataFrame) -> DataFrame:
    """gcps(map_id, gcp_id, px, py, x, y) -> for each map and kind: n, and the errors of the fit and of leaving each point
    out, in pixels: from world to pixel. Maps of one size are fitted as one array."""

    def run(batches):
        for batch in batches:
            for rows, members in by_size(batch, ["px", "py", "x", "y"], lambda n: _cells("tps", n) + 40 * n):
                px, py, x, y = members
                pixel, world, n = np.stack([px, py], -1), np.stack([x, y], -1), px.shape[1]
                for kind, least in LEAST.items():
                    rmse, loo = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
                    with np.errstate(all="ignore"):
                        if n >= least:
                            residual = _fit_off(kind, world, pixel)
                            rmse = np.sqrt((residual**2).sum(axis=2).mean(axis=1))
                            at = np.flatnonzero(~np.isnan(rmse))
                            loo[at] = _left_out(kind, world[at], pixel[at], residual[at])
                    columns = [batch.column("map_id").take(pa.array(rows)), pa.array([kind] * len(rows)), pa.array(np.full(len(rows), n), pa.int64())]
                    columns += [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (rmse, loo)]
                    yield pa.RecordBatch.from_arrays(columns, ["map_id", "kind", "n", "rmse", "loo"])

    schema = f"map_id {gcps.schema['map_id'].dataType.simpleString()}, kind string, n long, rmse double, loo double"
    found = _by_map(gcps).drop("gcp_id").mapInArrow(run, schema)
    return found.select("map_id", "kind", "n", F.round("rmse", 4).alias("rmse"), F.round("loo", 4).alias("loo"))


# A freer kind is tried from so many points and so large an error, and wins below this share of that error.
AUTO = (("projective", 8, 1.0, 0.6), ("poly2", 20, 1.5, 0.5))


def _auto_kinds(world: np.ndarray, pixel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, residuals and error of leaving points out that the rule picks for each map of a stack."""
    n = world.shape[1]
    kind, residual = np.full(len(world), "affine", object), _fit_off("affine", world, pixel)
    loo = _left_out("affine", world, pixel, residual)
    tried = np.ones(len(world), bool)
    for freer, least, error, share in AUTO:
        tried &= (n >= least) & (loo > error)
        at = np.flatnonzero(tried)
        if len(at):
            other = _fit_off(freer, world[at], pixel[at])
            better = _left_out(freer, world[at], pixel[at], other)
            wins = better < share * loo[at]
            kind[at[wins]], residual[at[wins]], loo[at[wins]] = freer, other[wins], better[wins]
    return kind, residual, loo


def auto_fit(gcps: DataFrame) -> DataFrame:
    """gcps(map_id, gcp_id, px, py, x, y) -> for each point the kind that its map's rule picks, that fit's errors n, rmse and
    loo in pixels, and the point's residual rx, ry. A freer kind is fitted only where the one before errs too much, by the
    rule of model_choice. Maps with fewer than three points, or with all on a line, have no rows."""

    def run(batches):
        for batch in batches:
            for rows, (gcp_id, *members) in by_size(batch, ["gcp_id", "px", "py", "x", "y"], lambda n: 80 * n):
                px, py, x, y = members
                pixel, world, n = np.stack([px, py], -1), np.stack([x, y], -1), px.shape[1]
                if n < LEAST["affine"]:
                    continue
                with np.errstate(all="ignore"):
                    off = world - world.mean(axis=1, keepdims=True)
                    size = np.abs(off).max(axis=(1, 2), keepdims=True)
                    known = np.isfinite(world).all(axis=(1, 2)) & np.isfinite(pixel).all(axis=(1, 2))
                    sound = np.flatnonzero(known & (np.linalg.matrix_rank(np.where(known[:, None, None], off / np.where(size == 0, 1, size), 0), tol=1e-9) >= 2))
                    kind, residual, loo = _auto_kinds(world[sound], pixel[sound])
                    rmse = np.sqrt((residual**2).sum(axis=2).mean(axis=1))
                each = lambda v: np.repeat(v, n)
                numbers = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
                columns = [batch.column("map_id").take(pa.array(each(rows[sound]))), pa.array(gcp_id[sound].ravel(), pa.string()), pa.array(each(kind), pa.string()), pa.array(np.full(n * len(sound), n), pa.int64())]
                columns += [numbers(each(rmse)), numbers(each(loo)), numbers(residual[..., 0].ravel()), numbers(residual[..., 1].ravel())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"map_id {gcps.schema['map_id'].dataType.simpleString()}, gcp_id string, kind string, n long, rmse double, loo double, rx double, ry double"
    names = [c.split()[0] for c in schema.split(", ")]
    return _by_map(gcps).mapInArrow(run, schema)


def choose_model(errors: DataFrame) -> DataFrame:
    """fit_errors' rows -> the kind that the rule picks for each map."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("loo")))
    wide = errors.groupBy("map_id").agg(F.max("n").alias("n"), pick("affine").alias("loo_affine"), pick("projective").alias("loo_projective"), pick("poly2").alias("loo_poly2"))
    return model_choice(wide)
