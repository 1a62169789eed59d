"""Drawn sheets with a known geometry: grid lines, crosses or ticks in a frame, clutter, a decoy line, blur and noise."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

UTM = "PROYECCION UTM - ZONA 18 SUR - DATUM WGS 84 - ESCALA 1:50 000"
GEO = "COORDENADAS GEOGRAFICAS - DATUM WGS 84 - ESCALA 1:100 000"


@dataclass
class Sheet:
    width: int = 2400
    height: int = 1800
    margin: int = 170
    style: str = "lines"
    origin: tuple[float, float] = (318350.0, 8652700.0)
    res: float = 5.0
    step: float = 1000.0
    rotation: float = 0.0
    seed: int = 0
    kind: str = "utm"
    form: str = "spaced"
    letters: bool = False
    legend: str = UTM
    epsg: int | None = 32718
    drop: float = 0.0
    corrupt: float = 0.0
    clutter: int = 30
    decoys: int = 1

    def frame(self):
        return self.margin, self.margin, self.width - self.margin, self.height - self.margin

    def values(self, axis):
        x0, y0, x1, y1 = self.frame()
        k = 0 if axis == "x" else 1
        a, b = (self.origin[0], self.origin[0] + (x1 - x0) * self.res) if k == 0 else (self.origin[1] - (y1 - y0) * self.res, self.origin[1])
        every = (round(n * self.step, 9) for n in range(math.ceil(a / self.step - 1e-9), math.floor(b / self.step + 1e-9) + 1))
        low, high = (x0, x1) if k == 0 else (y0, y1)
        return [v for v in every if low + 12 < self.place(v, axis) < high - 12]

    def place(self, value, axis):
        return self.margin + (value - self.origin[0]) / self.res if axis == "x" else self.margin + (self.origin[1] - value) / self.res

    def turn(self, x, y):
        """A place of the drawing on the turned sheet."""
        c, s = math.cos(math.radians(self.rotation)), math.sin(math.radians(self.rotation))
        u, v = x - self.width / 2, y - self.height / 2
        return c * u + s * v + self.width / 2, c * v - s * u + self.height / 2

    def world(self, px, py):
        c, s = math.cos(math.radians(self.rotation)), math.sin(math.radians(self.rotation))
        u, v = np.asarray(px) - self.width / 2, np.asarray(py) - self.height / 2
        x, y = c * u - s * v + self.width / 2, c * v + s * u + self.height / 2
        return self.origin[0] + (x - self.margin) * self.res, self.origin[1] - (y - self.margin) * self.res


def geographic(**more):
    return replace(Sheet(kind="geo", epsg=4326, origin=(-76.9431, -11.8736), res=0.0002, step=5 / 60, legend=GEO), **more)


def pixels(s: Sheet) -> bytes:
    """The sheet in gray, drawn in strips so that a large one stays cheap."""
    rng = np.random.default_rng(s.seed)
    x0, y0, x1, y1 = s.frame()
    strokes = []  # (x, y, x, y, half width, ink)
    tick, arm = 20, 13
    for v in s.values("x"):
        x = s.place(v, "x")
        strokes += {"lines": [(x, y0, x, y1)], "ticks": [(x, y0, x, y0 + tick), (x, y1 - tick, x, y1)]}.get(s.style, [])
    for v in s.values("y"):
        y = s.place(v, "y")
        strokes += {"lines": [(x0, y, x1, y)], "ticks": [(x0, y, x0 + tick, y), (x1 - tick, y, x1, y)]}.get(s.style, [])
    if s.style == "crosses":
        for v in s.values("x"):
            for w in s.values("y"):
                x, y = s.place(v, "x"), s.place(w, "y")
                strokes += [(x - arm, y, x + arm, y), (x, y - arm, x, y + arm)]
    strokes = [(*t, 1.0, 30) for t in strokes]
    strokes += [(*t, 1.5, 0) for t in ((x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1))]
    for _ in range(s.clutter):
        at = rng.uniform([x0, y0], [x1, y1])
        steps = rng.normal(0, 1, (int(rng.integers(5, 12)), 2)).cumsum(axis=0) * rng.uniform(40, 130)
        points = np.clip(at + steps, [x0, y0], [x1, y1])
        strokes += [(*a, *b, rng.uniform(0.5, 1.5), int(rng.integers(80, 120))) for a, b in zip(points[:-1], points[1:])]
    for _ in range(s.decoys):
        x = x0 + rng.uniform(0.15, 0.85) * (x1 - x0)
        strokes.append((x, y0 + 0.05 * (y1 - y0), x + rng.uniform(-25, 25), y0 + 0.6 * (y1 - y0), 1.0, 70))
    gray = np.full((s.height, s.width), 246, np.float32)
    for ax, ay, bx, by, half, ink in strokes:
        (ax, ay), (bx, by) = s.turn(ax, ay), s.turn(bx, by)
        n = max(1, int(math.hypot(bx - ax, by - ay) / 200))
        for k in range(n):  # short pieces, each within its own box
            px, py, qx, qy = (ax + (bx - ax) * k / n, ay + (by - ay) * k / n, ax + (bx - ax) * (k + 1) / n, ay + (by - ay) * (k + 1) / n)
            i0, i1 = max(0, int(min(px, qx) - 4)), min(s.width, int(max(px, qx) + 5))
            j0, j1 = max(0, int(min(py, qy) - 4)), min(s.height, int(max(py, qy) + 5))
            if i0 >= i1 or j0 >= j1:
                continue
            x, y = np.arange(i0, i1, dtype=np.float32)[None], np.arange(j0, j1, dtype=np.float32)[:, None]
            dx, dy = qx - px, qy - py
            t = np.clip(((x - px) * dx + (y - py) * dy) / max(1e-9, dx * dx + dy * dy), 0, 1)
            cover = np.clip(half + 0.5 - np.hypot(x - px - t * dx, y - py - t * dy), 0, 1)
            part = gray[j0:j1, i0:i1]
            np.minimum(part, 246 - cover * (246 - ink), out=part)
    # text as rows of small blots
    for _, (bx0, by0, bx1, by1) in items(s, clean=True):
        i0, i1, j0, j1 = (int(np.clip(v, 0, m)) for v, m in ((bx0, s.width), (bx1, s.width), (by0, s.height), (by1, s.height)))
        blots = np.kron(rng.random((max(0, j1 - j0) // 4 + 1, max(0, i1 - i0) // 4 + 1)) < 0.35, np.ones((4, 4), bool))[: max(0, j1 - j0), : max(0, i1 - i0)]
        gray[j0:j1, i0:i1] = np.where(blots, 25, gray[j0:j1, i0:i1])
    soft = np.pad(gray, 1, mode="edge")
    soft = 0.25 * soft[:, :-2] + 0.5 * soft[:, 1:-1] + 0.25 * soft[:, 2:]
    soft = 0.25 * soft[:-2] + 0.5 * soft[1:-1] + 0.25 * soft[2:]
    return np.clip(np.rint(soft + rng.normal(0, 5, soft.shape)), 0, 255).astype(np.uint8).tobytes()


def _dms(v):
    total = round(abs(v) * 3600)
    d, m, sec = total // 3600, total // 60 % 60, total % 60
    return f"{d}°{m:02d}'" + (f'{sec:02d}"' if sec else "")


def _label(s, v, axis):
    if s.kind == "geo":
        return _dms(v) + ((" W" if axis == "x" else " S") if s.letters else "")
    n = f"{round(v):,}".replace(",", " ")
    return n if s.form == "spaced" else f"{n} m{'E' if axis == 'x' else 'N'}"


def items(s: Sheet, clean: bool = False):
    """(text, box) of what is printed; a part dropped or misread."""
    rng = np.random.default_rng(s.seed + 100)
    x0, y0, x1, y1 = s.frame()
    out = []
    if s.style != "none":
        out += [(_label(s, v, "x"), s.place(v, "x"), y, 110, 20) for v in s.values("x") for y in (y0 - 30, y1 + 30)]
        out += [(_label(s, v, "y"), x, s.place(v, "y"), 20, 110) for v in s.values("y") for x in (x0 - 34, x1 + 34)]
    out.append((s.legend, s.width / 2, y1 + 100, 900, 24))
    found = []
    for text, x, y, w, h in out:
        if not clean and s.drop and rng.random() < s.drop:
            continue
        if not clean and s.corrupt and rng.random() < s.corrupt and text != s.legend:
            digits = [k for k, c in enumerate(text) if c.isdigit()]
            k = digits[int(rng.integers(0, min(3, len(digits))))]
            text = text[:k] + str((int(text[k]) + int(rng.integers(1, 10))) % 10) + text[k + 1 :]
        cx, cy = s.turn(x, y)
        found.append((text, (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)))
    return found
