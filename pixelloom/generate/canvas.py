"""Scenes of flat shapes, drawn exactly: a pixel belongs to a shape if its centre is inside (even-odd rule)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from random import Random

import numpy as np

from ..dims import PALETTE, SHAPES
from ..functions.geometry import ngon, unit

RING = 0.6
TRIES = 100


def _star(points: int = 5, inner: float = 0.45) -> list[tuple[float, float]]:
    a = [(-math.pi / 2 + math.pi * k / points, 1.0 if k % 2 == 0 else inner) for k in range(2 * points)]
    return [(r * math.cos(t), r * math.sin(t)) for t, r in a]


def _heart(n: int = 48) -> list[tuple[float, float]]:
    t = [2 * math.pi * k / n for k in range(n)]
    return [(16 * math.sin(x) ** 3, -(13 * math.cos(x) - 5 * math.cos(2 * x) - 2 * math.cos(3 * x) - math.cos(4 * x))) for x in t]


POLYGONS: dict[str, list[tuple[float, float]]] = {
    "circle": unit(ngon(64)), "square": [(0, 0), (1, 0), (1, 1), (0, 1)], "triangle": unit(ngon(3)), "pentagon": unit(ngon(5)), "hexagon": unit(ngon(6)), "star": unit(_star()),
    "heart": unit(_heart()), "ring": unit(ngon(64)), "arrow": [(0, 0.3), (0.6, 0.3), (0.6, 0), (1, 0.5), (0.6, 1), (0.6, 0.7), (0, 0.7)],
    "cross": [(a, b) for a, b in ((1 / 3, 0), (2 / 3, 0), (2 / 3, 1 / 3), (1, 1 / 3), (1, 2 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1 / 3, 1), (1 / 3, 2 / 3), (0, 2 / 3), (0, 1 / 3), (1 / 3, 1 / 3))],
    "diamond": [(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)], "semicircle": unit([(math.cos(math.pi + math.pi * k / 32), math.sin(math.pi + math.pi * k / 32)) for k in range(33)]),
}


@dataclass(frozen=True)
class Shape:
    name: str
    x: float
    y: float
    w: float
    h: float
    rotation: float
    fill: str

    @property
    def centre(self) -> tuple[float, float]:
        return self.x + self.w / 2, self.y + self.h / 2

    def points(self) -> np.ndarray:
        p = np.array(POLYGONS[self.name], float) * (self.w, self.h) + (self.x, self.y)
        return turned(p, self.centre, self.rotation)

    def move(self, dx: float, dy: float) -> Shape:
        return replace(self, x=self.x + dx, y=self.y + dy)

    @property
    def area(self) -> float:
        return self.w * self.h


def turned(points: np.ndarray, centre: tuple[float, float], degrees: float) -> np.ndarray:
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    return (points - centre) @ np.array([[c, s], [-s, c]]) + centre


def polygon_box(points: np.ndarray, width: int, height: int) -> tuple[slice, slice, np.ndarray]:
    """Rows and columns of a polygon's own box on the canvas, and which pixels there are inside.

    A pixel is inside if its centre has an odd number of edges to its right.
    """
    x0, y0 = np.maximum(np.floor(points.min(0)), 0).astype(int)
    x1, y1 = np.minimum(np.ceil(points.max(0)).astype(int) + 1, (width, height))
    cx, cy = np.arange(x0, max(x0, x1)) + 0.5, np.arange(y0, max(y0, y1)) + 0.5
    inside = np.zeros((len(cy), len(cx)), bool)
    if inside.size:
        (ax, ay), (bx, by) = points.T, np.concatenate([points[1:], points[:1]]).T
        edge, row = np.nonzero((ay[:, None] > cy) != (by[:, None] > cy))
        at = ax[edge] + (cy[row] - ay[edge]) / (by - ay)[edge] * (bx - ax)[edge]
        # From an edge to the next one of a row, which has an even number of them, it is by turns inside and outside.
        turns = np.diff(np.sort(row * len(cx) + np.searchsorted(cx, at)), prepend=0, append=inside.size)
        inside = np.repeat(np.arange(len(turns)) & 1 == 1, turns).reshape(inside.shape)
    return slice(y0, y0 + len(cy)), slice(x0, x0 + len(cx)), inside


def polygon_mask(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """The polygon's pixels on the whole canvas."""
    out = np.zeros((height, width), bool)
    rows, columns, inside = polygon_box(points, width, height)
    if inside.size:
        out[rows, columns] = inside
    return out


def shape_box(shape: Shape, width: int, height: int, points: np.ndarray | None = None) -> tuple[slice, slice, np.ndarray]:
    p = shape.points() if points is None else points
    rows, columns, inside = polygon_box(p, width, height)
    if shape.name == "ring" and inside.size:
        c = p.mean(0)
        r, k, hole = polygon_box((p - c) * RING + c, width, height)
        if hole.size:
            inside[r.start - rows.start : r.stop - rows.start, k.start - columns.start : k.stop - columns.start] &= ~hole
    return rows, columns, inside


def shape_mask(shape: Shape, width: int, height: int, points: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((height, width), bool)
    rows, columns, inside = shape_box(shape, width, height, points)
    if inside.size:
        out[rows, columns] = inside
    return out


def _places(differ: np.ndarray) -> np.ndarray:
    """Places of what few there is in a flat mask: words without any are passed over."""
    whole = len(differ) // 8 * 8
    word = np.flatnonzero(differ[:whole].view(np.uint64) != 0)
    k = np.flatnonzero(differ[:whole].reshape(-1, 8)[word])
    return np.r_[word[k >> 3] * 8 + (k & 7), whole + np.flatnonzero(differ[whole:])]


def painted(canvas: np.ndarray, tones: list[tuple[int, int, int]]) -> np.ndarray:
    """The picture (H, W, 3) of a canvas of numbers of tones, painted run by run."""
    flat, table = np.ascontiguousarray(canvas).reshape(-1), np.array(tones, np.uint8).reshape(-1, 3)
    first = np.r_[0, _places(flat[1:] != flat[:-1]) + 1] if flat.size else np.zeros(0, int)
    size, rgb = np.diff(np.r_[first, flat.size]), table[flat[first]]
    out = np.empty((*canvas.shape, 3), np.uint8)
    for k in range(3):  # rows of three bytes at a time would be slow
        out[..., k] = np.repeat(rgb[:, k], size).reshape(canvas.shape)
    return out


@dataclass
class Scene:
    width: int
    height: int
    colors: dict[str, tuple[int, int, int]]
    background: list[str]
    shapes: list[Shape] = field(default_factory=list)
    band: float = 0.08
    angle: float = 0.0

    #: Masks by shape, the background, and what was drawn last: (shapes, canvas) and (canvas, picture).
    _boxes: dict = field(default_factory=dict, repr=False)
    _back: np.ndarray | None = field(default=None, repr=False)
    _canvas: tuple = field(default=(None, None), repr=False)
    _picture: tuple | None = field(default=None, repr=False)

    @property
    def numbers(self) -> dict[str, int]:
        """The number of each colour on a canvas; those of the background come first."""
        return {c: k for k, c in enumerate(dict.fromkeys([*self.background, *self.colors]))}

    @property
    def tones(self) -> list[tuple[int, int, int]]:
        return [self.colors[c] for c in self.numbers]

    def _ground(self) -> np.ndarray:
        """Which tone of the background each pixel has."""
        n = len(self.background)
        if n == 1:
            return np.zeros((self.height, self.width), np.uint8)
        a = math.radians(self.angle)
        d = ((np.arange(self.width) - self.width / 2) * math.cos(a))[None, :] + ((np.arange(self.height) - self.height / 2) * math.sin(a))[:, None]
        d /= self.band * self.width
        band = np.floor(d, out=d).astype(np.int16)
        return (band & 1 if n == 2 else band % n).astype(np.uint8)

    def box(self, shape: Shape) -> tuple[slice, slice, np.ndarray]:
        """``shape_box``, made once a shape; not to be changed."""
        if shape not in self._boxes:
            self._boxes[shape] = shape_box(shape, self.width, self.height)
        return self._boxes[shape]

    def canvas(self, shapes: list[Shape] | None = None) -> np.ndarray:
        """The number of each pixel's colour; not to be changed."""
        shapes = tuple(self.shapes if shapes is None else shapes)
        if self._canvas[0] != shapes:
            if self._back is None:
                self._back = self._ground()
            canvas, number = self._back.copy(), self.numbers
            for s in shapes:
                rows, columns, inside = self.box(s)
                if inside.size:
                    np.copyto(canvas[rows, columns], number[s.fill], where=inside)
            self._canvas = shapes, canvas
        return self._canvas[1]

    def paint(self, canvas: np.ndarray, last: bool = False) -> np.ndarray:
        """The picture of a canvas; outside of the box of what differs from the first picture it is that one.  ``last``: no other will be asked for."""
        if self._picture is None:
            self._picture = canvas, painted(canvas, self.tones)
        known, picture = self._picture
        out = picture if last else picture.copy()
        if canvas is not known:
            differ = canvas != known
            rows, columns = (np.flatnonzero(differ.any(k)) for k in (1, 0))
            if len(rows):
                box = slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
                out[box] = painted(canvas[box], self.tones)
        return out

    def draw(self, shapes: list[Shape] | None = None) -> np.ndarray:
        """The picture; until it is done a pixel is the number of its colour."""
        return self.paint(self.canvas(shapes))

    def occupied(self) -> np.ndarray:
        out = np.zeros((self.height, self.width), bool)
        for s in self.shapes:
            rows, columns, inside = self.box(s)
            if inside.size:
                out[rows, columns] |= inside
        return out


def sizes(n: int) -> tuple[float, float]:
    """Shares of the shorter side that shapes of a scene of n take."""
    top = min(0.34, 0.8 / math.sqrt(max(n, 1)))
    return top * 0.55, top


def random_scene(rng: Random, n: int, width: int, height: int, colors: dict | None = None, striped: bool = False) -> Scene:
    """n shapes whose boxes keep four pixels apart where that works within TRIES; caps keep colours and types mixed."""
    colors = dict(colors or PALETTE)
    names = list(colors)
    background = rng.sample(names, 2 if striped else 1)
    scene = Scene(width, height, colors, background, angle=rng.choice([0, 30, 45, 90]) if striped else 0.0)
    free = [c for c in names if c not in background]
    cap = max(2, math.ceil(n / 3))
    low, high = sizes(n)
    side = min(width, height)
    used: dict[str, int] = {}
    uniform = lambda a, b, random=rng.random: a + (b - a) * random()  # noqa: E731  as rng.uniform, whose call costs more
    taken: list[tuple[float, float, float, float]] = []
    for _ in range(n):
        for attempt in range(TRIES):
            w = max(4.0, side * uniform(low, high))
            h = max(4.0, w * uniform(0.8, 1.25))
            x, y = uniform(2, max(3, width - w - 2)), uniform(2, max(3, height - h - 2))
            right, bottom = x + w + 4, y + h + 4
            for left, top, to_right, to_bottom in taken:
                if right >= left and to_right >= x and bottom >= top and to_bottom >= y:
                    break
            else:
                break
        box = (x, y, w, h)
        taken.append((x, y, right, bottom))
        pool = [c for c in free if used.get(c, 0) < cap] or free
        fill = rng.choice(pool)
        used[fill] = used.get(fill, 0) + 1
        scene.shapes.append(Shape(rng.choice(SHAPES), *box, float(rng.choice([0, 0, 15, 30, 45, 90])), fill))
    return scene
