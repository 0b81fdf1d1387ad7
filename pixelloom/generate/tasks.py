"""The twenty edit tasks and the diagnostic one: a scene, an instruction, and the exact answer."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from random import Random

import numpy as np

from . import canvas
from .canvas import Scene, Shape, painted, polygon_box, shape_box, turned

Edit = tuple[np.ndarray, str, dict]
TASKS: dict[str, Callable[[Random, Scene, str], Edit | None]] = {}


@dataclass
class Problem:
    image: np.ndarray
    answer: np.ndarray
    instruction: str
    meta: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        """The answer differs from the input."""
        if self.image.shape != self.answer.shape:
            return True
        a, b = (np.ascontiguousarray(x).reshape(-1) for x in (self.image, self.answer))
        whole = a.size // 8 * 8  # by words
        return not (np.array_equal(a[:whole].view(np.uint64), b[:whole].view(np.uint64)) and np.array_equal(a[whole:], b[whole:]))


def task(name: str):
    def add(f):
        TASKS[name] = f
        return f

    return add


def label(scene: Scene, s: Shape) -> str:
    same_fill = sum(t.fill == s.fill for t in scene.shapes)
    same_name = sum(t.name == s.name for t in scene.shapes)
    if same_fill == 1:
        return f"the {s.fill} shape"
    return f"the {s.name}" if same_name == 1 else f"the {s.fill} {s.name}"


def chosen(rng: Random, scene: Scene) -> int:
    """A shape that its colour and type name without doubt, if there is one."""
    clear = [k for k, s in enumerate(scene.shapes) if sum((t.fill, t.name) == (s.fill, s.name) for t in scene.shapes) == 1]
    return rng.choice(clear or list(range(len(scene.shapes))))


def without(scene: Scene, k: int) -> list[Shape]:
    return [s for j, s in enumerate(scene.shapes) if j != k]


def swapped(scene: Scene, k: int, new: Shape | None) -> np.ndarray:
    shapes = without(scene, k)
    return scene.draw(shapes if new is None else [*shapes[:k], new, *shapes[k:]])


def drawn_points(scene: Scene, k: int, points: np.ndarray) -> np.ndarray:
    """The scene with shape k drawn at other points, over the rest."""
    canvas = scene.canvas(without(scene, k)).copy()
    rows, columns, inside = shape_box(scene.shapes[k], scene.width, scene.height, points)
    np.copyto(canvas[rows, columns], scene.numbers[scene.shapes[k].fill], where=inside)
    return scene.paint(canvas)


def region(rng: Random, scene: Scene) -> np.ndarray:
    """A four-cornered region of a fair size."""
    w, h = scene.width, scene.height
    x, y = rng.uniform(0.05, 0.4) * w, rng.uniform(0.05, 0.4) * h
    dx, dy = rng.uniform(0.3, 0.5) * w, rng.uniform(0.3, 0.5) * h
    lean = rng.uniform(-0.08, 0.08) * w
    return np.array([(x, y), (x + dx, y), (x + dx + lean, y + dy), (x + lean, y + dy)])


def corners_text(p: np.ndarray) -> str:
    return ", ".join(f"({round(x)}, {round(y)})" for x, y in p)


@task("translation")
def translation(rng, scene, mode):
    k = chosen(rng, scene)
    s = scene.shapes[k]
    if mode == "align" and len(scene.shapes) > 1:
        o = rng.choice([t for j, t in enumerate(scene.shapes) if j != k])
        dx, dy = o.centre[0] - s.centre[0], 0.0
        text = f"Move {label(scene, s)} sideways until its center is above or below the center of {label(scene, o)}."
    else:
        px, py = rng.choice([(rng.choice([-1, 1]) * rng.randint(5, 25), 0), (0, rng.choice([-1, 1]) * rng.randint(5, 25)), (rng.randint(5, 20), rng.randint(5, 20))])
        dx, dy = px * scene.width / 100, py * scene.height / 100
        text = f"Move {label(scene, s)} by {px}% of the image width to the right and {py}% of the image height down."
    return swapped(scene, k, s.move(dx, dy)), text, {"dx": dx, "dy": dy}


@task("rotation")
def rotation(rng, scene, mode):
    k = chosen(rng, scene)
    s = scene.shapes[k]
    angle = rng.choice([-1, 1]) * rng.choice([30, 45, 60, 90, 120])
    pivot = s.centre if mode == "local" else (scene.width / 2, scene.height / 2)
    where = "its center" if mode == "local" else "the center of the image"
    return drawn_points(scene, k, turned(s.points(), pivot, angle)), f"Rotate {label(scene, s)} by {angle} degrees clockwise about {where}.", {"angle": angle}


@task("reflection")
def reflection(rng, scene, mode):
    k = chosen(rng, scene)
    s, p = scene.shapes[k], scene.shapes[k].points()
    if mode == "local":
        x = rng.choice([p[:, 0].min(), p[:, 0].max()])
        q, text = p * (-1, 1) + (2 * x, 0), f"Reflect {label(scene, s)} across its {'left' if x == p[:, 0].min() else 'right'} edge."
    else:
        a, b = np.array([0.0, 0.0]), np.array([float(scene.width), float(scene.height)])
        d = (b - a) / np.linalg.norm(b - a)
        q, text = 2 * (a + ((p - a) @ d)[:, None] * d) - p, f"Reflect {label(scene, s)} across the image's falling diagonal."
    return drawn_points(scene, k, q), text, {}


@task("scaling")
def scaling(rng, scene, mode):
    k = chosen(rng, scene)
    s = scene.shapes[k]
    if mode == "match" and len(scene.shapes) > 1:
        o = rng.choice([t for j, t in enumerate(scene.shapes) if j != k])
        f, g, text = o.w / s.w, o.h / s.h, f"Give {label(scene, s)} the width and height of {label(scene, o)}, keeping its center."
    else:
        f = g = math.exp(rng.uniform(math.log(0.4), math.log(2.5)))
        f = g = round(f, 2)
        text = f"Scale {label(scene, s)} by {round(f * 100)}% about its center."
    cx, cy = s.centre
    return swapped(scene, k, replace(s, x=cx - s.w * f / 2, y=cy - s.h * g / 2, w=s.w * f, h=s.h * g)), text, {"factor": f}


@task("shearing")
def shearing(rng, scene, mode):
    k = chosen(rng, scene)
    s, p = scene.shapes[k], scene.shapes[k].points()
    amount = rng.choice([-1, 1]) * rng.randint(20, 80) / 100
    bottom, height = p[:, 1].max(), max(1.0, np.ptp(p[:, 1]))
    q = p + np.stack([(bottom - p[:, 1]) / height * amount * np.ptp(p[:, 0]), np.zeros(len(p))], 1)
    return drawn_points(scene, k, q), f"Shear {label(scene, s)}: keep its bottom edge and shift its top edge by {round(amount * 100)}% of its width to the right.", {"amount": amount}


def _around(scene: Scene, low, high, wide: float) -> tuple[slice, slice, np.ndarray, np.ndarray]:
    """Rows and columns of the canvas that are no further than ``wide`` (and a pixel) from a box, and their centres."""
    (x0, y0), (x1, y1) = ((math.floor(at - wide - 1) for at in low), (math.ceil(at + wide + 1) for at in high))
    y, x = np.arange(scene.height)[max(0, y0) : max(0, y1)], np.arange(scene.width)[max(0, x0) : max(0, x1)]
    return slice(max(0, y0), max(0, y1)), slice(max(0, x0), max(0, x1)), y[:, None] + 0.5, x[None, :] + 0.5


@task("construction")
def construction(rng, scene, mode):
    image = scene.draw()
    ink = rng.choice([c for c in scene.colors if c not in scene.background])
    pts = [s.centre for s in rng.sample(scene.shapes, min(3, len(scene.shapes)))]
    names = "the centers of " + ", ".join(label(scene, s) for s in scene.shapes if s.centre in pts)
    if mode == "line" and len(pts) > 1:
        a, b = np.array(pts[0]), np.array(pts[1])
        wide = max(1.5, scene.width / 200)
        rows, columns, y, x = _around(scene, np.minimum(a, b), np.maximum(a, b), wide)
        t = np.clip(((x - a[0]) * (b - a)[0] + (y - a[1]) * (b - a)[1]) / max(1e-9, ((b - a) ** 2).sum()), 0, 1)
        m = (x - a[0] - t * (b - a)[0]) ** 2 + (y - a[1] - t * (b - a)[1]) ** 2 <= wide**2
    elif mode == "polygon" and len(pts) > 2:
        rows, columns, m = polygon_box(np.array(pts), scene.width, scene.height)
    else:
        r = math.dist(pts[0], pts[-1]) if len(pts) > 1 else scene.width / 8
        r = max(4.0, min(r, scene.width / 4))
        rows, columns, y, x = _around(scene, pts[0], pts[0], r)
        m = (x - pts[0][0]) ** 2 + (y - pts[0][1]) ** 2 <= r**2
    image[rows, columns][m] = scene.colors[ink]
    return image, f"Draw a filled {ink} {mode} through {names}.", {"color": ink}


@task("removal")
def removal(rng, scene, mode):
    s = rng.choice(scene.shapes)
    if mode == "location":
        x, y = map(round, s.centre)
        v, u = min(y, scene.height - 1), min(x, scene.width - 1)
        boxes = [scene.box(t) for t in scene.shapes]
        under = [k for k, (rows, columns, inside) in enumerate(boxes) if rows.start <= v < rows.stop and columns.start <= u < columns.stop and inside[v - rows.start, u - columns.start]]
        gone, text = set(under[-1:]), f"Remove the shape at pixel ({x}, {y})."
    else:
        key = rng.choice(["fill", "name"])
        value = getattr(s, key)
        keep = rng.random() < 0.3
        gone = {k for k, t in enumerate(scene.shapes) if (getattr(t, key) == value) != keep}
        what = f"{value} shape" if key == "fill" else value
        text = f"Remove everything but the {what}s." if keep else f"Remove every {what}."
    return scene.draw([t for k, t in enumerate(scene.shapes) if k not in gone]), text, {"removed": sorted(gone)}


@task("copying")
def copying(rng, scene, mode):
    image = scene.draw()
    s = rng.choice(scene.shapes)
    x, y, w, h = (round(v) for v in (max(0, s.x), max(0, s.y), s.w, s.h))
    tx, ty = rng.randint(0, max(0, scene.width - w)), rng.randint(0, max(0, scene.height - h))
    part = image[y : y + h, x : x + w].copy()
    image[ty : ty + part.shape[0], tx : tx + part.shape[1]] = part[: scene.height - ty, : scene.width - tx]
    return image, f"Copy the {w} x {h} rectangle whose top left corner is ({x}, {y}) so that this corner comes to ({tx}, {ty}).", {}


@task("border")
def border(rng, scene, mode):
    k = chosen(rng, scene)
    image = scene.draw()
    r = max(2, scene.width // 64)
    rows, columns, inside = scene.box(scene.shapes[k])
    ink = rng.choice([c for c in scene.colors if c not in (*scene.background, scene.shapes[k].fill)])
    if inside.size:  # nothing is wide outside of the shape's box and r around it
        m = np.pad(inside, 2 * r)
        h, w = inside.shape[0] + 2 * r, inside.shape[1] + 2 * r
        wide = np.zeros((h, w), bool)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dx * dx + dy * dy <= r * r:
                    wide |= m[r + dy : r + dy + h, r + dx : r + dx + w]
        wide &= ~m[r:-r, r:-r]
        top, left = max(0, r - rows.start), max(0, r - columns.start)
        y, x = rows.start - r + top, columns.start - r + left
        part = wide[top : top + scene.height - y, left : left + scene.width - x]
        image[y : y + part.shape[0], x : x + part.shape[1]][part] = scene.colors[ink]
    return image, f"Draw a {ink} border of {r} pixels around {label(scene, scene.shapes[k])}.", {"radius": r}


@task("cropping")
def cropping(rng, scene, mode):
    canvas = scene.canvas()
    w, h = scene.width // 2, scene.height // 2
    x, y = rng.randint(0, scene.width - w), rng.randint(0, scene.height - h)
    angle = rng.choice([-15, -10, 10, 15]) if mode == "tilted" else 0
    tilt = f", turned by {angle} degrees about its center," if angle else ""
    text = f"Crop to the {w} x {h} rectangle with its top left corner at ({x}, {y}){tilt} and scale it back to the image's size."
    if not angle:  # whole rows and columns
        ix, iy = (np.clip(np.floor(at + (np.arange(n) + 0.5) * part / n - (at + part / 2) + (at + part / 2)).astype(int), 0, n - 1) for at, part, n in ((x, w, scene.width), (y, h, scene.height)))
        return scene.paint(canvas[iy].take(ix, 1)), text, {"angle": angle}
    a = math.radians(angle)
    c, s = math.cos(a), math.sin(a)
    px = x + (np.arange(scene.width) + 0.5) * w / scene.width - (x + w / 2)
    py = (y + (np.arange(scene.height) + 0.5) * h / scene.height - (y + h / 2))[:, None]
    # What is under 0 is clipped, so that cutting off the fraction is the floor.
    ix = np.clip((px * c - py * s + (x + w / 2)).astype(np.int32), 0, scene.width - 1)
    iy = np.clip((px * s + py * c + (y + h / 2)).astype(np.int32), 0, scene.height - 1)
    iy *= scene.width
    iy += ix
    return scene.paint(canvas.take(iy)), text, {"angle": angle}


@task("recolor")
def recolor(rng, scene, mode):
    k = chosen(rng, scene)
    s = scene.shapes[k]
    if mode == "dropper" and len({t.fill for t in scene.shapes}) > 1:
        o = rng.choice([t for t in scene.shapes if t.fill != s.fill])
        ink, text = o.fill, f"Give {label(scene, s)} the color of {label(scene, o)}."
    else:
        ink = rng.choice([c for c in scene.colors if c != s.fill])
        text = "Give {} the color #{:02X}{:02X}{:02X}.".format(label(scene, s), *scene.colors[ink])
    return swapped(scene, k, replace(s, fill=ink)), text, {"color": ink}


def _in_region(rng, scene, change, text):
    """``change`` makes another colour of a colour, so that each has a second tone inside the region."""
    p = region(rng, scene)
    rows, columns, inside = polygon_box(p, scene.width, scene.height)
    tones = np.array(scene.tones, np.uint8)[None]
    canvas = scene.canvas().astype(np.uint8 if tones.size <= 3 * 128 else np.uint16)
    canvas[rows, columns] += inside.astype(canvas.dtype) * tones.shape[1]
    image = painted(canvas, [*tones[0], *change(tones, np.ones(tones.shape[:2], bool))])
    return image, f"{text} inside the polygon {corners_text(p)}.", {"polygon": p.round(1).tolist()}


def _ground(rng, scene, mode, paint, text):
    p = region(rng, scene)
    rows, columns, m = polygon_box(p, scene.width, scene.height)
    hidden = any(s.fill in scene.background for s in scene.shapes)
    shown = (scene.occupied() if hidden else scene.canvas() >= len(scene.background))[rows, columns]
    m = m & (shown if mode == "foreground" else ~shown)
    image = scene.draw()
    image[rows, columns][m] = paint(m)
    return image, f"{text} the {mode} inside the polygon {corners_text(p)}.", {}


@task("flood_fill")
def flood_fill(rng, scene, mode):
    ink = rng.choice(list(scene.colors))
    return _ground(rng, scene, mode, lambda m: scene.colors[ink], f"Fill with {ink}")


@task("blending")
def blending(rng, scene, mode):
    ink, percent = rng.choice(list(scene.colors)), rng.randint(10, 90)
    a = round(percent * 2.55)
    mix = lambda image, m: ((image[m].astype(int) * (255 - a) + np.array(scene.colors[ink]) * a + 127) // 255).astype(np.uint8)
    return _in_region(rng, scene, mix, f"Blend {ink} at {percent}% over everything")


@task("gradient")
def gradient(rng, scene, mode):
    a, b = (np.array(scene.colors[c], float) for c in rng.sample(list(scene.colors), 2))

    def paint(m):
        x = np.nonzero(m)[1]
        t = (x - x.min()) / max(1, np.ptp(x)) if len(x) else x
        return (a + (b - a) * t[:, None] + 0.5).astype(np.uint8)

    return _ground(rng, scene, mode, paint, "Paint a left-to-right gradient on")


@task("point_operations")
def point_operations(rng, scene, mode):
    k = rng.choice([-1, 1]) * rng.randint(30, 90)
    ops = {
        "invert": (lambda i, m: 255 - i[m], "Invert the colors"),
        "grayscale": (lambda i, m: ((i[m].astype(int) @ [299, 587, 114] + 500) // 1000).astype(np.uint8)[:, None].repeat(3, 1), "Turn to gray everything"),
        "brightness": (lambda i, m: np.clip(i[m].astype(int) + k, 0, 255).astype(np.uint8), f"Add {k} to every channel"),
    }
    return _in_region(rng, scene, *ops.get(mode, ops["invert"]))


@task("comparison")
def comparison(rng, scene, mode):
    n = len(scene.shapes)
    what, key = rng.choice([("area", lambda s: s.area), ("width", lambda s: s.w), ("height", lambda s: s.h)])
    rank, large = rng.randint(1, max(1, (n + 1) // 2)), rng.random() < 0.5
    order = sorted(range(n), key=lambda k: key(scene.shapes[k]), reverse=large)
    end = {1: "st", 2: "nd", 3: "rd"}.get(rank if rank < 11 or rank > 13 else 0, "th")
    return swapped(scene, order[rank - 1], None), f"Remove the shape with the {rank}{end} {'largest' if large else 'smallest'} {what}.", {"target": order[rank - 1]}


@task("ordering")
def ordering(rng, scene, mode):
    up = rng.random() < 0.5
    places = sorted(scene.shapes, key=lambda s: s.centre[0])
    by_size = sorted(((s.w, s.h) for s in places), key=lambda p: p[0] * p[1], reverse=not up)
    new = [replace(s, x=s.centre[0] - w / 2, y=s.centre[1] - h / 2, w=w, h=h) for s, (w, h) in zip(places, by_size)]
    return scene.draw(new), f"Rearrange the sizes so that from left to right the shapes get {'larger' if up else 'smaller'}.", {"ascending": up}


@task("pattern")
def pattern(rng, scene, mode):
    """Cells of a repeating pattern, some of them missing from the input."""
    rows, cols = (1, 12) if mode == "circular" else (6, 6)
    pr, pc = (1, rng.choice([2, 3, 4])) if mode == "circular" else (rng.choice([2, 3]), rng.choice([2, 3]))
    inks = [c for c in scene.colors if c not in scene.background]
    tile = {(r, c): rng.choice(inks) for r in range(pr) for c in range(pc)}
    cell = min(scene.width / (cols + 1), scene.height / (max(rows, 6) + 1))
    shapes = []
    for r in range(rows):
        for c in range(cols):
            if mode == "circular":
                a = 2 * math.pi * c / cols
                x, y = scene.width / 2 + math.cos(a) * scene.width * 0.36, scene.height / 2 + math.sin(a) * scene.height * 0.36
            else:
                x, y = (c + 1) * scene.width / (cols + 1), (r + 1) * scene.height / (rows + 1)
            shapes.append(Shape("circle", x - cell * 0.35, y - cell * 0.35, cell * 0.7, cell * 0.7, 0.0, tile[r % pr, c % pc]))
    spare = [k for k in range(len(shapes)) if not (k // cols < pr and k % cols < pc)]
    missing = set(rng.sample(spare, min(len(spare), max(1, len(scene.shapes)))))
    scene.shapes[:] = [s for k, s in enumerate(shapes) if k not in missing]
    return scene.draw(shapes), "Complete the pattern: draw the missing circles.", {"missing": sorted(missing)}


@task("counting")
def counting(rng, scene, mode):
    """A row of tally marks, of which as many stay as there are shapes of the kind."""
    s = rng.choice(scene.shapes)
    n = sum((t.name == s.name) if mode == "shape" else (t.fill == s.fill) for t in scene.shapes)
    total = min(len(scene.shapes), 12)
    ink = rng.choice([c for c in scene.colors if c not in scene.background])
    size = scene.width / (2 * total + 1)
    marks = [Shape("square", size * (2 * k + 1), scene.height - size * 1.5, size, size, 0.0, ink) for k in range(total)]
    own = list(scene.shapes)
    scene.shapes[:] = own + marks
    what = f"{s.name}s" if mode == "shape" else f"{s.fill} shapes"
    return scene.draw(own + marks[: min(n, total)]), f"Count the {what}; keep as many of the squares in the bottom row, from the left.", {"count": n}


@task("legend")
def legend(rng, scene, mode):
    fills = sorted({s.fill for s in scene.shapes})
    to = {f: rng.choice([*(c for c in scene.colors if c != f), "X"]) for f in fills}
    new = [replace(s, fill=to[s.fill]) for s in scene.shapes if to[s.fill] != "X"]
    rules = "; ".join(f"{a} becomes {b}" if b != "X" else f"{a} is deleted" for a, b in to.items())
    return scene.draw(new), f"Apply the legend to every shape: {rules}.", {"mapping": to}


@task("preservation")
def preservation(rng, scene, mode):
    """Nothing is to be changed."""
    return scene.draw(), "Leave the image as it is.", {}


def generate(name: str, seed: int, n: int, width: int, height: int, mode: str = "default", colors: dict | None = None, striped: bool = False) -> Problem | None:
    """The problem of a seed, or None if the seed makes none (another one is tried then)."""
    rng = Random(seed)
    scene = canvas.random_scene(rng, n, width, height, colors, striped)
    got = TASKS[name](Random(seed ^ 0x5EED), scene, mode)
    if got is None:
        return None
    p = Problem(scene.paint(scene.canvas(), last=True), got[0], got[1], got[2] | {"seed": seed, "n": n, "W": width, "H": height, "scene_shapes": [{"shape": s.name, "color": s.fill} for s in scene.shapes]})
    return p if p.valid or name == "preservation" else None
