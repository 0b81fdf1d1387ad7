"""Colour expressions: CIE L*a*b*, colour distance, luminance, interpolation, hex."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ (D65) and its white point.
MATRIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
KNEE = (6 / 29) ** 3
SLOPE = (29 / 6) ** 2 / 3


def _linear(c: Column) -> Column:
    x = c.cast("double") / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def _lift(v: Column) -> Column:
    return F.when(v > KNEE, F.cbrt(v)).otherwise(v * SLOPE + 4 / 29)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L*, a*, b* of 8-bit sRGB channels; JVM expressions only."""
    rgb = [_linear(c) for c in (r, g, b)]
    x, y, z = (_lift((rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / w) for m, w in zip(MATRIX, WHITE))
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def lab_struct(r: Column, g: Column, b: Column) -> Column:
    l, a, bb = lab(r, g, b)
    return F.struct(l.alias("l"), a.alias("a"), bb.alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    """CIE76 distance of two structs (l, a, b)."""
    d = [p[k] - q[k] for k in "lab"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


#: XYZ to linear sRGB.
INVERSE = tuple(tuple(map(float, row)) for row in np.linalg.inv(np.array(MATRIX)))


def linear_of_lab(p: Column) -> Column:
    """Linear sRGB (array of three) of a struct (l, a, b); outside of [0, 1] where the colour isn't in the gamut."""
    y = (p["l"] + 16.0) / 116.0
    xyz = F.transform(F.array(y + p["a"] / 500.0, y, y - p["b"] / 200.0), lambda t: F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) / SLOPE))
    # One array element at a time, so that each of the three is computed once.
    return F.transform(F.array(xyz), lambda v: F.array(*(v[0] * (m[0] * WHITE[0]) + v[1] * (m[1] * WHITE[1]) + v[2] * (m[2] * WHITE[2]) for m in INVERSE)))[0]


def encoded(x: Column) -> Column:
    """sRGB of linear light."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(F.abs(x), F.lit(1 / 2.4)) * 1.055 - 0.055)


def _linear_levels() -> np.ndarray:
    x = np.arange(256, dtype=np.float32) / np.float32(255)
    return np.where(x <= 0.04045, x / np.float32(12.92), ((x + np.float32(0.055)) / np.float32(1.055)) ** np.float32(2.4))


#: Linear light of each 8-bit level.
LEVELS = _linear_levels()


def lab_roots(rgb: np.ndarray) -> np.ndarray:
    """float32 roots of X, Y, Z (straight lines where it is dark) of an (..., 3) uint8 array."""
    x = (LEVELS[rgb] @ np.array(MATRIX, np.float32).T) / np.array(WHITE, np.float32)
    return np.where(x > KNEE, np.cbrt(x), np.float32(SLOPE) * x + np.float32(4 / 29))


def lab_array(rgb: np.ndarray) -> np.ndarray:
    """float32 L*a*b* of an (..., 3) uint8 array."""
    f = lab_roots(rgb)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1).astype(np.float32)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Rounded half to even, as integers."""
    return F.bround(a + (b - a) * t).cast("int")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """``#RRGGBB``."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)))


# -- the same as SQL text for oracles ------------------------------------------------------------

def sql_lab(r: str, g: str, b: str) -> tuple[str, str, str]:
    lin = [f"(CASE WHEN {c} / 255.0e0 <= 0.04045e0 THEN {c} / 255.0e0 / 12.92e0 ELSE pow(({c} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END)" for c in (r, g, b)]
    f = []
    for m, w in zip(MATRIX, WHITE):
        v = f"((({lin[0]}) * {m[0]!r}::DOUBLE + ({lin[1]}) * {m[1]!r}::DOUBLE + ({lin[2]}) * {m[2]!r}::DOUBLE) / {w!r}::DOUBLE)"
        f.append(f"(CASE WHEN {v} > {KNEE!r}::DOUBLE THEN cbrt({v}) ELSE {v} * {SLOPE!r}::DOUBLE + {4 / 29!r}::DOUBLE END)")
    return f"({f[1]} * 116e0 - 16e0)", f"(({f[0]} - {f[1]}) * 500e0)", f"(({f[1]} - {f[2]}) * 200e0)"


def sql_srgb_of_lab(l: str, a: str, b: str) -> list[str]:
    """sRGB of L*a*b*, not clipped."""
    y = f"(({l} + 16e0) / 116e0)"
    f = [f"({y} + {a} / 500e0)", y, f"({y} - {b} / 200e0)"]
    v = [f"(CASE WHEN {t} > {6 / 29!r}::DOUBLE THEN {t} * {t} * {t} ELSE ({t} - {4 / 29!r}::DOUBLE) / {SLOPE!r}::DOUBLE END)" for t in f]
    lin = ["(" + " + ".join(f"{x} * {c * w!r}::DOUBLE" for x, c, w in zip(v, m, WHITE)) + ")" for m in INVERSE]
    return [f"(CASE WHEN {x} <= 0.0031308e0 THEN {x} * 12.92e0 ELSE pow(abs({x}), {1 / 2.4!r}::DOUBLE) * 1.055e0 - 0.055e0 END)" for x in lin]
