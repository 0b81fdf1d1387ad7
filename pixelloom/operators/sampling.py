"""Rejection sampling on DataFrames: attempts are made in waves, and only for rows that are still open."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, keyed
from ..sources.shared import stored


def in_waves(rows: DataFrame, advance: Callable[[DataFrame, int, int], DataFrame], is_open: Column, *, first: int, limit: int, name: str = "wave") -> DataFrame:
    """Rows after as many attempts as each of them needs, at most ``limit``.

    ``advance(open, lo, hi)`` makes attempts lo to hi - 1 of the rows that are still open and returns the same columns.  Waves double, so that
    a row costs at most twice the attempts it needs and the number of jobs grows with the logarithm of the most stubborn row.  Each wave is
    stored, which is where lost executors resume; rows that are done are read from their wave and not touched again.  Rows still open after the
    last attempt are returned as they are.
    """
    done, frontier, lo, size = [], stored(rows, f"{name}-0"), 0, first
    while lo < limit:
        hi = min(lo + size, limit)
        after = stored(advance(frontier, lo, hi), f"{name}-{hi}")
        done.append(after.where(~is_open))
        frontier = after.where(is_open)
        if frontier.isEmpty():
            break
        lo, size = hi, 2 * size
    else:
        done.append(frontier)
    return reduce(DataFrame.unionByName, done) if done else frontier


def first_valid(attempts: Column, valid: Callable[[Column], Column]) -> Column:
    """The first element of an array of attempts that is valid; null if none is."""
    return F.try_element_at(F.filter(attempts, valid), F.lit(1))


# -- palettes --------------------------------------------------------------------------------------

CHOSEN = "array<struct<t:int,l:double,a:double,b:double,red:int,green:int,blue:int>>"
GAMUT = 1e-6


def candidates(key: Column, lo: int, hi: int) -> Column:
    """Draws ``lo`` to ``hi - 1`` of a key, even over L*a*b*, without those outside sRGB.

    Each step binds its result, so that a hash and a conversion are computed once a draw.
    """
    drawn = F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda t: F.struct(t.alias("t"), keyed.digest(key, t).alias("h")))
    points = F.transform(drawn, lambda d: F.struct(d["t"].alias("t"), (keyed.share(d["h"], 0) * 100).alias("l"), (keyed.share(d["h"], 1) * 200 - 100).alias("a"), (keyed.share(d["h"], 2) * 200 - 100).alias("b")))
    linear = F.transform(points, lambda p: F.struct(p["t"].alias("t"), p["l"].alias("l"), p["a"].alias("a"), p["b"].alias("b"), color.linear_of_lab(p).alias("x")))
    light = F.transform(linear, lambda p: F.struct(p["t"].alias("t"), p["l"].alias("l"), p["a"].alias("a"), p["b"].alias("b"), F.transform(p["x"], color.encoded).alias("x")))
    kept = F.filter(light, lambda p: F.forall(p["x"], lambda v: (v >= -GAMUT) & (v <= 1 + GAMUT)))
    level = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")
    return F.transform(kept, lambda p: F.struct(p["t"].alias("t"), p["l"].alias("l"), p["a"].alias("a"), p["b"].alias("b"), level(p["x"][0]).alias("red"), level(p["x"][1]).alias("green"), level(p["x"][2]).alias("blue")))


def palettes(scenes: DataFrame, key: str, avoid: str, *, n: int, apart: float = 20.0, tries: int = 2000, first: int = 32) -> DataFrame:
    """``key``, ``chosen`` (at most ``n`` colours) and ``failed``: colours over ``apart`` (CIE76) from each other and from those in ``avoid``.

    ``scenes``: a row a key; ``avoid``: an array of structs (l, a, b).  Colours are drawn from one stream a key; one is taken if it is in sRGB and far
    enough from all taken before.  A palette fails if ``tries`` draws in a row give none.
    """
    chosen = F.col("chosen")
    last_of = lambda taken: F.coalesce(F.try_element_at(taken, F.lit(-1))["t"], F.lit(-1))

    def advance(rows: DataFrame, lo: int, hi: int) -> DataFrame:
        def take(so_far: Column, c: Column) -> Column:
            last = last_of(so_far)
            far = F.forall(so_far, lambda o: color.delta_e(o, c) > apart) & F.forall(F.col(avoid), lambda o: color.delta_e(o, c) > apart)
            return F.when((F.size(so_far) < n) & (c["t"] - last <= tries) & far, F.concat(so_far, F.array(c))).otherwise(so_far)

        out = rows.withColumn("chosen", F.aggregate(candidates(F.col(key), lo, hi), chosen, take))
        return out.withColumn("failed", (F.size(chosen) < n) & (F.lit(hi - 1) - last_of(chosen) >= tries))

    rows = scenes.select(key, avoid, F.array().cast(CHOSEN).alias("chosen"), F.lit(False).alias("failed"))
    out = in_waves(rows, advance, (F.size(chosen) < n) & ~F.col("failed"), first=first, limit=n * tries, name="palettes")
    return out.select(key, "chosen", "failed")
