"""What charts wear: words that don't repeat within a chart, titles, magnitudes, themes; all drawn by key, without collecting a chart."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import color, keyed

LETTERS = string.ascii_letters
SHORTEST, LONGEST, MOST_WORDS = 3, 8, 3
MAGNITUDES = (-3, 3)


def spelled(place: Column, length: Column) -> Column:
    """The ``place``-th word of ``length`` letters."""
    base = len(LETTERS)
    power = lambda k: F.element_at(F.array(*(F.lit(base**n).cast("long") for n in range(LONGEST))), k + 1)
    letter = lambda k: F.substring(F.lit(LETTERS), (F.floor(place / power(k)) % base + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(length - 1, F.lit(0)), letter), "")


def distinct_word(key: Column, index: Column) -> Column:
    """A word of 3 to 8 letters; different indices of a key get different words.

    The length is drawn for each index, evenly; the word is the index's place in a permutation of all words of that length.
    """
    length = keyed.pick(keyed.digest(key, index), F.lit(LONGEST - SHORTEST + 1)) + SHORTEST

    def word(n: Column) -> Column:
        size = F.element_at(F.array(*(F.lit(len(LETTERS) ** k).cast("long") for k in range(SHORTEST, LONGEST + 1))), n - SHORTEST + 1)
        place = keyed.shuffled(index, size, F.concat_ws("|", key.cast("string"), n.cast("string")))
        # The place is bound, as every letter reads it.
        return F.transform(F.array(place), lambda p: spelled(p, n))[0]

    return F.transform(F.array(length), word)[0]


def title(key: Column, index: Column) -> Column:
    """One to three words; the first is ``distinct_word``, so that a key's titles differ."""
    more = keyed.pick(keyed.digest(key, F.lit("words"), index), F.lit(MOST_WORDS))
    others = [F.when(more >= k, distinct_word(F.concat_ws("|", key.cast("string"), F.lit(f"word {k}")), index)) for k in range(1, MOST_WORDS)]
    return F.concat_ws(" ", distinct_word(key, index), *others)


def magnitude(key: Column) -> Column:
    """A power of ten, every exponent with equal chance."""
    lo, hi = MAGNITUDES
    return F.pow(F.lit(10.0), keyed.pick(keyed.digest(key, F.lit("magnitude")), F.lit(hi - lo + 1)) + lo)


def theme(key: Column) -> tuple[Column, Column]:
    """Background and text colours as ``#RRGGBB``: three in ten are light on dark."""
    h = keyed.digest(key, F.lit("theme")), keyed.digest(key, F.lit("text"))
    dark = keyed.share(h[0], 3) < 0.3
    level = lambda v: F.floor(v * 255 + 0.5)
    ground = [level(keyed.share(h[0], k) * 0.35 + F.when(dark, 0.0).otherwise(0.6)) for k in range(3)]
    ink = [level(keyed.share(h[1], k) * 0.3 + F.when(dark, 0.7).otherwise(0.0)) for k in range(3)]
    return color.hex_color(*ground), color.hex_color(*ink)
