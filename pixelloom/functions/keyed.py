"""Draws that depend on their key alone: the same row gets the same numbers on every run and in every partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw is 48 bits of a sha-256, so that it is exact as a double; a hash holds five.
BITS = 48
PER_HASH = 5


def digest(*parts: Column) -> Column:
    """Hash of the parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def whole(hashed: Column, k: int = 0) -> Column:
    """The ``k``-th 48-bit number of a hash."""
    return F.conv(F.substring(hashed, 1 + 12 * k, 12), 16, 10).cast("long")


def share(hashed: Column, k: int = 0) -> Column:
    """The ``k``-th draw of a hash in [0, 1)."""
    return whole(hashed, k) / float(2**BITS)


def pick(hashed: Column, n: Column, k: int = 0) -> Column:
    """A number from 0 to n - 1."""
    return F.floor(share(hashed, k) * n).cast("int")


def shuffled(index: Column, size: Column, key: Column, rounds: int = 4) -> Column:
    """Place of ``index`` (from 0) in a permutation of [0, size) that ``key`` selects: a Feistel network, walked until it is in range.

    Distinct indices of a key get distinct places, which is sampling without replacement without a sort or a window.
    """
    side = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double")) / 2)).cast("long")

    def walk(given: Column) -> Column:
        wide, most, name = given["side"], given["size"], given["key"]

        def turn(at: Column, r: Column) -> Column:
            """One round over [0, side x side): the halves change places, and one is moved by a hash of the other, so that it can be undone."""
            left, right = F.floor(at / wide).cast("long"), at % wide
            return right * wide + (left + whole(digest(name, r, right)) % wide) % wide

        once = lambda at: F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), at, turn)
        # The network permutes at most 4 x size numbers, so a pass ends outside of the range with a probability of at most 3/4.
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), once(given["index"]), lambda at, _: F.when(at < most, at).otherwise(once(at)))

    given = F.struct(index.cast("long").alias("index"), size.cast("long").alias("size"), side.alias("side"), key.cast("string").alias("key"))
    return F.transform(F.array(given), walk)[0]


# -- the same as SQL text for oracles ---------------------------------------------------------------

def sql_digest(*parts: str) -> str:
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


def sql_whole(hashed: str, k: int = 0) -> str:
    return f"CONCAT('0x', substr({hashed}, {1 + 12 * k}, 12))::BIGINT"


def sql_share(hashed: str, k: int = 0) -> str:
    return f"({sql_whole(hashed, k)} / {float(2**BITS)!r}::DOUBLE)"
