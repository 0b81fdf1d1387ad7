"""Comparing rows of two engines."""

from __future__ import annotations

import math


def canonical(rows, columns):
    """Rows as sorted tuples of text, floats rounded, so two engines compare."""
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__module__ in ("numpy", "decimal"):
            return repr(round(float(v), 9) + 0.0)
        return str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)
