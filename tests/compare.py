"""Rows of a frame and of an oracle in a comparable form."""

import math


def value(v):
    if v is None or type(v).__name__ == "NAType":
        return ("null",)
    if type(v).__name__ in ("bool", "bool_"):
        return ("bool", bool(v))
    if isinstance(v, str):
        return ("str", v)
    try:
        f = float(v)
        return ("null",) if math.isnan(f) else ("num", round(f, 9))
    except (TypeError, ValueError):
        return ("str", str(list(v)))


def rows(frame):
    return sorted((tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)
