"""Seeded pseudo-random keys that are a pure function of the row.

A retried task must draw the same numbers again, so no ``rand()``: every random choice
comes from an MD5 digest of seed, purpose and row key.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_key(seed: int, purpose: str, *ids: Column) -> Column:
    """Uniform 32-digit hex key; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[c.cast("string") for c in ids]))


def half_key(seed: int, *ids: Column) -> Column:
    """Uniform 8-digit hex key of a row, compared as text."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids])), 1, 8)


# One digest serves several draws: 24 random bits each, the resolution of a 32-bit float.
DRAW_DIGITS = 6
DRAWS_PER_DIGEST = 5


def draw_digest(seed: int, num_samples: int, *ids: Column) -> Column:
    """Hex text holding the random numbers of all draws of a row."""
    blocks = range(-(-num_samples // DRAWS_PER_DIGEST))
    keys = [c.cast("string") for c in ids]
    return F.concat(*[F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(b)), *keys)) for b in blocks])


def draw_number(digest: Column, draw: Column | int) -> Column:
    """Random number of one draw as hex text, compared with :func:`share_bound`."""
    draw = F.lit(draw) if isinstance(draw, int) else draw
    block = F.floor(draw / DRAWS_PER_DIGEST).cast("int")
    start = block * 32 + (draw - block * DRAWS_PER_DIGEST) * DRAW_DIGITS + 1
    return F.substr(digest, start, F.lit(DRAW_DIGITS))


def share_bound(share: float) -> str:
    """Hex text below which a share ``share`` of all draw numbers lies."""
    top = 16**DRAW_DIGITS
    bound = int(-(-share * top // 1))
    return "g" if bound >= top else format(bound, f"0{DRAW_DIGITS}x")
