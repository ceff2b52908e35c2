"""Image-patch geometry on DOUBLE arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
PATCH = 14
MAX_PATCHES = 65536
MAX_SIDE = 7168
PAD_TO = 28
SCREEN_PIXELS = 300_000


def _scale(w: Column, h: Column) -> Column:
    patches = F.floor(w / PATCH) * F.floor(h / PATCH)
    fit = F.when(patches > 0, F.sqrt(F.lit(float(MAX_PATCHES)) / patches)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), fit, F.lit(float(MAX_SIDE)) / w, F.lit(float(MAX_SIDE)) / h)


def resized(w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height after scaling down: truncated, at most the longest side, at least one patch."""
    side = lambda n: F.greatest(F.lit(PATCH), F.least(F.lit(MAX_SIDE), F.floor(n * _scale(w, h)))).cast("long")
    return side(w), side(h)


def padded_side(n: Column) -> Column:
    """Next multiple of 28."""
    return n + F.pmod(F.lit(PAD_TO) - F.pmod(n, F.lit(PAD_TO)), F.lit(PAD_TO))


def grid(w: Column, h: Column) -> tuple[Column, Column]:
    """Rows and columns of patches after resizing and padding."""
    rw, rh = resized(w, h)
    return (padded_side(rh) / PATCH).cast("long"), (padded_side(rw) / PATCH).cast("long")


def token_count(w: Column, h: Column) -> Column:
    """Merged visual tokens: a quarter of the patches."""
    rows, columns = grid(w, h)
    return (rows * columns / 4).cast("long")


def patches_estimate(w: Column, h: Column) -> Column:
    """Patches without the floor of one patch per side: differs where a scaled side truncates to 0."""
    side = lambda n: padded_side(F.least(F.lit(MAX_SIDE), F.floor(n * _scale(w, h))).cast("long"))
    return F.greatest(F.lit(1), (side(w) / PATCH).cast("long") * (side(h) / PATCH).cast("long"))


def screen_size(w: Column, h: Column) -> tuple[Column, Column]:
    """Screen captures: scaled down to 300,000 pixels (truncated), then down to multiples of 28, at least 28."""
    scale = F.sqrt(F.lit(float(SCREEN_PIXELS)) / (w * h))
    side = lambda n: F.when(scale < 1, F.greatest(F.lit(1), F.floor(n * scale))).otherwise(n).cast("long")
    down = lambda n: F.greatest(F.lit(PAD_TO), (F.floor(side(n) / PAD_TO) * PAD_TO)).cast("long")
    return down(w), down(h)
