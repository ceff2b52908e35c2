"""Pixels to patches with numpy: normalise, pad, cut and merge. Decoding and resampling need an image library and are not here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.geometry import PAD_TO, PATCH

_PATCHES = T.StructType().add("grid_h", T.LongType()).add("grid_w", T.LongType()).add("patches", T.ArrayType(T.FloatType()))


def patches_of(pixels: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Grid and patches of an RGB image ``[h, w, 3]`` of bytes: scaled to -1 .. 1, zeros to the right and below up to
    multiples of 28, patches of 3 x 14 x 14 row by row."""
    h, w, _ = pixels.shape
    gh, gw = (-(-n // PAD_TO) * PAD_TO // PATCH for n in (h, w))
    canvas = np.zeros((gh * PATCH, gw * PATCH, 3), dtype=np.float32)
    canvas[:h, :w] = pixels.astype(np.float32) / 127.5 - 1
    cut = canvas.reshape(gh, PATCH, gw, PATCH, 3).transpose(0, 2, 4, 1, 3)
    return gh, gw, cut.reshape(gh * gw, 3, PATCH, PATCH)


@F.pandas_udf(_PATCHES)
def image_patches(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """struct(grid_h, grid_w, patches) of raw RGB bytes; null fields where the bytes do not fill width x height."""
    rows = []
    for b, w, h in zip(data, width, height, strict=True):
        if b is None or pd.isna(w) or pd.isna(h) or min(w, h) < 1 or len(b) != 3 * int(w) * int(h):
            rows.append((None, None, None))
            continue
        gh, gw, cut = patches_of(np.frombuffer(b, dtype=np.uint8).reshape(int(h), int(w), 3))
        rows.append((gh, gw, cut.reshape(-1)))
    out = pd.DataFrame(rows, columns=["grid_h", "grid_w", "patches"])
    return out.astype({"grid_h": "Int64", "grid_w": "Int64"})


def merge_order(grid_h: Column, grid_w: Column) -> Column:
    """Positions (0-based) of a row-major grid in the order of its 2 x 2 groups: four neighbours stand together."""
    half = (grid_w / 2).cast("long")
    place = lambda k: (
        (F.floor(F.floor(k / 4) / half) * 2 + F.floor((k % 4) / 2)) * grid_w + F.pmod(F.floor(k / 4), half) * 2 + k % 2
    ).cast("long")
    return F.when((grid_h > 0) & (grid_w > 0), F.transform(F.sequence(F.lit(0), (grid_h * grid_w - 1).cast("int")), place)).otherwise(F.array().cast("array<bigint>"))


def merged(tokens: Column, grid_h: Column, grid_w: Column) -> Column:
    """Groups of four neighbouring tokens of a grid, row by row."""
    ordered = F.transform(merge_order(grid_h, grid_w), lambda p: F.element_at(tokens, (p + 1).cast("int")))
    groups = F.sequence(F.lit(0), (grid_h * grid_w / 4 - 1).cast("int"))
    return F.when(grid_h * grid_w > 0, F.transform(groups, lambda k: F.slice(ordered, k * 4 + 1, F.lit(4))))
