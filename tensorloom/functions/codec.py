"""Binary tensor columns: bfloat16 bytes, packed 4-bit floats and block scales."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sixteen numbers of the e2m1 format, low nibble first in a byte.
E2M1 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, -0.0, -0.5, -1.0, -1.5, -2.0, -3.0, -4.0, -6.0)


def bf16_codes(x: np.ndarray) -> np.ndarray:
    """bfloat16 codes of floats, rounded to nearest even; NaN stays NaN."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    bits = x.view(np.uint32).astype(np.uint64)
    codes = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
    codes[np.isnan(x)] = 0x7FC0
    return codes


@F.pandas_udf(T.BinaryType())
def bf16_bytes(values: pd.Series) -> pd.Series:
    """Little-endian bfloat16 bytes of an array of floats; the batch is converted as one array."""
    known = values.notna().to_numpy()
    arrays = [np.asarray(v, dtype=np.float32) for v in values[known]]
    data = bf16_codes(np.concatenate(arrays)).astype("<u2").tobytes() if arrays else b""
    ends = np.cumsum([0, *(2 * len(v) for v in arrays)])
    out = pd.Series([None] * len(values), dtype=object)
    out[known] = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bf16_values(data: pd.Series) -> pd.Series:
    """Floats of little-endian bfloat16 bytes; null for null or an odd number of bytes."""
    known = np.array([b is not None and len(b) % 2 == 0 for b in data], dtype=bool)
    chunks = list(data[known])
    floats = (np.frombuffer(b"".join(chunks), dtype="<u2").astype(np.uint32) << 16).view(np.float32)
    ends = np.cumsum([0, *(len(b) // 2 for b in chunks)])
    out = pd.Series([None] * len(data), dtype=object)
    out[known] = pd.Series([floats[a:b] for a, b in zip(ends, ends[1:], strict=False)], dtype=object).to_numpy()
    return out


def whole_tensor(n_vis: Column, data: Column, width: int = 4096) -> Column:
    """The record holds ``n_vis`` rows of ``width`` bfloat16 values."""
    return F.coalesce(F.length(data) == n_vis * width * 2, F.lit(False))


def e2m1_values(packed: Column, scale: Column) -> Column:
    """Two 4-bit floats of every byte value (0 .. 255) of an array, low nibble first, times ``scale``."""
    table = F.array(*[F.lit(x) for x in E2M1])
    pair = lambda b: F.array(F.element_at(table, (b.bitwiseAND(F.lit(15)) + 1).cast("int")), F.element_at(table, (F.shiftright(b, 4).bitwiseAND(F.lit(15)) + 1).cast("int")))
    return F.transform(F.flatten(F.transform(packed, pair)), lambda x: x * scale)


def exponent_scale(exponent: Column) -> Column:
    """Power-of-two scale of an 8-bit exponent."""
    return F.pow(F.lit(2.0), exponent - 127)


def block_scaled(values: Column, scales: Column, block: int) -> Column:
    """Every value times the scale of its block; the last block may be short."""
    return F.transform(values, lambda x, i: x * F.element_at(scales, (F.floor(i / block) + 1).cast("int")))


def block_scaled_2d(values: Column, scales: Column, columns: int, block_rows: int, block_columns: int) -> Column:
    """Row-major matrix of ``columns`` columns times the scale of each value's block; blocks at the edges may be cut.

    ``scales`` is the row-major grid of blocks, as many a row as cover the columns.
    """
    per_row = -(-columns // block_columns)
    place = lambda i: F.floor(F.floor(i / columns) / block_rows) * per_row + F.floor((i % columns) / block_columns) + 1
    return F.transform(values, lambda x, i: x * F.element_at(scales, place(i).cast("int")))
