"""Token-sequence layout: budgeting, masks and labels as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids of the test tokenizer and the label of ignored positions.
PAD, BOS, EOS, IGNORED = 0, 1, 2, -100


def char_tokens(text: Column) -> Column:
    """Tokens of the test tokenizer: code point modulo 900, plus 10; [10] for an empty or null text."""
    units = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c) % 900 + 10)
    return F.when(F.size(units) == 0, F.array(F.lit(10))).otherwise(units)


def budget(u: Column, a: Column, nv: Column, max_len: int) -> tuple[Column, Column]:
    """Question and answer trimmed to the length left, the answer first; each keeps one token at least."""
    left = F.lit(max_len) - nv - 2
    a = F.slice(a, 1, F.greatest(F.lit(1), left))
    return F.slice(u, 1, F.greatest(F.lit(1), left - F.size(a))), a


def _pad(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(F.lit(0), n).cast("int"))


def sequence_length(u: Column, a: Column, nv: Column) -> Column:
    return (F.lit(2) + nv + F.size(u) + F.size(a)).cast("int")


def input_ids(u: Column, a: Column, nv: Column, length: Column) -> Column:
    """BOS, nv placeholders, question, answer, EOS, padding up to ``length``."""
    return F.concat(F.array(F.lit(BOS)), _pad(PAD, nv), u, a, F.array(F.lit(EOS)), _pad(PAD, length - sequence_length(u, a, nv)))


def attention_mask(u: Column, a: Column, nv: Column, length: Column) -> Column:
    n = sequence_length(u, a, nv)
    return F.concat(_pad(1, n), _pad(0, length - n))


def labels(u: Column, a: Column, nv: Column, length: Column) -> Column:
    """Ignored everywhere but on answer and EOS."""
    n = sequence_length(u, a, nv)
    return F.concat(_pad(IGNORED, F.lit(1) + nv + F.size(u)), a, F.array(F.lit(EOS)), _pad(IGNORED, length - n))


def spliced(ids: Column, visual: Column, nv: Column) -> Column:
    """Positions 1 .. nv replaced by the visual values, row for row."""
    # by slices: a lambda would build ``visual`` anew for every position
    return F.concat(F.slice(ids, 1, 1), F.slice(visual, F.lit(1), nv), F.slice(ids, nv + 2, F.greatest(F.lit(0), F.size(ids) - nv - 1)))


def padded_visual(values: Column, nv: Column, most: Column, width: int) -> Column:
    """The ``nv * width`` values of a row's visual part, with zero rows up to ``most`` rows."""
    zeros = F.array_repeat(F.lit(0.0), (F.greatest(F.lit(0), most - nv) * width).cast("int"))
    return F.concat(F.slice(values, F.lit(1), F.greatest(F.lit(0), nv * width).cast("int")), zeros)
