"""Columns over sequences and base qualities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reverse_complement(seq: Column) -> Column:
    """Upper-case A, C, G and T are complemented, all else is only reversed."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def reverse_quality(qual: Column) -> Column:
    """Qualities (text or array) for the reversed sequence."""
    return F.reverse(qual)


def phred_to_log10(char: Column) -> Column:
    """log10 of the error probability of one Phred+33 character."""
    return (F.ascii(char) - 33) / F.lit(-10.0)


def phreds_to_log10(qual: Column) -> Column:
    """log10 of each error probability of a text; null gives an empty array. A step over an array costs microseconds for each
    character, so whole batches are changed at once, in Arrow."""
    return _phreds_to_log10(qual)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, items) of a list array, whose nulls are empty; the offsets begin at 0."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(values), 0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), values.flatten().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _phreds_to_log10(qual: pa.Array) -> pa.Array:
    qual = pc.fill_null(qual, "")
    sizes = np.asarray(pc.utf8_length(qual), np.int64)
    codes = np.frombuffer("".join(qual.to_pylist()).encode("utf-32-le"), "<u4")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((codes.astype(float) - 33) / -10.0))


def log10_to_phred(p: Column) -> Column:
    """The Phred+33 character; truncated and kept within ``!`` and ``~``."""
    code = p * -10 + 33
    return F.char(F.least(F.greatest(code, F.lit(33.0)), F.lit(126.0)).cast("int"))


def log10s_to_phred(ps: Column) -> Column:
    """The text of an array of numbers, in batches as above; null gives null, a null item the lowest character."""
    return _log10s_to_phred(ps)


@F.arrow_udf(T.StringType())
def _log10s_to_phred(ps: pa.Array) -> pa.Array:
    offsets, p = _flat(ps)
    code = np.where(np.asarray(pc.is_valid(ps.flatten())), p, 0.0) * -10 + 33
    # NaN is above all numbers
    code = np.minimum(np.maximum(np.where(np.isnan(code), 126.0, code), 33.0), 126.0).astype(np.uint8)
    text = code.tobytes().decode("ascii")
    return pa.array([text[a:b] if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), pc.is_valid(ps).to_pylist())], pa.string())
