"""Scalar column functions: safe arithmetic, rounding, text, hashes and bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding, the one rule by which results of doubles are compared; a negative zero becomes zero."""
    return F.round(x, digits) + F.lit(0.0)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def strictly_above(score: Column, threshold: Column) -> Column:
    """The flag: equality is never flagged, nor is a score that isn't a finite number."""
    return F.coalesce(is_finite(score) & (score > threshold), F.lit(False))


def outcome(positive: Column, flagged: Column) -> Column:
    return F.when(positive & flagged, "TP").when(positive, "FN").when(flagged, "FP").otherwise("TN")


def piped(*flags: tuple[Column, str], otherwise: str = "") -> Column:
    """Names of the flags that hold, joined by a pipe; ``otherwise`` where none holds."""
    text = F.concat_ws("|", *[F.when(c, F.lit(name)) for c, name in flags])
    return F.when(text == "", F.lit(otherwise)).otherwise(text)


def labels_of(text: Column) -> Column:
    """A comma-separated list of labels as a trimmed array; null if one is empty, reserved or given twice."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    bad = F.exists(parts, lambda p: (p == "") | (p == "normal")) | (F.size(F.array_distinct(parts)) < F.size(parts))
    return F.when(~bad, parts)


def identity(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of values joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def packed_bits(flags: Column) -> Column:
    """An array of up to 64 booleans as a signed 64-bit pattern, the first at the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(F.when(f, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def chebyshev(dy: Column, dx: Column) -> Column:
    return F.greatest(F.abs(dy), F.abs(dx))
