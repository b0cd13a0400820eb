"""Numeric cleaning, rounding and binning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Plain decimal or exponent notation. Keeps out 'NaN', 'inf' and suffixed literals such as '1f'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(col: Column) -> Column:
    """Double value of a string column; anything that is not a finite number becomes NULL."""
    text = col.cast("string")
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def to_time(col: Column, fmt: str | None = None) -> Column:
    """Timestamp of a string column; unparsable text becomes NULL."""
    text = col.cast("string")
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else text.try_cast("timestamp")


def round_half_even(col: Column, digits: int = 2) -> Column:
    """Half-to-even rounding of the scaled value, which is how pandas rounds a frame."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def percent_difference(high: Column, low: Column) -> Column:
    """``(high - low) / low * 100``; NULL where ``low`` is zero."""
    return (high - low) / F.nullif(low, F.lit(0.0)) * 100


def interval_label(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval ``(lo, hi]`` that holds ``col``; NULL at or below the first edge."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (col > low) if high == float("inf") else (col > low) & (col <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """Boolean to 0/1."""
    return condition.cast("int")


def hash_fraction(*keys: Column) -> Column:
    """Stable number in [0, 1) from the md5 of the keys: 52 bits, exact in a double."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def total(cols: Sequence[Column]) -> Column:
    """Sum of several columns of one row."""
    return reduce(lambda a, b: a + b, cols)
