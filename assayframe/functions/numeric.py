"""Number parsing and rounding with the semantics screening files expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayframe.functions.text import strip

FLOAT_PATTERN = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
_WHOLE_FLOAT = rf"^{FLOAT_PATTERN}\z"
_WHOLE_INT = r"^[+-]?\d+\z"

# Veltkamp constant: splits a 53-bit significand into two halves.
_SPLIT = 134217729.0
_MAX_DIGITS = 7


def round_half_even(x: Column, digits: int) -> Column:
    """Round the *binary* value of a double to ``digits`` decimals, ties to even.

    Spark's ``round`` works on the shortest decimal text of a double and rounds
    halves up, so -2.9 / 16 becomes -0.1813 although the double lies nearer
    -0.1812. Here both halves of the value are compared with the midpoint
    separately, which is exact because twice the scale fits in 27 bits. All of
    it is double arithmetic and stays in generated code.
    """
    if digits == 0:
        return F.rint(x)
    if digits > _MAX_DIGITS:
        raise ValueError(f"at most {_MAX_DIGITS} digits")
    scale = float(10**digits)
    factor = F.lit(2.0 * scale)
    spread = x * F.lit(_SPLIT)
    high = spread - (spread - x)
    low = x - high
    below = F.floor(x * F.lit(scale)).cast("double")
    past = (high * factor - (below * 2.0 + 1.0)) + low * factor
    goes_up = (past > 0) | ((past == 0) & (below % 2.0 != 0))
    rounded = (below + goes_up.cast("double")) / F.lit(scale)
    return F.when(F.abs(x) < F.lit(2.0**50 / scale), rounded).otherwise(x)


def parse_float(text: Column) -> Column:
    """Double from text, null where the text is not a plain number.

    ``cast`` alone is too lenient (it takes ``1.0f``), and a failed one costs an
    exception per row, so a pattern looks first.
    """
    clean = strip(text)
    return F.when(clean.rlike(_WHOLE_FLOAT), clean.try_cast("double"))


def parse_int(text: Column) -> Column:
    """32-bit integer from text, null where the text is not an integer."""
    clean = strip(text)
    return F.when(clean.rlike(_WHOLE_INT), clean.try_cast("int"))
