"""Numbers: strict parsing, decimal rounding, fixed-point text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.conditions import is_blank

SIGNIFICANT_DIGITS = 7  # digits shown when a block of numbers is printed


def strict_number(text: Column) -> Column:
    """The number a text spells, null when it spells none."""
    return text.try_cast("double")


def not_a_number(text: Column) -> Column:
    """True for non-blank text that is not a number."""
    return ~is_blank(text) & strict_number(text).isNull()


def round_half_even(x: Column, digits: int | Column) -> Column:
    """Round to the nearer of the two neighbouring decimals, ties to the even one.

    The distances are measured on the stored binary values, so 0.15 goes to 0.1 (it is stored a
    little below the tie) and 2.5 goes to 2.
    """
    scale = F.lit(10.0 ** digits) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)
    scaled = x * scale
    low = F.floor(scaled).cast("double")
    below, above = low / scale, F.ceil(scaled).cast("double") / scale
    to_below, to_above = x - below, above - x
    down = (to_below < to_above) | ((to_below == to_above) & (F.pmod(low, F.lit(2.0)) == 0))
    return F.when(x.isNotNull(), F.when(down, below).otherwise(above))


def linear_convert(x: Column, multiplier: Column, offset: Column, digits: Column) -> Column:
    return round_half_even(x * multiplier + offset, digits)


def one_decimal(x: Column) -> Column:
    """Text with one decimal, rounded half-even on the exact binary value.

    The fraction of a double is a multiple of 2**-59 for every value that can round to something
    other than 0.0, so it is taken as a 59-bit integer and the tie is decided in integers.
    """
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    fraction = F.floor((size - whole) * F.lit(2.0**59)).cast("bigint") * F.lit(10)
    unit, half = F.lit(2**59), F.lit(2**58)
    tenth = F.shiftright(fraction, 59)
    rest = fraction - tenth * unit
    tenths = whole * F.lit(10) + tenth
    up = (rest > half) | ((rest == half) & (F.pmod(tenths, F.lit(2)) == 1))
    tenths = tenths + F.when(up, F.lit(1)).otherwise(F.lit(0))
    last = F.pmod(tenths, F.lit(10))
    before = F.call_function("div", tenths, F.lit(10))
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, before.cast("string"), F.lit("."), last.cast("string"))


def count_percent(count: Column, denominator: Column) -> Column:
    """``n (p%)`` with one decimal, ``n (NA)`` where there is no denominator."""
    share = F.lit(100.0) * count / F.when(denominator != 0, denominator)
    n = count.cast("bigint").cast("string")
    return F.when(denominator.isNull() | (denominator == 0), F.concat(n, F.lit(" (NA)"))).otherwise(
        F.concat(n, F.lit(" ("), one_decimal(share), F.lit("%)"))
    )


def decimals_needed(x: Column, most: int = 1) -> Column:
    """Decimals that ``x`` needs when it is shown with seven significant digits, ``most`` at most."""
    size = F.abs(x)
    whole_digits = F.greatest(F.length(F.floor(size).cast("string")), F.lit(1))
    room = F.greatest(F.lit(SIGNIFICANT_DIGITS) - whole_digits, F.lit(0))
    needed = F.lit(0)
    for d in range(1, most + 1):
        shown = F.bround(size, d)
        needed = F.when((room >= d) & (shown != F.bround(size, d - 1)), F.lit(d)).otherwise(needed)
    return needed


def with_decimals(x: Column, decimals: Column) -> Column:
    """Text of a rounded number with the given number of decimals (0 or more)."""
    longer = F.call_function("format_string", F.concat(F.lit("%."), decimals.cast("string"), F.lit("f")), x)
    return (
        F.when(decimals == 0, F.bround(x, 0).cast("bigint").cast("string"))
        .when(decimals == 1, one_decimal(x))
        .otherwise(longer)
    )
