"""Dates: ISO text with partial precision, study days, the treatment window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.errors import ContractError
from cohortloom.functions.conditions import is_blank

UNKNOWN_TOKENS = ("UN", "UNK")
COMPLETE = r"^\d{4}-\d{2}-\d{2}"
ISO_SHAPE = r"^\d{4}(-\d{2}(-\d{2}(T.*)?)?)?$"
PARTIAL_TOKEN = r"(?i)UNK|\bUN\b"

# English month abbreviations in calendar order.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# Registered date and time formats, as the order of their parts. ``mmm`` is a month name.
DATE_FORMATS = {
    "m/d/y": ("m", "d", "y"),
    "d/m/y": ("d", "m", "y"),
    "d-m-y": ("d", "m", "y"),
    "dd-mmm-yyyy": ("d", "mmm", "y"),
    "y-m-d": ("y", "m", "d"),
}
TIME_FORMATS = {"H:M": ("H", "M"), "H:M:S": ("H", "M", "S")}


def has_partial_token(c: Column) -> Column:
    return c.rlike(PARTIAL_TOKEN)


_MARK = "\u0001"  # starts a text that the format has read
_SHAPES = {"y": r"\d{4}", "mmm": "[A-Z]{3}"}


def _normal(c: Column, fmt: str, unknown: Iterable[str] = ()) -> Column:
    """``y-m-d`` or ``H:M[:S]`` with two-digit parts and ``-`` for unknown ones; null when unreadable.

    A chain of string steps, each used once: put the parts in order, month names to numbers, pad,
    unknown words to ``-``, and a last check of the shape.
    """
    order = DATE_FORMATS.get(fmt) or TIME_FORMATS.get(fmt)
    if order is None:
        raise ContractError(f"unknown date or time format {fmt!r}")
    is_time = fmt in TIME_FORMATS
    words = "|".join(sorted({w.upper() for w in unknown}, key=lambda w: (-len(w), w)))
    pieces = [f"({_SHAPES.get(p, chr(92) + 'd{1,2}')}{'|' + words if words else ''})" for p in order]
    wanted = [p for p in ("H", "M", "S") if p in order] if is_time else ["y", "mmm" if "mmm" in order else "m", "d"]
    sep = ":" if is_time else "-"
    pattern = "^" + ("[:]" if is_time else "[/-]").join(pieces) + "$"
    text = F.regexp_replace(F.upper(F.trim(c)), pattern, _MARK + sep.join(f"${order.index(p) + 1}" for p in wanted))
    if "mmm" in order:
        for number, name in enumerate(MONTHS, start=1):
            text = F.replace(text, F.lit(f"-{name}-"), F.lit(f"-{number:02d}-"))
    text = F.regexp_replace(text, rf"(?<=[-:{_MARK}])(\d)(?=[-:]|$)", "0$1")
    if words:
        text = F.regexp_replace(text, words, "-")
    two = r"(?:\d{2}|-)"
    shape = sep.join([two] * len(wanted)) if is_time else rf"(?:\d{{4}}|-)-{two}-{two}"
    return F.nullif(F.regexp_extract(text, f"^{_MARK}({shape})$", 1), F.lit(""))


def iso_date_text(c: Column, formats: Iterable[str]) -> Column:
    """ISO text of a complete, real calendar date in one of the formats; null when none reads it."""
    read = [F.date_format(F.try_to_date(_normal(c, fmt), "yyyy-MM-dd"), "yyyy-MM-dd") for fmt in formats]
    return F.coalesce(*read)


def unreadable_date(c: Column, converted: Column) -> Column:
    """Violation of a complete-date conversion: an unknown token, or text that no format reads."""
    return c.isNotNull() & (has_partial_token(c) | converted.isNull())


def only_time(c: Column) -> Column:
    """True for text that starts like a time; a time alone never makes a date-time."""
    return c.rlike(r"^\d{1,2}:\d{2}")


def iso_datetime_text(
    date: Column, formats: list[str], time: Column | None = None, unknown: Iterable[str] = UNKNOWN_TOKENS
) -> Column:
    """ISO text of a date, with the time of day appended when it is known."""
    return iso_partial_text(date, formats, time, unknown)


def iso_partial_text(
    date: Column, formats: list[str], time: Column | None = None, unknown: Iterable[str] = UNKNOWN_TOKENS
) -> Column:
    """ISO text that keeps the known precision and fills in nothing.

    An unknown part becomes ``-``; unknown parts at the end are cut off, so ``UNK-JAN-2025`` gives
    ``2025-01`` while a known day under an unknown month stays as ``2025---15``.
    """
    unknown = list(unknown)
    date_format = formats[0]
    time_format = formats[1] if len(formats) > 1 else None
    if time is None and " " in date_format:
        # one column that holds both parts
        date_format, time_format = date_format.split(" ", 1)
        pieces = F.split(F.trim(date), r"[ T]", 2)
        date, time = pieces[0], F.try_element_at(pieces, F.lit(2))
    elif (time is None) != (time_format is None):
        raise ContractError("one format per source column is needed")
    text = _normal(date, date_format, unknown)
    if time is not None:
        clock = F.concat(F.lit("T"), _normal(time, time_format, unknown))
        text = F.concat(text, F.when(is_blank(time), F.lit("")).otherwise(clock))
    # unknown parts at the end, and the marks between them
    return F.nullif(F.regexp_replace(text, r"(-*T-(:-)*|(:-)+|-+)$", ""), F.lit(""))


def is_complete_date(c: Column) -> Column:
    return F.coalesce(c.rlike(COMPLETE), F.lit(False))


def iso_to_date(dtc: Column) -> Column:
    """A date from ISO text: the time is dropped, partial dates are null, nothing is filled in."""
    return F.when(is_complete_date(dtc), F.try_to_date(F.substring(dtc, 1, 10), "yyyy-MM-dd"))


def iso_valid(c: Column) -> Column:
    """Blank, or ISO shaped and (when complete) a real calendar date."""
    real = ~is_complete_date(c) | F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull()
    return is_blank(c) | (c.rlike(ISO_SHAPE) & real)


def study_day(day: Column, reference: Column) -> Column:
    """Days from the reference with no day 0: the reference day is 1, the day before is -1."""
    gap = F.datediff(day, reference)
    return F.when(gap >= 0, gap + 1).otherwise(gap)


def duration_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def treatment_emergent(start: Column, end: Column, first_dose: Column, last_dose: Column, window_days: int) -> Column:
    """``Y`` for an event that starts from first dose to ``window_days`` after last dose.

    Rules in order: no first dose gives null; an end before first dose gives null; an unknown start
    counts as emergent; then the window decides. Without a last dose nothing is inside the window.
    """
    inside = (start >= first_dose) & (start <= F.date_add(last_dose, window_days))
    return (
        F.when(first_dose.isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(end < first_dose, F.lit(False)), F.lit(None).cast("string"))
        .when(start.isNull(), F.lit("Y"))
        .when(inside, F.lit("Y"))
    )


def planned_population_flag(planned_arm: Column) -> Column:
    return F.when(planned_arm.isNotNull() & (planned_arm != ""), "Y").otherwise("N")


def dosed_population_flag(first_dose: Column) -> Column:
    return F.when(first_dose.isNotNull(), "Y").otherwise("N")
