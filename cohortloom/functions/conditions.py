"""Predicates and conditional values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.errors import ContractError


def is_blank(c: Column) -> Column:
    """Null, or text with nothing but spaces. Other types are only tested for null."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def condition(variable: Column, operator: str, compare_to=None) -> Column:
    """One of five comparisons on the text of ``variable``; anything else is refused."""
    text = variable.cast("string")
    if operator == "equals":
        return text == F.lit(str(compare_to))
    if operator == "not_equals":
        return text != F.lit(str(compare_to))
    if operator == "in":
        return F.coalesce(text.isin([str(v) for v in compare_to]), F.lit(False))
    if operator == "is_missing":
        return is_blank(variable)
    if operator == "not_missing":
        return ~is_blank(variable)
    raise ContractError(f"unknown condition operator {operator!r}")


def conditional_assign(when: Column, value, else_value=None) -> Column:
    """``value`` where the condition is true; false and unknown both take ``else_value``."""
    return F.when(when, F.lit(value)).otherwise(F.lit(else_value))


def ongoing_flag(
    end_date: Column, indicator: Column | None = None, affirmative: Iterable[str] = ("Y", "Yes"), value: str = "ONGOING"
) -> Column:
    """Flag rows without an end date, or whose indicator says that they go on."""
    ongoing = is_blank(end_date)
    affirmative = list(affirmative)
    if indicator is not None and affirmative:
        ongoing = ongoing | F.coalesce(indicator.isin(affirmative), F.lit(False))
    return F.when(ongoing, F.lit(value))
