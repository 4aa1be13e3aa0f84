"""Per-subject sequence numbers, first-occurrence and baseline flags, duplicate rows, block formatting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.conditions import is_blank
from cohortloom.functions.dates import is_complete_date
from cohortloom.functions.numbers import decimals_needed, with_decimals
from cohortloom.operators.joins import repeated_keys
from cohortloom.operators.skew import flag_first, key_join, running_total

SUBJECT = ("STUDYID", "USUBJID")


def sequence(
    df: DataFrame,
    target: str,
    record_vars: Sequence[str],
    subject: Sequence[str] = SUBJECT,
    start_at: int = 1,
) -> DataFrame:
    """Number the rows of each subject in the order of ``record_vars``, nulls last."""
    order = [c for c in record_vars if c not in subject]
    return running_total(df, list(subject), order, target, None, start_at)


def first_occurrence(
    df: DataFrame,
    flags: Mapping[str, Sequence[str]],
    emergent: str = "TRTEMFL",
    order: Sequence[str] = ("ASTDT", "AESEQ"),
    row_key: Sequence[str] = (*SUBJECT, "AESEQ"),
) -> DataFrame:
    """``Y`` on the first emergent row of each group, one flag per grouping level (coarse to fine)."""
    return flag_first(df, flags, F.col(emergent) == "Y", order, row_key)


def baseline_flag(
    df: DataFrame,
    target: str,
    group: Sequence[str],
    date: str,
    reference: str,
    result: str,
    row_key: Sequence[str],
    visit: str | None = None,
    baseline_visits: Iterable[str] = (),
    timepoint: str | None = None,
    baseline_timepoints: Iterable[str] = (),
    status: str | None = None,
) -> DataFrame:
    """``Y`` on the last valid result of each subject and test before the reference date.

    Dates are ISO text. A row on the reference day counts only at a listed visit or time point. Rows
    with an incomplete date, a blank result or the status ``NOT DONE`` never count.
    """
    day, ref = F.substring(date, 1, 10), F.substring(reference, 1, 10)
    same_day = F.lit(False)
    if visit is not None and list(baseline_visits):
        same_day = same_day | F.col(visit).isin(list(baseline_visits))
    if timepoint is not None and list(baseline_timepoints):
        same_day = same_day | F.col(timepoint).isin(list(baseline_timepoints))
    valid = is_complete_date(F.col(date)) & is_complete_date(F.col(reference)) & ~is_blank(F.col(result))
    if status is not None:
        valid = valid & F.coalesce(F.col(status) != "NOT DONE", F.lit(True))
    before = (day < ref) | ((day == ref) & same_day)
    return flag_first(df, {target: list(group)}, valid & before, [date], row_key, last=True)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a key that occurs more than once, not only the later ones."""
    repeated = repeated_keys(df, keys).select(*keys)
    return key_join(df, repeated, list(keys), "left_semi", null_safe=True)


def common_decimals_text(
    df: DataFrame, value: str, block: str, target: str, blocks: Sequence[str] | None = None, most: int = 1
) -> DataFrame:
    """Text of rounded numbers with the decimals that the widest number of the block needs.

    The decimals of a block are one number, found by pre-aggregation. Where the blocks are known
    (``blocks``) that is one short row per listed block, which is broadcast; otherwise it is joined
    by shuffle.
    """
    need = df.groupBy(block).agg(F.max(decimals_needed(F.col(value), most)).alias("__decimals"))
    if blocks is not None:
        known = need.filter(F.col(block).isin(list(blocks)))
        joined = df.join(F.broadcast(known), block, "left")
    else:
        joined = key_join(df, need, [block], "left", null_safe=True)
    text = F.when(F.col(value).isNotNull(), with_decimals(F.col(value), F.col("__decimals")))
    return joined.withColumn(target, text).drop("__decimals")
