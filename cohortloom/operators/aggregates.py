"""Group summaries. Every aggregate combines on the map side before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.errors import ContractError
from cohortloom.functions.conditions import is_blank
from cohortloom.functions.dates import PARTIAL_TOKEN
from cohortloom.operators.checks import Check, Watch
from cohortloom.operators.skew import running_total
from cohortloom.session import held

TOTAL = "Total"


def partial_tokens(df: DataFrame, column: str) -> DataFrame:
    """Distinct unknown-part tokens that occur in a text column."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit(PARTIAL_TOKEN), F.lit(0)))
    return df.select(found.alias("token")).distinct()


def reference_datetime(
    subjects: DataFrame, subject_key: str, sources: Sequence[tuple[DataFrame, str, Column]], pick: str, target: str
) -> DataFrame:
    """Earliest or latest date-time per subject over several tables, joined back to the subjects.

    A source is (table, subject column, comparable value). Both sides of the join have one row per
    subject, so no key is heavy.
    """
    if pick not in ("min", "max"):
        raise ContractError(f"unknown selection {pick!r}")
    best = F.min if pick == "min" else F.max
    # each source shrinks to one row per subject before the sources meet
    parts = [
        df.select(F.col(key).alias("__s"), value.alias("__v")).groupBy("__s").agg(best("__v").alias("__v"))
        for df, key, value in sources
    ]
    merged = reduce(DataFrame.unionByName, parts).groupBy("__s").agg(best("__v").alias(target))
    return subjects.join(merged, F.col(subject_key) == F.col("__s"), "left").drop("__s")


def _registered(population: DataFrame, group: str, registered: Sequence[str]) -> None:
    stray = population.filter(F.col(group).isNotNull() & ~F.col(group).isin(list(registered)))
    found = [r[0] for r in stray.select(group).distinct().limit(5).collect()]
    if found:
        raise ContractError(f"unregistered group: {', '.join(map(str, found))}")


def registered_counts(df: DataFrame, keys: Sequence[str], group: str, registered: Sequence[str], total: str) -> DataFrame:
    """Counts per key with one struct per registered group and the total, zero where nothing is found."""
    cells = [F.struct(F.lit(i).alias("group_order"), F.lit(g).alias("grp"),
                      F.coalesce(F.sum(F.when(F.col(group) == g, F.col("n"))), F.lit(0)).alias("n"))
             for i, g in enumerate(registered)]
    cells.append(F.struct(F.lit(len(registered)).alias("group_order"), F.lit(total).alias("grp"),
                          F.coalesce(F.sum(F.when(F.col(group) == total, F.col("n"))), F.lit(0)).alias("n")))
    wide = df.groupBy(*keys).agg(F.array(*cells).alias("cells"))
    return wide.select(*keys, F.inline("cells"))


def subject_counts(
    df: DataFrame, levels: Sequence[str], group: str, subject: str, registered: Sequence[str], total: str = TOTAL
) -> DataFrame:
    """Distinct subjects per level, for each registered group and overall, zero-filled.

    Subjects are made distinct per level and group first, so the later counts see each subject once
    per group. The total counts subjects, not group memberships. With no level there is one row per
    group also for an empty table.
    """
    seen = df.select(*levels, group, subject).filter(F.col(subject).isNotNull()).distinct()
    by_group = seen.groupBy(*levels, group).agg(F.count(F.lit(1)).alias("n"))
    overall = seen.select(*levels, subject).distinct().groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    both = by_group.unionByName(overall.withColumn(group, F.lit(total)))
    return registered_counts(both, levels, group, registered, total)


def denominators(
    population: DataFrame, group: str, subject: str, registered: Sequence[str], total: str = TOTAL, check: bool = True,
    watch: Watch | None = None,
) -> DataFrame:
    """Distinct subjects per registered group plus the total; an unregistered group is an error, with a ``watch`` when
    the result is written."""
    if check and watch is not None:
        stray = F.col(group).isNotNull() & ~F.col(group).isin(list(registered))
        population = watch.on(population, [Check("group", stray, F.col(group), "unregistered group")])
    elif check:
        _registered(population, group, registered)
    return subject_counts(population, [], group, subject, registered, total)


def exact_median(
    df: DataFrame, value: str, group: str, registered: Sequence[str]
) -> DataFrame:
    """Exact median per registered group without holding a group in one task.

    Equal values are counted first and written, so the table is read once; the running count over the distinct values, cut
    into pieces, then shows which value sits in the middle. The group sizes that are broadcast are one row per registered group.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(group).isin(list(registered)))
    counted = held(known.groupBy(group, value).agg(F.count(F.lit(1)).alias("__n")), "median")
    ranked = running_total(counted, [group], [value], "__upto", weight="__n")
    sizes = counted.groupBy(group).agg(F.sum("__n").alias("__size"))
    low = F.call_function("div", F.col("__size") + 1, F.lit(2))
    high = F.call_function("div", F.col("__size") + 2, F.lit(2))
    first = F.col("__upto") - F.col("__n") + 1
    holds_low = (first <= low) & (F.col("__upto") >= low)
    holds_high = (first <= high) & (F.col("__upto") >= high)
    middle = ranked.join(F.broadcast(sizes), group).filter(holds_low | holds_high)
    halves = F.max(F.when(holds_low, F.col(value))), F.max(F.when(holds_high, F.col(value)))
    return middle.groupBy(group).agg(((halves[0] + halves[1]) / 2).alias("median"))


def describe(
    df: DataFrame, value: str, group: str, registered: Sequence[str], total: str = TOTAL
) -> DataFrame:
    """N, mean, sample SD, exact median, minimum and maximum per registered group and overall.

    Nulls are ignored; the SD is null below two values.
    """
    x = df.select(F.col(value).cast("double").alias("x"), F.explode(F.array(F.col(group), F.lit(total))).alias("grp"))
    x = x.filter(F.col("grp").isin([*registered, total]))
    basic = x.groupBy("grp").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.when(F.count("x") >= 2, F.stddev_samp("x")).alias("sd"),
        F.min("x").alias("minimum"),
        F.max("x").alias("maximum"),
    )
    median = exact_median(x, "x", "grp", [*registered, total])
    # both sides have at most one row per registered group
    return basic.join(median, "grp", "left")


def category_counts(
    df: DataFrame, variables: Sequence[str], group: str, registered: Sequence[str], total: str = TOTAL, missing: str = "Missing"
) -> DataFrame:
    """Rows per variable, level and registered group; blanks form a last level, only when there are any.

    All variables are counted in one scan.
    """
    cells = []
    for v in variables:
        text = F.col(v).cast("string")
        blank = text.isNull() | (text == "")
        cells.append(F.struct(
            F.lit(v).alias("variable"), F.when(blank, missing).otherwise(text).alias("level"), F.when(blank, 1).otherwise(0).alias("is_missing")
        ))
    leveled = df.select(F.col(group).alias("__group"), F.inline(F.array(*cells)))
    keys = ["variable", "level", "is_missing"]
    counts = leveled.groupBy(*keys, "__group").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("__group", F.lit(total))
    return registered_counts(counts.unionByName(overall), keys, "__group", registered, total)


def partial_date_notes(df: DataFrame, domain: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct incomplete values of every date text column."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c.endswith("DTC")]
    cells = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*cells)))
    partial = ~is_blank(F.col("value")) & ~F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}(T.*)?$")
    return values.filter(partial).distinct().select(F.lit(domain).alias("domain"), "variable", "value")


def fd_violations(df: DataFrame, key: Sequence[str] | str, value: str) -> DataFrame:
    """Keys that map to more than one value; pairs are made distinct before they are counted."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = df.select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count(value).alias("n_values")).filter(F.col("n_values") > 1)


def issue_summary(issues: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("severity") == "ERROR")
    return issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        errors.alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.when(errors > 0, "failed").otherwise("passed").alias("result"),
    )


def issues_by_class(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_class").agg(F.count(F.lit(1)).alias("n"))


def row_text(df: DataFrame) -> Column:
    """A row as one text: each value with its length before it, a null as ``n``, so that no two rows share a text."""
    values = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.concat(*[F.when(v.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(v).cast("string"), F.lit(":"), v)) for v in values])


def manifest(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and a content checksum that does not depend on row order: sums of both halves of each row's md5."""
    digest = F.md5(row_text(df))
    halves = [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    checksum = F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in halves])
    return df.agg(
        F.lit(name).alias("dataset"),
        F.count(F.lit(1)).alias("records"),
        F.lit(len(df.columns)).alias("variables"),
        checksum.alias("checksum"),
    )


def offender_keys(df: DataFrame, key: Column | str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct offending keys, one a row, numbered in order within each group (``ordinal`` from 1)."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string").alias("offender")
    return running_total(df.select(*groups, k).distinct(), list(groups), ["offender"], "ordinal").select(*groups, "ordinal", "offender")


def offender_counts(df: DataFrame, key: Column | str, groups: Sequence[str] = ()) -> DataFrame:
    """How many distinct offending keys each group has (``n_keys``); no row where there is none."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string").alias("__k")
    counted = df.select(*groups, k).distinct().groupBy(*groups).agg(F.count("*").alias("n_keys"))
    return counted.where("n_keys > 0")
