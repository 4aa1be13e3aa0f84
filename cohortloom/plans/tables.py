"""Summary tables in long form (one row per cell) and in display form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.numbers import count_percent, one_decimal
from cohortloom.operators.aggregates import TOTAL, category_counts, denominators, describe
from cohortloom.operators.reshape import table_wide
from cohortloom.operators.rules import union_all

STATISTICS = ["N", "Mean", "Standard deviation", "Median", "Minimum", "Maximum"]
OVERALL = "At least one treatment-emergent adverse event"
CATEGORIES = {"SEX": "Sex", "RACE": "Race", "ETHNIC": "Ethnicity"}


def population(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose population flag is ``Y``."""
    return df.filter(F.col(flag) == "Y")


def _statistic_cells(summary: DataFrame) -> DataFrame:
    """Six display rows per group; a figure that does not exist shows as NA."""
    shown = [F.col("n").cast("string")] + [
        F.coalesce(one_decimal(F.col(c)), F.lit("NA")) for c in ("mean", "sd", "median", "minimum", "maximum")
    ]
    cells = [
        F.struct(F.lit(i).alias("row"), F.lit(name).alias("Statistic"), value.alias("display"))
        for i, (name, value) in enumerate(zip(STATISTICS, shown, strict=True))
    ]
    return summary.select("grp", F.inline(F.array(*cells)))


def demographic_cells(
    adsl: DataFrame, arms: Sequence[str], arm: str = "TRT01P", flag: str = "ITTFL", subject: str = "USUBJID",
    numeric: tuple[str, str] = ("AGE", "Age (years)"), categories: Mapping[str, str] = CATEGORIES,
    check: bool = True,
) -> DataFrame:
    """T14.1.1 as cells: section, row order, parameter, statistic, group, display text.

    Sections are numbered in display order, levels inside a section sort by text with Missing last.
    """
    people = population(adsl, flag)
    groups = denominators(people, arm, subject, arms, check=check).select("grp", F.col("n").alias("denominator"))
    summary = describe(people, numeric[0], arm, arms)
    # registered groups without a subject still get a column
    every = groups.select("grp").join(summary, "grp", "left").fillna({"n": 0})
    parts = [
        _statistic_cells(every).select(
            F.lit(0).alias("section"), F.col("row").alias("is_missing"), F.lit("").alias("level"),
            F.lit(numeric[1]).alias("title"), "Statistic", "grp", "display",
        )
    ]
    if categories:
        counts = category_counts(people, list(categories), arm, arms).join(F.broadcast(groups), "grp")
        names = list(categories)
        place = F.array_position(F.array(*[F.lit(v) for v in names]), F.col("variable")).cast("int")
        title = F.array(*[F.lit(categories[v]) for v in names])[place - 1]
        parts.append(counts.select(
            place.alias("section"), "is_missing", "level", title.alias("title"), F.concat(F.lit("  "), "level").alias("Statistic"), "grp",
            count_percent(F.col("n"), F.col("denominator")).alias("display"),
        ))
    return union_all(parts)


def demographic_table(cells: DataFrame, groups: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Display form: the section title stands in the first row of its section only.

    The table has one row per statistic and level, so numbering its rows inside a section is cheap.
    """
    columns = [*arms, TOTAL]
    wide = table_wide(cells, ["title", "Statistic"], "grp", "display", columns, ["section", "is_missing", "level"])
    first = F.row_number().over(Window.partitionBy("section").orderBy("is_missing", "level")) == 1
    shown = wide.withColumn("Parameter", F.when(first, F.col("title")).otherwise(""))
    ordered = shown.orderBy("section", "is_missing", "level")
    return with_headers(ordered, ["Parameter", "Statistic"], groups, columns)


def with_headers(df: DataFrame, lead: Sequence[str], groups: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Name the group columns ``name (N=n)``; ``groups`` has one row per registered group."""
    sizes = {r["grp"]: r["n"] for r in groups.select("grp", "n").collect()}
    return df.select(*lead, *[F.col(f"`{c}`").alias(f"{c} (N={sizes[c]})") for c in columns])


def event_counts(
    adae: DataFrame, arms: Sequence[str], arm: str = "TRTA", subject: str = "USUBJID", soc: str = "AEBODSYS", pt: str = "AEDECOD",
    population_flag: str = "SAFFL",
) -> DataFrame:
    """Distinct flagged subjects overall, per class and per class and term, for each group, zero-filled.

    The event table is read once: a row stands for up to three levels, by its first-occurrence
    flags. Subjects are made distinct per level and group, and both the group and the total counts
    come from that. ``shown_n`` counts the subjects whose flagged row is emergent and in the safety
    population; it is null where there is none.
    """
    none = F.lit(None).cast("string")
    shown = F.coalesce((F.col(population_flag) == "Y") & (F.col("TRTEMFL") == "Y"), F.lit(False))

    def level(n: int, flag: str, of_class, of_term):
        return F.when(F.col(flag) == "Y", F.struct(F.lit(n).alias("lvl"), of_class.alias(soc), of_term.alias(pt)))

    levels = F.array_compact(F.array(
        level(0, "AOCCFL", none, none), level(1, "AOCCSFL", F.col(soc), none), level(2, "AOCCPFL", F.col(soc), F.col(pt))
    ))
    rows = adae.select(F.col(arm).alias("__arm"), F.col(subject).alias("__subject"), shown.alias("__shown"), F.inline(levels))
    keys = ["lvl", soc, pt]
    seen = rows.filter(F.col("__subject").isNotNull()).groupBy(*keys, "__arm", "__subject").agg(F.bool_or("__shown").alias("__shown"))
    by_arm = seen.groupBy(*keys, "__arm").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("shown"))
    everyone = seen.groupBy(*keys, "__subject").agg(F.bool_or("__shown").alias("__shown"))
    overall = everyone.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("__shown").alias("shown"))
    both = by_arm.unionByName(overall.withColumn("__arm", F.lit(TOTAL)))
    cells = [
        F.struct(F.lit(i).alias("group_order"), F.lit(g).alias("grp"), F.coalesce(F.sum(F.when(F.col("__arm") == g, F.col("n"))), F.lit(0)).alias("n"))
        for i, g in enumerate([*arms, TOTAL])
    ]
    wide = both.groupBy(*keys).agg(F.array(*cells).alias("cells"), F.max("shown").alias("shown"))
    found = wide.select(*keys, F.when(F.col("shown") > 0, F.col("shown")).alias("shown_n"), F.inline("cells"))
    return _with_overall_row(found, adae, arms, soc, pt)


def _with_overall_row(found: DataFrame, adae: DataFrame, arms: Sequence[str], soc: str, pt: str) -> DataFrame:
    """The overall row exists also when no event is flagged, with zero in each group."""
    none = F.lit(None).cast("string")
    zero = F.inline(F.array(*[
        F.struct(F.lit(i).alias("group_order"), F.lit(g).alias("grp"), F.lit(0).cast("bigint").alias("n")) for i, g in enumerate([*arms, TOTAL])
    ]))
    one = adae.sparkSession.range(1).select(F.lit(0).alias("lvl"), none.alias(soc), none.alias(pt), F.lit(None).cast("bigint").alias("shown_n"), zero)
    grouped = found.unionByName(one).groupBy("lvl", soc, pt, "group_order", "grp")
    return grouped.agg(F.max("shown_n").alias("shown_n"), F.max("n").alias("n"))


def event_cells(
    adsl: DataFrame, adae: DataFrame, arms: Sequence[str], subject_arm: str = "TRT01A", flag: str = "SAFFL",
    arm: str = "TRTA", subject: str = "USUBJID", soc: str = "AEBODSYS", pt: str = "AEDECOD", check: bool = True,
) -> DataFrame:
    """T14.3.1 as cells with sort keys: classes by total count, terms by total count inside their class.

    Which classes and terms are shown is decided on emergent rows of the safety population, the
    counts in the cells on the first-occurrence flags. Behind the counts there are as many rows as
    the vocabulary has entries.
    """
    groups = denominators(population(adsl, flag), subject_arm, subject, arms, check=check)
    counts = event_counts(adae, arms, arm, subject, soc, pt, flag)
    same_class = Window.partitionBy(soc)
    ranked = counts.withColumns({
        "soc_n": F.when(F.col("lvl") > 0, F.max(F.when(F.col("lvl") == 1, F.col("shown_n"))).over(same_class)),
        "pt_n": F.when(F.col("lvl") == 2, F.col("shown_n")),
    })
    kept = ranked.filter(
        (F.col("lvl") == 0) | (F.col("soc_n").isNotNull() & ((F.col("lvl") == 1) | F.col("pt_n").isNotNull()))
    )
    text = (
        F.when(F.col("lvl") == 0, OVERALL).when(F.col("lvl") == 1, F.col(soc)).otherwise(F.concat(F.lit("  "), F.col(pt)))
    )
    denominator = groups.select("grp", F.col("n").alias("denominator"))
    return kept.join(F.broadcast(denominator), "grp").select(
        "lvl", soc, pt, "soc_n", "pt_n", text.alias("Parameter"), "group_order", "grp", "n",
        count_percent(F.col("n"), F.col("denominator")).alias("display"),
    )


def event_table(cells: DataFrame, groups: DataFrame, arms: Sequence[str], soc: str = "AEBODSYS", pt: str = "AEDECOD") -> DataFrame:
    """Display form, in order: overall, then each class followed by its terms."""
    columns = [*arms, TOTAL]
    keyed = cells.withColumns({
        "top": F.when(F.col("lvl") == 0, 0).otherwise(1),
        "soc_sort": -F.coalesce("soc_n", F.lit(0)),
        "pt_sort": -F.coalesce("pt_n", F.lit(0)),
        "Statistic": F.lit(""),
    })
    order = ["top", "soc_sort", soc, "lvl", "pt_sort", pt]
    wide = table_wide(keyed, ["Parameter", "Statistic"], "grp", "display", columns, order)
    return with_headers(wide.orderBy(*order), ["Parameter", "Statistic"], groups, columns)
