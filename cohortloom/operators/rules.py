"""Data-quality rules. Each returns issue rows of a fixed shape.

Rules that look at one row at a time are evaluated together in a single scan per table
(``row_issues``); rules over groups are pre-aggregated and then joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom import specs
from cohortloom.errors import GateClosed
from cohortloom.functions.conditions import is_blank
from cohortloom.functions.dates import (
    dosed_population_flag,
    duration_inclusive,
    is_complete_date,
    iso_to_date,
    iso_valid,
    planned_population_flag,
    treatment_emergent,
)
from cohortloom.operators.aggregates import denominators, issue_summary, offender_counts, offender_keys
from cohortloom.operators.joins import missing_keys, orphans, repeated_keys
from cohortloom.operators.reshape import content_difference, ordered_difference
from cohortloom.operators.schema import has_kind
from cohortloom.operators.skew import key_join
from cohortloom.operators.windows import duplicate_rows
from cohortloom.specs import TableSpec

# Issue table columns.
ISSUE_COLUMNS = [
    "rule_id", "severity", "domain", "variable", "record_key", "message",
    "actual_value", "mapping_id", "run_id", "validator", "issue_class",
]
ANALYSIS_COLUMNS = ["rule_id", "severity", "dataset", "variable", "record_key", "message", "actual_value"]

ISSUE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ISSUE_COLUMNS])
ANALYSIS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ANALYSIS_COLUMNS])

MAX_BYTES = 200


@dataclass(frozen=True)
class RowRule:
    """``failing`` is true on rows that break the rule; ``actual`` is the value that is reported."""

    rule_id: str
    variable: str
    failing: Column
    message: str
    actual: Column | None = None


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def no_analysis_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANALYSIS_SCHEMA)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def shown_value(df: DataFrame, name: str) -> Column:
    """Text of a value; whole numbers show without decimals."""
    text = F.col(name).cast("string")
    whole = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    exact = F.col(name) == F.floor(F.col(name))
    return F.when(exact & (F.abs(name) < 1e18), F.col(name).cast("bigint").cast("string")).otherwise(text) if whole else text


def record_key(df: DataFrame, keys: Sequence[str]) -> Column:
    present = [F.coalesce(shown_value(df, k), F.lit("NA")) for k in keys if k in df.columns]
    return F.concat_ws(" | ", *present) if present else F.lit("")


def _issue(rule_id: str, domain: str, variable: str, key: Column, message: str, actual: Column, run_id: str) -> list[Column]:
    values = {
        "rule_id": F.lit(rule_id), "severity": F.lit("ERROR"), "domain": F.lit(domain), "variable": F.lit(variable),
        "record_key": key, "message": F.lit(message), "actual_value": actual.cast("string"), "mapping_id": F.lit(""),
        "run_id": F.lit(run_id), "validator": F.lit("local"), "issue_class": F.lit("generated_domain_defect"),
    }
    return [values[c].alias(c) for c in ISSUE_COLUMNS]


def row_issues(df: DataFrame, spec: TableSpec, rules: Sequence[RowRule], run_id: str = "") -> DataFrame:
    """Issue rows of all row rules in one scan.

    Clean rows are filtered out first; a failing row carries only rule number and value until it is
    unfolded, the fixed texts of a rule are filled in afterwards.
    """
    if not rules:
        return no_issues(df.sparkSession)
    hits, failing = [], F.lit(False)
    for i, r in enumerate(rules):
        actual = r.actual if r.actual is not None else shown_value(df, r.variable)
        failing = failing | F.coalesce(r.failing, F.lit(False))
        hits.append(F.when(r.failing, F.struct(F.lit(i).alias("rule"), actual.cast("string").alias("actual"))))
    key = record_key(df, spec.keys).alias("record_key")
    found = df.filter(failing).select(key, F.explode(F.array_compact(F.array(*hits))).alias("hit"))

    def text(field: str) -> Column:
        return F.array(*[F.lit(getattr(r, field)) for r in rules])[F.col("hit.rule")]

    values = {
        "rule_id": text("rule_id"), "severity": F.lit("ERROR"), "domain": F.lit(spec.name), "variable": text("variable"),
        "record_key": F.col("record_key"), "message": text("message"), "actual_value": F.col("hit.actual"),
        "mapping_id": F.lit(""), "run_id": F.lit(run_id), "validator": F.lit("local"), "issue_class": F.lit("generated_domain_defect"),
    }
    return found.select(*[values[c].alias(c) for c in ISSUE_COLUMNS])


# Source-domain rules, one row at a time --------------------------------------------------------


def domain_rules(df: DataFrame, spec: TableSpec) -> list[RowRule]:
    """Checks that follow from the table specification alone."""
    rules = []
    if "DOMAIN" in df.columns:
        other = F.col("DOMAIN").isNull() | (F.col("DOMAIN") != spec.name)
        rules.append(RowRule("LOCAL002", "DOMAIN", other, "DOMAIN does not name this table."))
    rules += required_rules(df, spec)
    for v in spec.variables:
        if v.name not in df.columns:
            continue
        c = F.col(v.name)
        if v.controlled:
            rules.append(controlled_rule(v.name, v.controlled))
        if v.iso8601:
            rules.append(RowRule("LOCAL007", v.name, ~iso_valid(c.cast("string")), "Not a valid ISO 8601 date."))
        if isinstance(df.schema[v.name].dataType, T.StringType):
            rules.append(length_rule(v.name))
    return rules


def required_rules(df: DataFrame, spec: TableSpec) -> list[RowRule]:
    return [
        RowRule("LOCAL004", name, is_blank(F.col(name)), "Required value is missing.")
        for name in spec.required if name in df.columns
    ]


def controlled_rule(variable: str, allowed: Sequence[str]) -> RowRule:
    text = F.col(variable).cast("string")
    outside = text.isNotNull() & (text != "") & ~text.isin(list(allowed))
    return RowRule("LOCAL006", variable, outside, "Value is not in the controlled list.")


def length_rule(variable: str) -> RowRule:
    return RowRule("LOCAL008", variable, F.octet_length(variable) > MAX_BYTES, f"Text is longer than {MAX_BYTES} bytes.")


def event_date_rule(start: str = "AESTDTC", end: str = "AEENDTC") -> RowRule:
    """End before start, on complete dates only."""
    reversed_dates = iso_to_date(F.col(start)) > iso_to_date(F.col(end))
    actual = F.concat(F.col(start), F.lit(" -> "), F.col(end))
    return RowRule("LOCAL012", end, reversed_dates, f"{end} is before {start}.", actual)


def test_pair_rules(
    pairs: Mapping[str, tuple[str, str]] = specs.TEST_PAIRS,
    conversions: Sequence[tuple] = tuple(specs.UNIT_CONVERSIONS["vs_standard_v1"]),
    code: str = "VSTESTCD", name: str = "VSTEST", unit: str = "VSORRESU", std_unit: str = "VSSTRESU", result: str = "VSSTRESN",
) -> list[RowRule]:
    """Test name, standard unit, original unit and numeric result against the registered pairs.

    The registered pairs and conversions are specification data and travel as literals.
    """
    names = F.create_map(*[F.lit(x) for c, (n, _) in pairs.items() for x in (c, n)])
    units = F.create_map(*[F.lit(x) for c, (_, u) in pairs.items() for x in (c, u)])
    test, unit_of = names[F.col(code)], units[F.col(code)]
    known = F.lit(False)
    for t, from_unit, to_unit, *_ in conversions:
        known = known | ((F.col(code) == t) & (F.col(unit) == from_unit) & (unit_of == to_unit))
    return [
        RowRule("LOCAL013", name, test.isNull() | (F.col(name) != test), f"{name} does not belong to {code}."),
        RowRule("LOCAL014", std_unit, unit_of.isNull() | (F.col(std_unit) != unit_of), f"{std_unit} does not belong to {code}."),
        RowRule("LOCAL016", unit, ~F.coalesce(known, F.lit(False)), "Original unit is not registered for conversion."),
        RowRule("LOCAL015", result, F.col(result).isNull(), "Numeric result is missing."),
    ]


def study_day_rule(date: str, day: str) -> RowRule:
    """A study day although the date is incomplete."""
    incomplete = F.col(date).isNotNull() & (F.col(date) != "") & ~is_complete_date(F.col(date))
    return RowRule("LOCAL017", day, incomplete & F.col(day).isNotNull(), "Study day from an incomplete date.")


# Source-domain rules over groups and schemas ---------------------------------------------------


def structure_issues(df: DataFrame, spec: TableSpec, run_id: str = "") -> DataFrame:
    """Missing required columns, wrong types, wrong column order; needs the schema only."""
    spark, found = df.sparkSession, []
    for name in spec.required:
        if name not in df.columns:
            found.append(("LOCAL001", name, "Required column is missing.", ""))
    for v in spec.variables:
        if v.name in df.columns and not has_kind(v.kind, df.schema[v.name].dataType):
            found.append(("LOCAL005", v.name, f"Column should be {v.kind}.", df.schema[v.name].dataType.simpleString()))
    if df.columns != [c for c in spec.order if c in df.columns]:
        found.append(("LOCAL009", "", "Columns or their order differ from the specification.", ",".join(df.columns)))
    rows = [
        (rule, "ERROR", spec.name, variable, "", message, actual, "", run_id, "local", "generated_domain_defect")
        for rule, variable, message, actual in found
    ]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def duplicate_key_issues(df: DataFrame, spec: TableSpec, run_id: str = "") -> DataFrame:
    if any(k not in df.columns for k in spec.keys):
        return no_issues(df.sparkSession)
    rows = duplicate_rows(df.select(*spec.keys), list(spec.keys))
    key = record_key(rows, spec.keys)
    return rows.select(*_issue("LOCAL003", spec.name, ",".join(spec.keys), key, "Key is not unique.", key, run_id))


def orphan_issues(
    child: DataFrame, parent: DataFrame, spec: TableSpec, subject: str = "USUBJID", run_id: str = ""
) -> DataFrame:
    rows = orphans(child, parent, {subject: subject})
    key = record_key(rows, spec.keys)
    return rows.select(*_issue("LOCAL010", spec.name, subject, key, "Subject is not in the subject table.", F.col(subject), run_id))


def broken_sequences(df: DataFrame, subject: str, number: str) -> DataFrame:
    """Subjects whose numbers are not exactly 1..n."""
    seen = df.groupBy(subject, number).agg(F.count(F.lit(1)).alias("n"))
    stats = seen.groupBy(subject).agg(
        F.sum("n").alias("rows"), F.count(number).alias("different"), F.min(number).alias("low"),
        F.max(number).alias("high"), F.count_if(F.col(number).isNull()).alias("nulls"),
    )
    good = (
        (F.col("nulls") == 0) & (F.col("rows") == F.col("different"))
        & (F.col("low") == 1) & (F.col("high") == F.col("rows"))
    )
    return stats.filter(~F.coalesce(good, F.lit(False))).select(subject)


def sequence_issues(
    df: DataFrame, spec: TableSpec, number: str, subject: str = "USUBJID", run_id: str = ""
) -> DataFrame:
    """All rows of a subject whose numbers are not exactly 1..n."""
    rows = key_join(df, broken_sequences(df, subject, number), [subject], "left_semi")
    key = record_key(rows, spec.keys)
    message = "Numbers of a subject must be 1..n without gap or repeat."
    return rows.select(*_issue("LOCAL011", spec.name, number, key, message, shown_value(rows, number), run_id))


def with_mapping_ids(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Fill in the mapping ids per (domain, variable); ``ids`` has one row per variable of the specification."""
    renamed = ids.select(F.col("target_domain").alias("domain"), "variable", F.col("mapping_id").alias("__id"))
    joined = issues.join(F.broadcast(renamed), ["domain", "variable"], "left")
    return joined.withColumn("mapping_id", F.coalesce("__id", F.lit(""))).select(*ISSUE_COLUMNS)


def validate_domain(df: DataFrame, spec: TableSpec, run_id: str = "", extra: Sequence[RowRule] = ()) -> DataFrame:
    """All checks of one table that need no other table."""
    rules = [*domain_rules(df, spec), *extra]
    return union_all([
        structure_issues(df, spec, run_id),
        row_issues(df, spec, rules, run_id),
        duplicate_key_issues(df, spec, run_id),
    ])


# Analysis-table rules --------------------------------------------------------------------------


def _analysis(rule_id: str, dataset: str, variable: str, message: str, actual: Column | str = "") -> list[Column]:
    value = F.lit(actual) if isinstance(actual, str) else actual.cast("string")
    values = {
        "rule_id": F.lit(rule_id), "severity": F.lit("ERROR"), "dataset": F.lit(dataset), "variable": F.lit(variable),
        "record_key": F.lit(""), "message": F.lit(message), "actual_value": value,
    }
    return [values[c].alias(c) for c in ANALYSIS_COLUMNS]


def listed_issues(bad: DataFrame, key: Column | str, rule_id: str, dataset: str, variable: str, message: str) -> DataFrame:
    """One issue when there are offending keys, with their number as its value; ``*_offenders`` give the keys themselves."""
    counted = offender_counts(bad, key)
    return counted.select(*_analysis(rule_id, dataset, variable, message, F.col("n_keys")))


def any_issue(bad: DataFrame, rule_id: str, dataset: str, variable: str, message: str) -> DataFrame:
    """One issue when at least one row is bad."""
    return bad.limit(1).select(*_analysis(rule_id, dataset, variable, message))


def failing_rows(df: DataFrame, rules: Sequence[tuple[str, Column]], shown: Column) -> DataFrame:
    """(rule id, shown key) of every failing row, all rules in one scan; clean rows are filtered out first."""
    failing = F.lit(False)
    for _, bad in rules:
        failing = failing | F.coalesce(bad, F.lit(False))
    hits = [F.when(bad, F.lit(rule)) for rule, bad in rules]
    return df.filter(failing).select(F.explode(F.array_compact(F.array(*hits))).alias("rule_id"), shown.alias("shown"))


def _listed_together(
    failing: DataFrame, texts: Mapping[str, tuple[str, str]], dataset: str, quiet: Sequence[str]
) -> DataFrame:
    """One issue for each failing rule, with the number of its keys as value; ``quiet`` rules report no keys."""
    counts = offender_counts(failing.filter(~F.col("rule_id").isin(list(quiet))) if quiet else failing, "shown", ["rule_id"])
    variable = F.create_map(*[F.lit(x) for r, (v, _) in texts.items() for x in (r, v)])
    message = F.create_map(*[F.lit(x) for r, (_, m) in texts.items() for x in (r, m)])
    named = counts.select("rule_id", F.col("n_keys").cast("string").alias("actual_value"))
    if quiet:
        plain = failing.filter(F.col("rule_id").isin(list(quiet))).select("rule_id").distinct()
        named = named.unionByName(plain.withColumn("actual_value", F.lit("")))
    filled = named.select(
        "rule_id", F.lit("ERROR").alias("severity"), F.lit(dataset).alias("dataset"),
        variable[F.col("rule_id")].alias("variable"), F.lit("").alias("record_key"),
        message[F.col("rule_id")].alias("message"), "actual_value",
    )
    return filled.select(*ANALYSIS_COLUMNS)


def analysis_structure(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns, types and key of an analysis table."""
    found = []
    if df.columns != spec.order:
        found.append(("ADAM001", "", "Columns or their order differ from the specification.", ",".join(df.columns)))
    for v in spec.variables:
        if v.name in df.columns and not has_kind(v.kind, df.schema[v.name].dataType):
            found.append(("ADAM003", v.name, f"Column should be {v.kind}.", df.schema[v.name].dataType.simpleString()))
    rows = [(rule, "ERROR", spec.name, variable, "", message, actual) for rule, variable, message, actual in found]
    issues = df.sparkSession.createDataFrame(rows, ANALYSIS_SCHEMA)
    if all(k in df.columns for k in spec.keys):
        repeated = repeated_keys(df, list(spec.keys))
        shown = record_key(repeated, spec.keys)
        issues = issues.unionByName(
            listed_issues(repeated, shown, "ADAM002", spec.name, ",".join(spec.keys), "Key is not unique.")
        )
    return issues


def missing_tables(spark: SparkSession, present: Sequence[str], required: Sequence[str] = ("ADSL", "ADAE")) -> DataFrame:
    absent = [name for name in required if name not in present]
    rows = [("ADAM000", "ERROR", ",".join(absent), "", "", "Analysis table is missing.", "")] if absent else []
    return spark.createDataFrame(rows, ANALYSIS_SCHEMA)


def row_count_issue(
    mine: DataFrame, source: DataFrame, rule_id: str, dataset: str, message: str, actual_both: bool, unique: str | None = None
) -> DataFrame:
    """An issue when the tables differ in size, or when ``unique`` repeats in the first.

    A repeated value means that the distinct count is below the row count, and a null counts as a
    value of its own here. Each table sends one partial count per task.
    """
    if unique:
        per_value = mine.groupBy(unique).agg(F.count(F.lit(1)).alias("n"))
        first = per_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("u"))
    else:
        first = mine.agg(F.count(F.lit(1)).alias("a"), F.count(F.lit(1)).alias("u"))
    second = source.agg(F.count(F.lit(1)).alias("b"))
    none = F.lit(None).cast("bigint")
    both = first.select("a", "u", none.alias("b")).unionByName(second.select(none.alias("a"), none.alias("u"), "b"))
    one = both.agg(F.max("a").alias("a"), F.max("u").alias("u"), F.max("b").alias("b"))
    bad = one.filter((F.col("a") != F.col("b")) | (F.col("a") != F.col("u")))
    text = F.concat(F.lit(f"{dataset}="), F.col("a"), F.lit(", source="), F.col("b")) if actual_both else F.col("a")
    return bad.select(*_analysis(rule_id, dataset, unique or "", message, text))


def arm_number_failing(name: str, number: str, rows: Sequence[tuple]) -> Column:
    """True where the arm name is not registered or its number is another one."""
    expected = F.create_map(*[F.lit(x) for r in rows for x in (r[0], float(r[2]))])[F.col(name)]
    return expected.isNull() | (F.col(number) != expected)


def subject_table_rules(plan: specs.AnalysisPlan) -> list[tuple[str, Column]]:
    duration = duration_inclusive(F.col("TRTSDT"), F.col("TRTEDT")).cast("double")
    return [
        ("ADSL002", arm_number_failing("TRT01P", "TRT01PN", plan.rows)),
        ("ADSL003", arm_number_failing("TRT01A", "TRT01AN", plan.rows)),
        ("ADSL004", F.col("TRTSDT") > F.col("TRTEDT")),
        ("ADSL005", ~duration.eqNullSafe(F.col("TRTDURD"))),
        ("ADSL006", ~F.col("ITTFL").eqNullSafe(planned_population_flag(F.col("TRT01P")))),
        ("ADSL007", ~F.col("SAFFL").eqNullSafe(dosed_population_flag(F.col("TRTSDT")))),
    ]


SUBJECT_TEXTS = {
    "ADSL002": ("TRT01PN", "Planned treatment name and number disagree."),
    "ADSL003": ("TRT01AN", "Actual treatment name and number disagree."),
    "ADSL004": ("TRTEDT", "Last dose is before first dose."),
    "ADSL005": ("TRTDURD", "Duration is not the number of days with both ends."),
    "ADSL006": ("ITTFL", "Planned-treatment population flag differs from its rule."),
    "ADSL007": ("SAFFL", "Safety population flag differs from its rule."),
}


def validate_subject_table(adsl: DataFrame, dm: DataFrame, plan: specs.AnalysisPlan) -> DataFrame:
    failing = failing_rows(adsl, subject_table_rules(plan), F.coalesce(F.col("USUBJID"), F.lit("NA")))
    absent = missing_keys(dm, adsl, "USUBJID")
    return union_all([
        row_count_issue(adsl, dm, "ADSL001", "ADSL", "There must be one row per source subject.", False, "USUBJID"),
        _listed_together(failing, SUBJECT_TEXTS, "ADSL", ["ADSL006", "ADSL007"]),
        listed_issues(absent, "USUBJID", "ADSL008", "ADSL", "USUBJID", "Source subjects are missing."),
    ])


def _offenders(frames: Sequence[DataFrame], dataset: str) -> DataFrame:
    """rule_id, dataset, ordinal, offender: the keys behind the issues, from frames of (rule_id, shown)."""
    found = offender_keys(union_all(frames), "shown", ["rule_id"])
    return found.select("rule_id", F.lit(dataset).alias("dataset"), "ordinal", "offender")


def subject_table_offenders(adsl: DataFrame, dm: DataFrame, plan: specs.AnalysisPlan) -> DataFrame:
    """The keys that ``validate_subject_table`` counts, one a row."""
    failing = failing_rows(adsl, subject_table_rules(plan), F.coalesce(F.col("USUBJID"), F.lit("NA")))
    absent = missing_keys(dm, adsl, "USUBJID").select(F.lit("ADSL008").alias("rule_id"), F.col("USUBJID").alias("shown"))
    return _offenders([failing.filter(~F.col("rule_id").isin("ADSL006", "ADSL007")), absent], "ADSL")


def event_table_rules(plan: specs.AnalysisPlan) -> list[tuple[str, Column]]:
    recomputed = treatment_emergent(*[F.col(c) for c in ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")], plan.window_days)
    return [
        ("ADAE003", F.col("ASTDT") > F.col("AENDT")),
        ("ADAE004", F.col("TRTEMFL") != "Y"),
        ("ADAE005", F.coalesce(F.col("TRTEMFL"), F.lit("")) != F.coalesce(recomputed, F.lit(""))),
    ]


EVENT_TEXTS = {
    "ADAE003": ("AENDT", "Analysis end is before analysis start."),
    "ADAE004": ("TRTEMFL", "Emergent flag must be Y or missing."),
    "ADAE005": ("TRTEMFL", "Emergent flag differs from the window rule."),
}

# First-occurrence flag -> grouping columns, from coarse to fine, with the rule that checks it.
OCCURRENCE_FLAGS: dict[str, list[str]] = {
    "AOCCFL": ["USUBJID"],
    "AOCCSFL": ["USUBJID", "AEBODSYS"],
    "AOCCPFL": ["USUBJID", "AEBODSYS", "AEDECOD"],
}
OCCURRENCE_RULES = {"AOCCFL": "ADAE007", "AOCCSFL": "ADAE008", "AOCCPFL": "ADAE009"}


def bad_occurrence_groups(adae: DataFrame, grouping: Sequence[str], flag: str, emergent: str = "TRTEMFL") -> DataFrame:
    """Groups without exactly one flagged row where an emergent row exists, or with one where none does."""
    grouped = adae.groupBy(*grouping).agg(
        F.count_if(F.col(flag) == "Y").alias("marked"),
        F.count_if(F.col(emergent) == "Y").alias("eligible"),
        F.count_if(F.col(flag) != "Y").alias("odd"),
    )
    wanted = F.when(F.col("eligible") > 0, 1).otherwise(0)
    return grouped.filter((F.col("marked") != wanted) | (F.col("odd") > 0))


def treatment_mismatches(adae: DataFrame, adsl: DataFrame) -> DataFrame:
    """Events whose treatment differs from that of their subject, or whose subject is unknown."""
    subjects = adsl.groupBy("USUBJID").agg(
        F.min_by(F.struct("TRT01A", "TRT01AN"), F.coalesce("TRT01A", F.lit(""))).alias("__arm")
    )
    joined = key_join(adae.select("USUBJID", "TRTA", "TRTAN"), subjects, ["USUBJID"])
    same = F.col("TRTA").eqNullSafe(F.col("__arm.TRT01A")) & F.col("TRTAN").eqNullSafe(F.col("__arm.TRT01AN"))
    return joined.filter(F.col("__arm").isNull() | ~same)


def _event_key() -> Column:
    number = F.col("AESEQ").cast("bigint").cast("string")
    return F.concat(F.coalesce("USUBJID", F.lit("NA")), F.lit("/"), F.coalesce(number, F.lit("NA")))


def event_table_offenders(adae: DataFrame, adsl: DataFrame, plan: specs.AnalysisPlan) -> DataFrame:
    """The keys that ``validate_event_table`` counts, one a row."""
    failing = failing_rows(adae, event_table_rules(plan), _event_key())
    subjects = {"ADAE002": missing_keys(adae, adsl, "USUBJID"), "ADAE006": treatment_mismatches(adae, adsl)}
    named = [df.select(F.lit(rule).alias("rule_id"), F.col("USUBJID").alias("shown")) for rule, df in subjects.items()]
    return _offenders([failing.filter(F.col("rule_id") != "ADAE004"), *named], "ADAE")


def validate_event_table(
    adae: DataFrame, ae: DataFrame, adsl: DataFrame, plan: specs.AnalysisPlan
) -> DataFrame:
    failing = failing_rows(adae, event_table_rules(plan), _event_key())
    unknown = missing_keys(adae, adsl, "USUBJID")
    message = "A flag must mark exactly one row per emergent group."
    return union_all([
        row_count_issue(adae, ae, "ADAE001", "ADAE", "Row count must equal that of the source.", True),
        listed_issues(unknown, "USUBJID", "ADAE002", "ADAE", "USUBJID", "Subjects are not in the subject table."),
        _listed_together(failing, EVENT_TEXTS, "ADAE", ["ADAE004"]),
        listed_issues(treatment_mismatches(adae, adsl), "USUBJID", "ADAE006", "ADAE", "TRTA",
                      "Treatment differs from that of the subject."),
        *[any_issue(bad_occurrence_groups(adae, grouping, flag), OCCURRENCE_RULES[flag], "ADAE", flag, message)
          for flag, grouping in OCCURRENCE_FLAGS.items()],
    ])


def validate_analysis(datasets: Mapping[str, DataFrame], source: Mapping[str, DataFrame], plan: specs.AnalysisPlan, spark: SparkSession) -> DataFrame:
    if any(name not in datasets for name in ("ADSL", "ADAE")):
        return missing_tables(spark, list(datasets))
    return union_all([
        analysis_structure(datasets["ADSL"], specs.ADSL),
        analysis_structure(datasets["ADAE"], specs.ADAE),
        validate_subject_table(datasets["ADSL"], source["DM"], plan),
        validate_event_table(datasets["ADAE"], source["AE"], datasets["ADSL"], plan),
    ])


# Table rules -----------------------------------------------------------------------------------


def _figures(bad: DataFrame, shown: Column) -> DataFrame:
    """All differing figures (``grp``, one row per registered group at most) as one text; no row where none differs."""
    pairs = F.concat_ws(":", "grp", F.coalesce(shown, F.lit("NA")))
    return bad.agg(F.array_join(F.array_sort(F.collect_list(pairs)), ",").alias("figures")).where("figures <> ''")


def denominator_issues(stored: DataFrame, population: DataFrame, group: str, subject: str, registered: Sequence[str], table_id: str) -> DataFrame:
    """Denominators of a table (``grp``, ``n``) against a recount; both have one row per group."""
    recount = denominators(population, group, subject, registered, check=False).select("grp", F.col("n").alias("expected"))
    both = stored.select("grp", "n").join(recount, "grp", "full_outer").filter(~F.col("n").eqNullSafe(F.col("expected")))
    figures = _figures(both, F.col("n").cast("string"))
    return figures.select(*_analysis("TLF001", table_id, "denominator", "Denominator differs from a recount.", F.col("figures")))


def empty_table_issue(table: DataFrame, table_id: str) -> DataFrame:
    """An issue when a stored table has no rows."""
    rows = table.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") == 0).select(*_analysis("TLF002", table_id, "", "The stored table is empty."))


def stored_table_issue(stored: DataFrame, recomputed: DataFrame, table_id: str, ordered: bool = False) -> DataFrame:
    """One issue when a stored table differs from the recomputed one; with ``ordered`` rows that changed places differ too."""
    message = "The stored table differs from the recomputed one."
    if stored.columns != recomputed.columns:
        return stored.sparkSession.range(1).select(*_analysis("TLF003", table_id, "", message))
    difference = (ordered_difference if ordered else content_difference)(stored, recomputed)
    return any_issue(difference, "TLF003", table_id, "", message)


def overall_row_issue(displayed: DataFrame, recomputed: DataFrame, table_id: str) -> DataFrame:
    """First-row cells (``grp``, ``display``) against cells recomputed from emergent rows."""
    expected = recomputed.select("grp", F.col("display").alias("expected"))
    bad = displayed.select("grp", "display").join(expected, "grp", "full_outer")
    bad = bad.filter(~F.col("display").eqNullSafe(F.col("expected")))
    figures = _figures(bad, F.col("display"))
    return figures.select(*_analysis("TLF004", table_id, "overall", "Overall row differs from a recount.", F.col("figures")))


def flagged_subject_issue(adae: DataFrame, table_id: str) -> DataFrame:
    """Flagged subjects against subjects with an emergent row in the safety population."""
    per_subject = adae.groupBy("USUBJID").agg(
        F.max(F.when(F.col("AOCCFL") == "Y", 1).otherwise(0)).alias("flagged"),
        F.max(F.when((F.col("SAFFL") == "Y") & (F.col("TRTEMFL") == "Y"), 1).otherwise(0)).alias("emergent"),
    )
    sums = per_subject.agg(F.sum("flagged").alias("f"), F.sum("emergent").alias("e")).filter(F.col("f") != F.col("e"))
    return sums.select(*_analysis("TLF005", table_id, "USUBJID", "Flagged subjects differ from emergent subjects.", F.col("f")))


# Imported findings, identifiers, gate ----------------------------------------------------------

# Ordered rules that sort findings of an external validator.
DICTIONARY_TEXT = r"(?i)not configured|dictionary.*missing|Missing.*dictionary"
SCOPE_RULES = ["SD1077", "SD1321"]
EXPECTED_RULE = ("SD0057", "Expected variable")
DEFINITION_RULE, DEFINITION_TEXT = "DD0101", r"(?i)define\.xml"
MISSING_DATASET_TEXT = "(?i)Missing .* dataset"
GENERATED_DOMAINS = ["DM", "AE", "VS"]
OMITTED_DOMAINS = ["TS", "TA", "TE", "TV", "TI", "SE", "SV", "DS", "EX", "CM", "LB", "MH", "SC", "QS", "RELREC"]


def classify_issue(
    domain: Column, rule: Column, message: Column, variable: Column, value: Column,
    generated: Sequence[str] = tuple(GENERATED_DOMAINS), omitted: Sequence[str] = tuple(OMITTED_DOMAINS),
) -> Column:
    text = F.concat_ws(" ", rule, message, variable, value)
    missing_dataset = message.rlike(MISSING_DATASET_TEXT)
    starts_missing = message.rlike(MISSING_DATASET_TEXT.replace("Missing", "^Missing"))
    in_scope_list = (
        ((rule == EXPECTED_RULE[0]) & message.contains(EXPECTED_RULE[1]))
        | rule.isin(SCOPE_RULES)
        | (rule == DEFINITION_RULE)
        | message.rlike(DEFINITION_TEXT)
        | (starts_missing & (domain.isin(list(omitted)) | value.isin(list(omitted))))
        | ((domain == "GLOBAL") & missing_dataset)
    )
    return (
        F.when(text.rlike(DICTIONARY_TEXT), "external_dictionary_unavailable")
        .when(in_scope_list, "expected_mvp_scope")
        .when(domain.isin(list(generated)), "generated_domain_defect")
        .otherwise("needs_review")
    )


def import_findings(findings: DataFrame, run_id: str = "") -> DataFrame:
    """External findings (domain, rule_id, message, variable, value, severity, record) as issue rows."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_id", "message", "variable", "value", "severity", "record")}
    domain = F.when(is_blank(F.col("domain")), "GLOBAL").otherwise(F.col("domain"))
    key = F.concat_ws(" | ", domain, F.when(text["record"] != "", text["record"]))
    values = {
        "rule_id": text["rule_id"],
        "severity": F.when(text["severity"] != "", text["severity"]).otherwise("UNSPECIFIED"),
        "domain": domain, "variable": text["variable"], "record_key": key, "message": text["message"],
        "actual_value": text["value"], "mapping_id": F.lit(""), "run_id": F.lit(run_id), "validator": F.lit("external"),
        "issue_class": classify_issue(domain, text["rule_id"], text["message"], text["variable"], text["value"]),
    }
    return findings.select(*[values[c].alias(c) for c in ISSUE_COLUMNS])


def study_id_mismatch(df: DataFrame, columns: Sequence[str], expected: str) -> DataFrame:
    """Distinct trimmed non-blank study ids other than the expected one."""
    values = df.select(F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in columns])).alias("value"))
    return values.filter((F.col("value") != "") & (F.col("value") != expected.strip())).distinct()


def key_health(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a blank key part, and rows that repeat a key beyond its first."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("NA")).alias(f"k{i}") for i, k in enumerate(keys)]
    blank = F.lit(False)
    for k in keys:
        blank = blank | is_blank(F.col(k))
    # text of a missing part is the word NA, as when parts are pasted together
    per_key = df.select(*text, blank.alias("blank")).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("blank")).alias("b")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("blank_key_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def gate_outcome(issues: DataFrame, stage: str) -> DataFrame:
    """One row: the stage, its errors and warnings, and whether the gate behind it is open."""
    summary = issue_summary(issues)
    open_ = (F.col("result") == "passed") & (F.col("errors") == 0)
    return summary.select(F.lit(stage).alias("stage"), "errors", "warnings", F.when(open_, "open").otherwise("closed").alias("gate"))


def gate(issues: DataFrame, stage: str) -> None:
    """Refuse to go on when the checks of a stage found errors."""
    summary = gate_outcome(issues, stage).first()
    if summary["gate"] != "open":
        raise GateClosed(f"{stage}: {summary['errors']} errors; the next stage must not run")

