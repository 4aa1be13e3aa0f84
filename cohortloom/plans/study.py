"""Three stages with a gate between them: standard tables, analysis tables, summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.operators import rules
from cohortloom.operators.aggregates import denominators, manifest, partial_date_notes
from cohortloom.operators.joins import lineage_ids
from cohortloom.plans import analysis, lineage, tables
from cohortloom.plans.mapping import draft_domain
from cohortloom.session import checkpointed, materialised
from cohortloom.specs import AnalysisPlan, Task


@dataclass(frozen=True)
class Stage:
    """Tables of a stage, the issues found in them, a manifest with one row per table, and the rows that each step made."""

    tables: dict[str, DataFrame]
    issues: DataFrame
    manifest: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def build_standard(
    tasks: Sequence[Task], sources: Mapping[str, DataFrame], domain_sources: Mapping[str, str], check: bool = True
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The standard tables and the rows that each step made; DM first, as the others take their reference dates from it.

    Each source is read once, by the write of its table's rows: the row number given at reading must not change
    when a lost task reads its file again, and the checks ride on that write.
    """
    built: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    for domain in sorted(domain_sources, key=lambda d: d != "DM"):
        draft = draft_domain(domain, tasks, sources, domain_sources[domain], built.get("DM"), check)
        table = draft.write()
        counts |= draft.counted()
        # numbers and flags are computed once, for all that reads the table
        built[domain] = materialised(table, domain) if draft.looks_across else table
    return built, counts


def build_standard_tables(
    tasks: Sequence[Task], sources: Mapping[str, DataFrame], domain_sources: Mapping[str, str], check: bool = True
) -> dict[str, DataFrame]:
    return build_standard(tasks, sources, domain_sources, check)[0]


def check_standard_tables(
    built: Mapping[str, DataFrame], tasks: Sequence[Task], run_id: str = ""
) -> DataFrame:
    """The unified issue report over all standard tables, with the mapping ids filled in."""
    spark = next(iter(built.values())).sparkSession
    extra: dict[str, list[rules.RowRule]] = {
        "AE": [rules.event_date_rule(), rules.study_day_rule("AESTDTC", "AESTDY"), rules.study_day_rule("AEENDTC", "AEENDY")],
        "VS": [*rules.test_pair_rules(), rules.study_day_rule("VSDTC", "VSDY")],
    }
    numbers = {"AE": "AESEQ", "VS": "VSSEQ"}
    frames = []
    for domain, table in built.items():
        spec = specs.DOMAINS[domain]
        usable = [r for r in extra.get(domain, []) if r.variable in table.columns]
        frames.append(rules.validate_domain(table, spec, run_id, usable))
        if domain in numbers:
            frames.append(rules.sequence_issues(table, spec, numbers[domain], run_id=run_id))
            if "DM" in built:
                frames.append(rules.orphan_issues(table, built["DM"], spec, run_id=run_id))
    ids = lineage_ids(lineage.lineage_rows(spark, tasks))
    return rules.with_mapping_ids(rules.union_all(frames), ids)


def manifests(named: Mapping[str, DataFrame]) -> DataFrame:
    return rules.union_all([manifest(df, name) for name, df in named.items()])


def standard_stage(
    tasks: Sequence[Task], sources: Mapping[str, DataFrame], domain_sources: Mapping[str, str], run_id: str = ""
) -> Stage:
    built, counts = build_standard(tasks, sources, domain_sources)
    issues = materialised(check_standard_tables(built, tasks, run_id), "standard-issues")
    return Stage(built, issues, manifests(built), counts)


def analysis_stage(standard: Stage, plan: AnalysisPlan) -> Stage:
    """Refuses to run when the standard tables have errors."""
    rules.gate(standard.issues, "standard tables")
    adsl = materialised(analysis.derive_subjects(standard.tables["DM"], plan, ordered=False), "ADSL")
    adae = materialised(analysis.derive_events(standard.tables["AE"], adsl, plan, ordered=False), "ADAE")
    built = {"ADSL": adsl, "ADAE": adae}
    # written once: the gate reads it, and so does the caller
    issues = materialised(rules.validate_analysis(built, standard.tables, plan, adsl.sparkSession), "analysis-issues")
    return Stage(built, issues, manifests(built))


def table_stage(analysed: Stage, plan: AnalysisPlan) -> Stage:
    """Refuses to run when the analysis tables have errors."""
    rules.gate(analysed.issues, "analysis tables")
    adsl, adae = analysed.tables["ADSL"], analysed.tables["ADAE"]
    people, treated = tables.population(adsl, "ITTFL"), tables.population(adsl, "SAFFL")
    planned = denominators(people, "TRT01P", "USUBJID", plan.arms)
    actual = denominators(treated, "TRT01A", "USUBJID", plan.arms)
    cells = tables.event_cells(adsl, adae, plan.arms)
    built = {
        "T14.1.1": tables.demographic_table(tables.demographic_cells(adsl, plan.arms), planned, plan.arms),
        "T14.3.1": tables.event_table(cells, actual, plan.arms),
    }
    stored = {name: checkpointed(df) for name, df in built.items()}
    issues = check_tables(stored, built, adsl, adae, plan, planned, actual, cells)
    return Stage(stored, issues, manifests(stored))


def emergent_overall(adsl: DataFrame, adae: DataFrame, plan: AnalysisPlan) -> DataFrame:
    """Overall cells counted from emergent safety rows, without the first-occurrence flags."""
    rows = adae.filter((F.col("SAFFL") == "Y") & (F.col("TRTEMFL") == "Y"))
    counts = denominators(rows, "TRTA", "USUBJID", plan.arms, check=False).select("grp", "n")
    sizes = denominators(tables.population(adsl, "SAFFL"), "TRT01A", "USUBJID", plan.arms, check=False)
    both = counts.join(sizes.select("grp", F.col("n").alias("d")), "grp")
    return both.select("grp", tables.count_percent(F.col("n"), F.col("d")).alias("display"))


def check_tables(
    stored: Mapping[str, DataFrame], built: Mapping[str, DataFrame], adsl: DataFrame, adae: DataFrame, plan: AnalysisPlan,
    planned: DataFrame, actual: DataFrame, cells: DataFrame,
) -> DataFrame:
    frames = [
        rules.denominator_issues(planned, tables.population(adsl, "ITTFL"), "TRT01P", "USUBJID", plan.arms, "T14.1.1"),
        rules.denominator_issues(actual, tables.population(adsl, "SAFFL"), "TRT01A", "USUBJID", plan.arms, "T14.3.1"),
        rules.overall_row_issue(cells.filter(F.col("lvl") == 0), emergent_overall(adsl, adae, plan), "T14.3.1"),
        rules.flagged_subject_issue(adae, "T14.3.1"),
    ]
    for name, table in stored.items():
        frames.append(rules.empty_table_issue(table, name))
        frames.append(rules.stored_table_issue(table, built[name], name, ordered=True))
    return rules.union_all(frames)


def date_notes(built: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct incomplete date texts of all standard tables."""
    return rules.union_all([partial_date_notes(df, name) for name, df in built.items()])


def run_study(
    tasks: Sequence[Task], sources: Mapping[str, DataFrame], domain_sources: Mapping[str, str], plan: AnalysisPlan, run_id: str = ""
) -> dict[str, Stage]:
    standard = standard_stage(tasks, sources, domain_sources, run_id)
    analysed = analysis_stage(standard, plan)
    return {"standard": standard, "analysis": analysed, "tables": table_stage(analysed, plan)}
