"""Applying a list of approved mapping tasks to source tables.

A task names one of the registered transforms. Column transforms become expressions of one
projection over the source, transpose and unit tasks one unfolding. These rows are written once, with all value checks and
row counts riding on that write; the derivations that look across rows then work on the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.errors import ContractError
from cohortloom.functions import dates
from cohortloom.functions.conditions import condition, conditional_assign, is_blank, ongoing_flag
from cohortloom.functions.text import (
    change_case,
    coalesce_fields,
    combine,
    fields_disagree,
    part,
    subject_id,
    text_literal_map,
)
from cohortloom.operators import lookups
from cohortloom.operators.aggregates import reference_datetime
from cohortloom.operators.checks import Check, Watch
from cohortloom.operators.joins import add_subject_vars, convert_units, guarded_left_join
from cohortloom.operators.reshape import Finding, transpose_findings
from cohortloom.operators.schema import conform, number_checks
from cohortloom.operators.windows import baseline_flag, common_decimals_text, sequence
from cohortloom.session import held
from cohortloom.sources.csv_files import ROW
from cohortloom.specs import Task



def column(name: str) -> Column:
    return F.col(f"`{name}`")


def _assign(task: Task) -> tuple[Column, list[Check]]:
    return column(task.sources[0]), []


def _anchored(task: Task, value: Column) -> Column:
    """A constant stays null where its anchor, the task's first source, is null; without sources it is always set."""
    return F.when(column(task.sources[0]).isNotNull(), value) if task.sources else value


def _constant(task: Task) -> tuple[Column, list[Check]]:
    return _anchored(task, F.lit(task.parameters["value"])), []


def constant_from_codelist(value: str, codelist: str) -> Column:
    """A literal that must be one of the standard terms; decided before any job runs."""
    if value not in {term for _, term in lookups.codelist_rows(codelist)}:
        raise ContractError(f"{value!r} is not a term of {codelist}")
    return F.lit(value)


def _constant_term(task: Task) -> tuple[Column, list[Check]]:
    return _anchored(task, constant_from_codelist(str(task.parameters["value"]), task.parameters["codelist_id"])), []


def _looked_up(task: Task) -> str:
    """The column that holds what a lookup task found."""
    return f"__found_{task.targets[0]}"


def _term(task: Task) -> tuple[Column, list[Check]]:
    source, mapped = column(task.sources[0]), F.col(_looked_up(task))
    return mapped, [Check(task.id, ~is_blank(source) & mapped.isNull(), source)]


def _visit(task: Task) -> tuple[Column, list[Check]]:
    source, mapped = column(task.sources[0]), F.col(_looked_up(task))
    return mapped, [Check(task.id, source.isNotNull() & mapped.isNull(), source)]


def _with_lookups(source: DataFrame, mine: Sequence[Task]) -> DataFrame:
    """Codelist terms and visit numbers of all coded columns, each joined from a table of its list.

    The plan has one join for each coded column, however long its list is; Spark broadcasts a list where its size allows.
    """
    for t in mine:
        if t.transform == "assign_ct":
            rows, kind = lookups.codelist_rows(t.parameters["codelist_id"]), "string"
        elif t.transform == "derive_visitnum":
            rows, kind = lookups.visit_rows(t.parameters["visit_map_id"]), "double"
        else:
            continue
        source = lookups.attach(source, rows, f"__term string, {_looked_up(t)} {kind}", {f"`{t.sources[0]}`": "__term"})
    return source


def _date(task: Task) -> tuple[Column, list[Check]]:
    source = column(task.sources[0])
    text = dates.iso_date_text(source, task.parameters["formats"])
    return text, [Check(task.id, dates.unreadable_date(source, text), source)]


def _datetime(task: Task) -> tuple[Column, list[Check]]:
    source = column(task.sources[0])
    time = column(task.sources[1]) if len(task.sources) > 1 else None
    unknown = task.parameters.get("unknown_tokens", dates.UNKNOWN_TOKENS)
    text = dates.iso_partial_text(source, list(task.parameters["formats"]), time, unknown)
    # a time of day alone is no date-time
    text = F.when(~dates.only_time(text), text)
    return text, [Check(task.id, source.isNotNull() & text.isNull(), source)]


def _combine(task: Task) -> tuple[Column, list[Check]]:
    return combine([column(c) for c in task.sources], task.parameters["separator"], task.parameters["missing_policy"]), []


def _subject(task: Task) -> tuple[Column, list[Check]]:
    return subject_id([column(c) for c in task.sources], task.parameters["separator"]), []


def _part(task: Task) -> tuple[Column, list[Check]]:
    source = column(task.sources[0])
    piece = part(source, task.parameters["separator"], int(task.parameters["position"]))
    return piece, [Check(task.id, source.isNotNull() & piece.isNull(), source)]


def _coalesce(task: Task) -> tuple[Column, list[Check]]:
    fields = [column(c) for c in task.sources]
    checks = []
    if task.parameters.get("conflict_policy") == "error_if_disagree":
        checks = [Check(task.id, fields_disagree(fields), F.concat_ws("/", *fields))]
    return coalesce_fields(fields), checks


def _conditional(task: Task) -> tuple[Column, list[Check]]:
    c = task.parameters["condition"]
    when = condition(column(c["variable"]), c["operator"], c.get("compare_to"))
    return conditional_assign(when, task.parameters["value"], task.parameters.get("else_value")), []


def _ongoing(task: Task) -> tuple[Column, list[Check]]:
    indicator = column(task.sources[1]) if len(task.sources) > 1 else None
    # the default words apply also where an empty list is given
    words = task.parameters.get("affirmative_values") or ("Y", "Yes")
    return ongoing_flag(column(task.sources[0]), indicator, words, task.parameters["ongoing_value"]), []


def _case(task: Task) -> tuple[Column, list[Check]]:
    return change_case(column(task.sources[0]), task.parameters["case"]), []


# Transforms that are one expression over a source row.
COLUMN_TRANSFORMS: dict[str, Callable[[Task], tuple[Column, list[Check]]]] = {
    "assign_no_ct": _assign,
    "hardcode_no_ct": _constant,
    "assign_ct": _term,
    "hardcode_ct": _constant_term,
    "to_iso8601_date": _date,
    "to_iso8601_datetime": _datetime,
    "to_iso8601_partial_datetime": _datetime,
    "coalesce_fields": _coalesce,
    "combine_fields": _combine,
    "derive_usubjid": _subject,
    "extract_delimited_part": _part,
    "conditional_assign": _conditional,
    "derive_ongoing_flag": _ongoing,
    "normalize_case": _case,
    "derive_visitnum": _visit,
}
SOURCE_TRANSFORMS = ["merge_sources", "derive_reference_datetime"]
RECORD_TRANSFORMS = ["transpose_findings", "standardize_unit"]
ROW_TRANSFORMS = ["derive_sequence", "derive_study_day", "derive_baseline_flag"]
TRANSFORMS = [*COLUMN_TRANSFORMS, *SOURCE_TRANSFORMS, *RECORD_TRANSFORMS, *ROW_TRANSFORMS, "do_not_map"]


def _merge(task: Task, sources: dict[str, DataFrame], watch: Watch | None) -> None:
    p = task.parameters
    for name in (p["left_dataset"], p["right_dataset"]):
        if name not in sources:
            raise ContractError(f"{task.id}: unknown source {name}")
    sources[p["output_dataset"]] = guarded_left_join(
        sources[p["left_dataset"]], sources[p["right_dataset"]], p["by"], p["relationship"], p["select"], watch
    )
    if watch is not None:
        sources[p["output_dataset"]] = watch.on(sources[p["output_dataset"]], counts={count_name(task): None})


def _reference(task: Task, base: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Earliest or latest date-time of the subject over the named sources, as ISO text."""
    key, parts = task.parameters["subject_keys"][0], []
    for s in task.parameters["sources"]:
        time = s.get("time_variable")
        formats = [s["date_formats"][0], *([s["time_formats"][0]] if time else [])]
        text = dates.iso_partial_text(column(s["date_variable"]), formats, column(time) if time else None)
        parts.append((sources[s["dataset"]], key, F.when(dates.is_complete_date(text), text)))
    return reference_datetime(base, key, parts, task.parameters["selection"], task.targets[0])


def study_day(
    df: DataFrame, subjects: DataFrame | None, date: str, reference: str, target: str, subject: str = "USUBJID"
) -> DataFrame:
    """Study day from the subject's reference date; null where either date is incomplete."""
    if reference in df.columns:
        with_reference = df
    else:
        with_reference = add_subject_vars(df, subjects, [subject], [reference])
    day = dates.study_day(dates.iso_to_date(F.col(date)), dates.iso_to_date(F.col(reference)))
    return with_reference.withColumn(target, day.cast("double"))


def count_name(task: Task) -> str:
    """Under which name a watch counts the rows that a step made."""
    return f"{task.id}/{task.transform}"


@dataclass(frozen=True)
class Draft:
    """A standard table up to the write: ``rows`` to be written once, with what rides on them in ``watch``.

    Nothing has run yet. ``finish`` makes the table from the written rows, ``counted`` says after the write how many
    rows each step made.
    """

    domain: str
    rows: DataFrame
    watch: Watch
    finish: Callable[[DataFrame], DataFrame]
    tasks: tuple[Task, ...]

    @property
    def looks_across(self) -> bool:
        """Whether anything is left that needs other rows of the table."""
        return any(t.transform in [*ROW_TRANSFORMS, "standardize_unit"] for t in self.tasks)

    def write(self) -> DataFrame:
        """The finished table over rows that were written and checked."""
        return self.finish(held(self.rows, self.domain, self.watch))

    def counted(self) -> dict[str, int]:
        """Rows by step (``count_name``): a merge or a transposed block has its own, other column transforms those of the
        source, derivations those of the table."""
        found, out = self.watch.counts, {}
        blocks = {t.sources: found[count_name(t)] for t in self.tasks if t.transform == "transpose_findings"}
        for t in self.tasks:
            if t.transform in ("transpose_findings", "standardize_unit"):
                out[count_name(t)] = blocks[t.sources]
            elif t.transform == "merge_sources":
                out[count_name(t)] = found[count_name(t)]
            else:
                out[count_name(t)] = found[f"{self.domain}/{'rows' if t.transform in ROW_TRANSFORMS else 'source'}"]
        return out


def draft_domain(
    domain: str, tasks: Sequence[Task], sources: Mapping[str, DataFrame], base: str, dm: DataFrame | None = None, check: bool = True,
) -> Draft:
    """One standard table from its tasks, up to the write; ``dm`` gives the reference dates of AE and VS. No job runs here."""
    mine = [t for t in tasks if t.domain == domain]
    unknown = sorted({t.transform for t in mine} - set(TRANSFORMS))
    if unknown:
        raise ContractError(f"{domain}: unregistered transforms {', '.join(unknown)}")
    watch, tables = Watch(), dict(sources)
    for t in mine:
        if t.transform == "merge_sources":
            _merge(t, tables, watch)
            if t.parameters["left_dataset"] == base:
                base = t.parameters["output_dataset"]
    source = tables[base]
    for t in mine:
        if t.transform == "derive_reference_datetime":
            source = _reference(t, source, tables)

    targets, checks = {}, []
    for t in mine:
        if t.transform in COLUMN_TRANSFORMS:
            value, found = COLUMN_TRANSFORMS[t.transform](t)
            targets[t.targets[0]] = value
            checks += found
        elif t.transform == "derive_reference_datetime":
            targets[t.targets[0]] = column(t.targets[0])
    findings = [t for t in mine if t.transform == "transpose_findings"]
    source = _with_lookups(source, mine)
    source = watch.on(source, checks if check else [], {f"{domain}/source": None})
    carried = [column(t.sources[0]).alias(f"__r{i}") for i, t in enumerate(findings)]
    units = [t.parameters.get("unit_source") for t in findings]
    carried += [column(u).alias(f"__u{i}") for i, u in enumerate(units) if u]
    df = source.select(*[v.alias(k) for k, v in targets.items()], column(ROW), *carried)
    if findings:
        df = _long(df, mine, findings, list(targets), check, watch)
    rows = [t for t in mine if t.transform in ROW_TRANSFORMS]
    references = sorted({t.parameters["reference_date"] for t in rows if "reference_date" in t.parameters} - set(df.columns))
    if references:
        df = add_subject_vars(df, dm, ["USUBJID"], references)
    spec = specs.DOMAINS[domain]
    df = watch.on(df, number_checks(df, spec) if check else [], {f"{domain}/rows": None})

    def finish(written: DataFrame) -> DataFrame:
        table, names = written, specs.FINDING_NAMES
        standard = _standard_units(mine, findings)
        if standard:
            table = common_decimals_text(table, names["number"], names["code"], names["text"], list(standard))
        for t in rows:
            table = _derived(t, table, dm)
        return conform(table, spec, check=False)

    return Draft(domain, df, watch, finish, tuple(mine))


def build_domain(
    domain: str, tasks: Sequence[Task], sources: Mapping[str, DataFrame], base: str, dm: DataFrame | None = None, check: bool = True,
) -> DataFrame:
    """One standard table; its rows are written once, and a value that breaks a check raises after that write."""
    return draft_domain(domain, tasks, sources, base, dm, check).write()


def _derived(task: Task, df: DataFrame, dm: DataFrame | None) -> DataFrame:
    """A derivation that looks across the rows of a written table."""
    p = task.parameters
    if task.transform == "derive_sequence":
        return sequence(df, task.targets[0], [ROW if v == ".SOURCE_ROW" else v for v in p["record_variables"]], start_at=p.get("start_at", 1))
    if task.transform == "derive_study_day":
        return study_day(df, dm, p["target_date"], p["reference_date"], task.targets[0])
    names = specs.FINDING_NAMES
    return baseline_flag(
        df, task.targets[0], ["USUBJID", names["code"]], names["date"], p["reference_date"], names["result"], ["USUBJID", names["code"], ROW],
        names["visit"], p.get("baseline_visits", ()),
        names["timepoint"] if names["timepoint"] in df.columns else None, p.get("baseline_timepoints", ()),
        names["status"] if names["status"] in df.columns else None,
    )


def _standard_units(mine: Sequence[Task], findings: Sequence[Task]) -> dict[str, Task]:
    """The unit task of each test code that has one."""
    return {t.parameters["test_code"]: u for t in findings for u in mine if u.transform == "standardize_unit" and u.sources == t.sources}


def _long(df: DataFrame, mine: Sequence[Task], findings: Sequence[Task], keep: Sequence[str], check: bool, watch: Watch) -> DataFrame:
    """Unfold the result columns and convert units, all tests in one pass; each block's rows are counted on the way."""
    names = specs.FINDING_NAMES
    unfolded = transpose_findings(
        df,
        [Finding(f"__r{i}", t.parameters["test_code"], t.parameters["test_name"], t.parameters.get("original_unit"),
                 f"__u{i}" if t.parameters.get("unit_source") else None) for i, t in enumerate(findings)],
        [*keep, ROW], names,
    )
    code = F.col(names["code"])
    unfolded = watch.on(unfolded, counts={count_name(t): code == t.parameters["test_code"] for t in findings})
    standard = _standard_units(mine, findings)
    if not standard:
        return unfolded
    sets = {u.parameters["conversion_set_id"] for u in standard.values()}
    conversions = [row for s in sorted(sets) for row in lookups.conversion_rows(s)]
    target = text_literal_map({c: u.parameters["target_unit"] for c, u in standard.items()})[code]
    converted = convert_units(
        unfolded, names["result"], names["unit"], names["code"], target, conversions, result=names["number"], check=check, watch=watch)
    return converted.withColumn(names["standard_unit"], target)
