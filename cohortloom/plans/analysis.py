"""Subject-level and event-level analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.functions.dates import (
    dosed_population_flag,
    duration_inclusive,
    iso_to_date,
    planned_population_flag,
    treatment_emergent,
)
from cohortloom.operators.checks import require_columns
from cohortloom.operators.joins import add_subject_vars, code_by_name_then_code
from cohortloom.operators.ordering import total_order
from cohortloom.operators.rules import OCCURRENCE_FLAGS
from cohortloom.operators.schema import apply_labels
from cohortloom.operators.windows import first_occurrence
from cohortloom.specs import AnalysisPlan, TableSpec

def _columns(spec: TableSpec, table: str) -> list[str]:
    """The columns of ``table`` that the variables of a specification come from, in its order."""
    return list(dict.fromkeys(s.split(".")[1] for v in spec.variables for s in v.sources if s.split(".")[0] == table))


SUBJECT_SOURCE = _columns(specs.ADSL, "DM")
EVENT_SOURCE = list(dict.fromkeys([*specs.ADAE.keys, *_columns(specs.ADAE, "AE")]))
SUBJECT_VARIABLES = _columns(specs.ADAE, "ADSL")
#: Subject columns that events carry under another name.
TREATMENT_NAMES = {
    v.sources[0].split(".")[1]: v.name for v in specs.ADAE.variables if v.rule_id == "COPY_ADSL" and v.sources[0] != f"ADSL.{v.name}"
}


def derive_subjects(dm: DataFrame, plan: AnalysisPlan, ordered: bool = True) -> DataFrame:
    """ADSL: one row per subject with treatments, dose dates, duration and population flags."""
    require_columns(dm, SUBJECT_SOURCE, "DM")
    coded = code_by_name_then_code(dm, "ARM", "ARMCD", "TRT01PN", plan.rows)
    coded = code_by_name_then_code(coded, "ACTARM", "ACTARMCD", "TRT01AN", plan.rows)
    first, last = iso_to_date(F.col("RFSTDTC")), iso_to_date(F.col("RFENDTC"))
    adsl = coded.withColumns({
        "AGE": F.col("AGE").cast("double"),
        "TRT01P": F.col("ARM"),
        "TRT01A": F.col("ACTARM"),
        "TRTSDT": first,
        "TRTEDT": last,
        "TRTDURD": duration_inclusive(first, last).cast("double"),
        "ITTFL": planned_population_flag(F.col("ARM")),
        "SAFFL": dosed_population_flag(first),
    }).select(*specs.ADSL.order)
    if ordered:
        adsl = total_order(adsl, specs.ADSL.keys)
    return apply_labels(adsl, specs.ADSL)


def derive_events(
    ae: DataFrame, adsl: DataFrame, plan: AnalysisPlan, ordered: bool = True
) -> DataFrame:
    """ADAE: one row per event with the subject's treatment, the emergent flag and first-occurrence flags."""
    require_columns(ae, EVENT_SOURCE, "AE")
    dated = ae.withColumns({"ASTDT": iso_to_date(F.col("AESTDTC")), "AENDT": iso_to_date(F.col("AEENDTC"))})
    joined = add_subject_vars(dated, adsl, ["STUDYID", "USUBJID"], SUBJECT_VARIABLES, TREATMENT_NAMES)
    emergent = treatment_emergent(*[F.col(c) for c in ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")], plan.window_days)
    flagged = first_occurrence(joined.withColumn("TRTEMFL", emergent), OCCURRENCE_FLAGS)
    require_columns(flagged, specs.ADAE.order, "ADAE")
    adae = flagged.select(*specs.ADAE.order)
    if ordered:
        adae = total_order(adae, specs.ADAE.keys)
    return apply_labels(adae, specs.ADAE)
