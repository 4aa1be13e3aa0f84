"""Specification data: lookup tables, table schemas and rule names.

Everything here is data that a caller may replace by passing another table or schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Codelists, collected term -> standard term.
CODELISTS: dict[str, dict[str, str]] = {
    "AGEU": {"YEARS": "YEARS"},
    "SEX": {"Female": "F", "Male": "M", "Unknown": "U", "Undifferentiated": "UNDIFFERENTIATED"},
    "ETHNIC": {
        "Hispanic or Latino": "HISPANIC OR LATINO",
        "Not Hispanic or Latino": "NOT HISPANIC OR LATINO",
        "Not Reported": "NOT REPORTED",
        "Unknown": "UNKNOWN",
    },
    "RACE": {
        "White": "WHITE",
        "Asian": "ASIAN",
        "Black or African American": "BLACK OR AFRICAN AMERICAN",
        "American Indian or Alaska Native": "AMERICAN INDIAN OR ALASKA NATIVE",
        "Multiple": "MULTIPLE",
        "Not Reported": "NOT REPORTED",
        "Unknown": "UNKNOWN",
    },
    "NY": {"Yes": "Y", "No": "N", "Y": "Y", "N": "N"},
    "AESEV": {
        "Mild Adverse Event": "MILD",
        "Moderate Adverse Event": "MODERATE",
        "Severe Adverse Event": "SEVERE",
        "MILD": "MILD",
        "MODERATE": "MODERATE",
        "SEVERE": "SEVERE",
    },
    "AEREL": {
        "Probably Related": "PROBABLE",
        "Possibly Related": "POSSIBLE",
        "Unlikely Related": "UNLIKELY",
        "Not Related": "NOT RELATED",
    },
    "AEOUT": {
        "Recovered/Resolved": "RECOVERED/RESOLVED",
        "Recovering/Resolving": "RECOVERING/RESOLVING",
        "Not Recovered/not Resolved": "NOT RECOVERED/NOT RESOLVED",
        "Recovered/Resolved with Sequelae": "RECOVERED/RESOLVED WITH SEQUELAE",
        "Fatal": "FATAL",
        "Unknown": "UNKNOWN",
    },
    "AEENRF": {"ONGOING": "ONGOING"},
    "VSPOS": {
        "Supine": "SUPINE",
        "Sitting": "SITTING",
        "Standing": "STANDING",
        "SUPINE": "SUPINE",
        "SITTING": "SITTING",
        "STANDING": "STANDING",
    },
    "VSBLFL": {"Y": "Y"},
}

# Visit name -> visit number.
VISIT_MAPS: dict[str, dict[str, float]] = {"visits_v1": {"Screening 1": -1, "Baseline": 0, "Week 2": 2}}

# Fixed values: (test, from unit, to unit, multiplier, offset, digits).
UNIT_CONVERSIONS: dict[str, list[tuple]] = {
    "vs_standard_v1": [
        ("HEIGHT", "cm", "cm", 1.0, 0.0, 1),
        ("HEIGHT", "in", "cm", 2.54, 0.0, 1),
        ("WEIGHT", "kg", "kg", 1.0, 0.0, 1),
        ("WEIGHT", "LB", "kg", 0.45359237, 0.0, 1),
        ("TEMP", "C", "C", 1.0, 0.0, 1),
        ("TEMP", "F", "C", 0.555555555555556, -17.7777777777778, 1),
        ("SYSBP", "mmHg", "mmHg", 1.0, 0.0, 1),
        ("DIABP", "mmHg", "mmHg", 1.0, 0.0, 1),
        ("PULSE", "beats/min", "beats/min", 1.0, 0.0, 0),
    ]
}

#: Version of the conversions above, named in the lineage of every converted value.
UNIT_CONVERSION_VERSION = "1.0.0"

# Spelled-out unit -> unit.
UNIT_ALIASES: dict[str, str] = {
    "centimeters": "cm",
    "centimeter": "cm",
    "inches": "in",
    "inch": "in",
    "kilograms": "kg",
    "kilogram": "kg",
    "lb": "LB",
    "lbs": "LB",
    "pounds": "LB",
    "pound": "LB",
    "degC": "C",
    "degF": "F",
}

# Test code -> (test name, standard unit).
TEST_PAIRS: dict[str, tuple[str, str]] = {
    "SYSBP": ("Systolic Blood Pressure", "mmHg"),
    "DIABP": ("Diastolic Blood Pressure", "mmHg"),
    "PULSE": ("Pulse Rate", "beats/min"),
    "HEIGHT": ("Height", "cm"),
    "WEIGHT": ("Weight", "kg"),
    "TEMP": ("Temperature", "C"),
}


# Columns of a findings table.
FINDING_NAMES: dict[str, str] = {
    "code": "VSTESTCD", "name": "VSTEST", "result": "VSORRES", "unit": "VSORRESU", "number": "VSSTRESN", "text": "VSSTRESC",
    "standard_unit": "VSSTRESU", "date": "VSDTC", "visit": "VISIT", "timepoint": "VSTPT", "status": "VSSTAT",
}


@dataclass(frozen=True)
class Variable:
    """A column of a target table. ``kind`` is ``character``, ``numeric`` or ``date``."""

    name: str
    label: str
    kind: str = "character"
    required: bool = False
    controlled: tuple[str, ...] = ()
    iso8601: bool = False
    rule_id: str = ""
    sources: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    name: str
    label: str
    keys: tuple[str, ...]
    variables: tuple[Variable, ...]

    @property
    def order(self) -> list[str]:
        return [v.name for v in self.variables]

    @property
    def required(self) -> list[str]:
        return [v.name for v in self.variables if v.required]

    def __getitem__(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)


def _required(name: str, label: str, kind: str = "character", controlled: tuple[str, ...] = ()) -> Variable:
    return Variable(name, label, kind, True, controlled)


def _iso(name: str, label: str) -> Variable:
    return Variable(name, label, iso8601=True)


# The three standard tables, columns in table order.
DM = TableSpec("DM", "Demographics", ("STUDYID", "USUBJID"), (
    _required("STUDYID", "Study Identifier"),
    _required("DOMAIN", "Domain Abbreviation"),
    _required("USUBJID", "Unique Subject Identifier"),
    _required("SUBJID", "Subject Identifier for the Study"),
    _iso("RFSTDTC", "Subject Reference Start Date/Time"),
    _iso("RFENDTC", "Subject Reference End Date/Time"),
    _iso("RFICDTC", "Date/Time of Informed Consent"),
    _required("SITEID", "Study Site Identifier"),
    Variable("AGE", "Age", "numeric"),
    Variable("AGEU", "Age Units", controlled=("YEARS",)),
    _required("SEX", "Sex", controlled=("F", "M", "U", "UNDIFFERENTIATED")),
    Variable("RACE", "Race", controlled=(
        "AMERICAN INDIAN OR ALASKA NATIVE", "ASIAN", "BLACK OR AFRICAN AMERICAN", "MULTIPLE",
        "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "NOT REPORTED", "UNKNOWN", "WHITE")),
    Variable("ETHNIC", "Ethnicity", controlled=(
        "HISPANIC OR LATINO", "NOT HISPANIC OR LATINO", "NOT REPORTED", "UNKNOWN")),
    Variable("ARMCD", "Planned Arm Code"),
    Variable("ARM", "Description of Planned Arm"),
    Variable("ACTARMCD", "Actual Arm Code"),
    Variable("ACTARM", "Description of Actual Arm"),
    Variable("COUNTRY", "Country"),
))

AE = TableSpec("AE", "Adverse Events", ("STUDYID", "USUBJID", "AESEQ"), (
    _required("STUDYID", "Study Identifier"),
    _required("DOMAIN", "Domain Abbreviation"),
    _required("USUBJID", "Unique Subject Identifier"),
    _required("AESEQ", "Sequence Number", "numeric"),
    _required("AETERM", "Reported Term for the Adverse Event"),
    Variable("AEDECOD", "Dictionary-Derived Term"),
    Variable("AEBODSYS", "Body System or Organ Class"),
    Variable("AESEV", "Severity/Intensity", controlled=("MILD", "MODERATE", "SEVERE")),
    Variable("AESER", "Serious Event", controlled=("Y", "N")),
    Variable("AEREL", "Causality"),
    Variable("AEOUT", "Outcome of Adverse Event", controlled=(
        "RECOVERED/RESOLVED", "RECOVERING/RESOLVING", "NOT RECOVERED/NOT RESOLVED",
        "RECOVERED/RESOLVED WITH SEQUELAE", "FATAL", "UNKNOWN")),
    Variable("AESHOSP", "Requires or Prolongs Hospitalization", controlled=("Y", "N")),
    _iso("AESTDTC", "Start Date/Time of Adverse Event"),
    _iso("AEENDTC", "End Date/Time of Adverse Event"),
    Variable("AESTDY", "Study Day of Start of Adverse Event", "numeric"),
    Variable("AEENDY", "Study Day of End of Adverse Event", "numeric"),
    Variable("AEENRF", "End Relative to Reference Period", controlled=("ONGOING",)),
))

VS = TableSpec("VS", "Vital Signs", ("STUDYID", "USUBJID", "VSSEQ"), (
    _required("STUDYID", "Study Identifier"),
    _required("DOMAIN", "Domain Abbreviation"),
    _required("USUBJID", "Unique Subject Identifier"),
    _required("VSSEQ", "Sequence Number", "numeric"),
    _required("VSTESTCD", "Vital Signs Test Short Name"),
    _required("VSTEST", "Vital Signs Test Name"),
    Variable("VSPOS", "Vital Signs Position of Subject", controlled=("SITTING", "STANDING", "SUPINE")),
    _required("VSORRES", "Result or Finding in Original Units"),
    Variable("VSORRESU", "Original Units"),
    Variable("VSSTRESC", "Character Result/Finding in Std Format"),
    Variable("VSSTRESN", "Numeric Result/Finding in Standard Units", "numeric"),
    Variable("VSSTRESU", "Standard Units"),
    Variable("VISITNUM", "Visit Number", "numeric"),
    Variable("VISIT", "Visit Name"),
    _iso("VSDTC", "Date/Time of Measurements"),
    Variable("VSDY", "Study Day of Vital Signs", "numeric"),
))

DOMAINS: dict[str, TableSpec] = {t.name: t for t in (DM, AE, VS)}

WINDOW_DAYS = 30


def _copied(source: str, rule: str, names: list[tuple[str, str, str]]) -> tuple[Variable, ...]:
    return tuple(Variable(n, label, kind, rule_id=rule, sources=(f"{source}.{n}",)) for n, label, kind in names)


# The two analysis tables, columns in table order, with rule and sources.
ADSL = TableSpec("ADSL", "Subject-Level Analysis Dataset", ("STUDYID", "USUBJID"), (
    *_copied("DM", "COPY_DM", [
        ("STUDYID", "Study Identifier", "character"),
        ("USUBJID", "Unique Subject Identifier", "character"),
        ("SUBJID", "Subject Identifier for the Study", "character"),
        ("SITEID", "Study Site Identifier", "character"),
        ("AGE", "Age", "numeric"),
        ("AGEU", "Age Units", "character"),
        ("SEX", "Sex", "character"),
        ("RACE", "Race", "character"),
        ("ETHNIC", "Ethnicity", "character"),
        ("COUNTRY", "Country", "character"),
    ]),
    Variable("TRT01P", "Planned Treatment for Period 01", rule_id="TRT_PLANNED_NAME", sources=("DM.ARM",)),
    Variable("TRT01PN", "Planned Treatment for Period 01 Numeric", "numeric",
             rule_id="TRT_PLANNED_NUMBER", sources=("DM.ARM", "DM.ARMCD")),
    Variable("TRT01A", "Actual Treatment for Period 01", rule_id="TRT_ACTUAL_NAME", sources=("DM.ACTARM",)),
    Variable("TRT01AN", "Actual Treatment for Period 01 Numeric", "numeric",
             rule_id="TRT_ACTUAL_NUMBER", sources=("DM.ACTARM", "DM.ACTARMCD")),
    Variable("TRTSDT", "Date of First Exposure to Treatment", "date",
             rule_id="PARSE_ISO_DATE", sources=("DM.RFSTDTC",)),
    Variable("TRTEDT", "Date of Last Exposure to Treatment", "date",
             rule_id="PARSE_ISO_DATE", sources=("DM.RFENDTC",)),
    Variable("TRTDURD", "Total Treatment Duration in Days", "numeric",
             rule_id="TRT_DURATION_INCLUSIVE", sources=("DM.RFSTDTC", "DM.RFENDTC")),
    Variable("ITTFL", "Intent-To-Treat Population Flag",
             rule_id="POP_ITT_PLANNED_TREATMENT_PRESENT", sources=("DM.ARM",)),
    Variable("SAFFL", "Safety Population Flag", rule_id="POP_SAF_FIRST_DOSE_PRESENT", sources=("DM.RFSTDTC",)),
))

ADAE = TableSpec("ADAE", "Adverse Event Analysis Dataset", ("STUDYID", "USUBJID", "AESEQ"), (
    *_copied("AE", "COPY_AE", [
        ("STUDYID", "Study Identifier", "character"),
        ("DOMAIN", "Domain Abbreviation", "character"),
        ("USUBJID", "Unique Subject Identifier", "character"),
        ("AESEQ", "Sequence Number", "numeric"),
        ("AETERM", "Reported Term for the Adverse Event", "character"),
        ("AEDECOD", "Dictionary-Derived Term", "character"),
        ("AEBODSYS", "Body System or Organ Class", "character"),
        ("AESEV", "Severity or Intensity", "character"),
        ("AESER", "Serious Event", "character"),
        ("AEREL", "Causality", "character"),
        ("AEOUT", "Outcome of Adverse Event", "character"),
        ("AESHOSP", "Requires or Prolongs Hospitalization", "character"),
        ("AESTDTC", "Start Date of Adverse Event", "character"),
        ("AEENDTC", "End Date of Adverse Event", "character"),
        ("AESTDY", "Study Day of Start of Adverse Event", "numeric"),
        ("AEENDY", "Study Day of End of Adverse Event", "numeric"),
        ("AEENRF", "End Relative to Reference Period", "character"),
    ]),
    Variable("ASTDT", "Analysis Start Date", "date", rule_id="PARSE_ISO_DATE", sources=("AE.AESTDTC",)),
    Variable("AENDT", "Analysis End Date", "date", rule_id="PARSE_ISO_DATE", sources=("AE.AEENDTC",)),
    Variable("TRTP", "Planned Treatment", rule_id="COPY_ADSL", sources=("ADSL.TRT01P",)),
    Variable("TRTPN", "Planned Treatment Numeric", "numeric", rule_id="COPY_ADSL", sources=("ADSL.TRT01PN",)),
    Variable("TRTA", "Actual Treatment", rule_id="COPY_ADSL", sources=("ADSL.TRT01A",)),
    Variable("TRTAN", "Actual Treatment Numeric", "numeric", rule_id="COPY_ADSL", sources=("ADSL.TRT01AN",)),
    *_copied("ADSL", "COPY_ADSL", [
        ("TRTSDT", "Date of First Exposure to Treatment", "date"),
        ("TRTEDT", "Date of Last Exposure to Treatment", "date"),
        ("SAFFL", "Safety Population Flag", "character"),
    ]),
    Variable("TRTEMFL", "Treatment-Emergent Analysis Flag", rule_id="TEAE_TRT_START_TO_END_PLUS_WINDOW",
             sources=("AE.AESTDTC", "AE.AEENDTC", "ADSL.TRTSDT", "ADSL.TRTEDT")),
    Variable("AOCCFL", "First Treatment-Emergent Event Flag", rule_id="FIRST_TEAE_SUBJECT",
             sources=("ADAE.TRTEMFL", "ADAE.ASTDT", "AE.AESEQ")),
    Variable("AOCCSFL", "First Treatment-Emergent Event by System Organ Class Flag",
             rule_id="FIRST_TEAE_SUBJECT_SOC",
             sources=("ADAE.TRTEMFL", "AE.AEBODSYS", "ADAE.ASTDT", "AE.AESEQ")),
    Variable("AOCCPFL", "First Treatment-Emergent Event by Preferred Term Flag",
             rule_id="FIRST_TEAE_SUBJECT_SOC_PT",
             sources=("ADAE.TRTEMFL", "AE.AEBODSYS", "AE.AEDECOD", "ADAE.ASTDT", "AE.AESEQ")),
))


@dataclass(frozen=True)
class Treatment:
    name: str
    code: str
    number: float


@dataclass(frozen=True)
class AnalysisPlan:
    """Treatments in column order and the length of the window after last dose."""

    treatments: tuple[Treatment, ...]
    window_days: int = WINDOW_DAYS
    version: str = "0.1"

    @property
    def arms(self) -> list[str]:
        return [t.name for t in self.treatments]

    @property
    def rows(self) -> list[tuple[str, str, float]]:
        return [(t.name, t.code, t.number) for t in self.treatments]


@dataclass(frozen=True)
class Task:
    """One approved mapping: a transform from source columns to target variables."""

    id: str
    domain: str
    transform: str
    targets: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    group: str = ""

    @property
    def mapping_id(self) -> str:
        return self.group or self.id


# Labels of source columns that are shown in profiles.
SOURCE_LABELS: dict[str, str] = {
    "STUDY": "Study identifier",
    "PATNUM": "Subject identifier",
    "FIRST_DOSE_DT": "First dose date",
    "IC_DT": "Informed consent date",
    "IT.AGE": "Age",
    "IT.SEX": "Sex",
    "IT.ETHNIC": "Ethnicity",
    "IT.RACE": "Race",
    "COUNTRY": "Country",
    "PLANNED_ARM": "Planned treatment arm",
    "PLANNED_ARMCD": "Planned treatment arm code",
    "ACTUAL_ARM": "Actual treatment arm",
    "ACTUAL_ARMCD": "Actual treatment arm code",
    "IT.AETERM": "Reported adverse event term",
    "AEOUTCOME": "Adverse event outcome",
    "AEDECOD": "Coded adverse event term",
    "AEBODSYS": "Adverse event body system",
    "IT.AESEV": "Adverse event severity",
    "IT.AESER": "Serious event indicator",
    "IT.AESHOSP": "Hospitalization seriousness criterion",
    "IT.AEREL": "Adverse event relationship",
    "IT.AESTDAT": "Adverse event start date",
    "IT.AEENDAT": "Adverse event end date",
    "INSTANCE": "Visit name",
    "VTLD": "Vital signs date",
    "IT.HEIGHT_VSORRES": "Height result",
    "IT.WEIGHT": "Weight result",
    "IT.TEMP": "Temperature result",
    "SYS_BP": "Systolic blood pressure",
    "DIA_BP": "Diastolic blood pressure",
    "PULSE": "Pulse rate",
    "SUBPOS": "Body position",
}
