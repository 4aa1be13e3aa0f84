"""A complete mapping of three raw sources to DM, AE and VS: 50 tasks for 51 variables."""

from __future__ import annotations

from cohortloom.specs import TEST_PAIRS, Task

DOMAIN_SOURCES = {"DM": "dm_raw", "AE": "ae_raw", "VS": "vs_raw"}

# Plain copies, target -> source column.
COPIES = {
    "DM": {
        "STUDYID": "STUDY", "SUBJID": "PATNUM", "AGE": "IT.AGE", "ARMCD": "PLANNED_ARMCD", "ARM": "PLANNED_ARM",
        "ACTARMCD": "ACTUAL_ARMCD", "ACTARM": "ACTUAL_ARM", "COUNTRY": "COUNTRY",
    },
    "AE": {"STUDYID": "STUDY", "AETERM": "IT.AETERM", "AEDECOD": "AEDECOD", "AEBODSYS": "AEBODSYS"},
    "VS": {"STUDYID": "STUDY", "VISIT": "INSTANCE"},
}
# Coded terms, target -> (source column, codelist).
TERMS = {
    "DM": {"SEX": ("IT.SEX", "SEX"), "RACE": ("IT.RACE", "RACE"), "ETHNIC": ("IT.ETHNIC", "ETHNIC")},
    "AE": {
        "AESEV": ("IT.AESEV", "AESEV"), "AESER": ("IT.AESER", "NY"), "AEREL": ("IT.AEREL", "AEREL"),
        "AEOUT": ("AEOUTCOME", "AEOUT"), "AESHOSP": ("IT.AESHOSP", "NY"),
    },
    "VS": {"VSPOS": ("SUBPOS", "VSPOS")},
}
# Complete dates, target -> (source column, format).
DATES = {
    "DM": {"RFSTDTC": ("FIRST_DOSE_DT", "m/d/y"), "RFENDTC": ("LAST_DOSE_DT", "m/d/y"), "RFICDTC": ("IC_DT", "m/d/y")},
    "AE": {"AESTDTC": ("IT.AESTDAT", "m/d/y"), "AEENDTC": ("IT.AEENDAT", "m/d/y")},
    "VS": {"VSDTC": ("VTLD", "dd-mmm-yyyy")},
}
# Wide result columns, test code -> source column.
RESULTS = {
    "SYSBP": "SYS_BP", "DIABP": "DIA_BP", "PULSE": "PULSE", "HEIGHT": "IT.HEIGHT_VSORRES", "WEIGHT": "IT.WEIGHT", "TEMP": "IT.TEMP",
}
# What orders the sequence numbers.
SEQUENCES = {
    "AE": ("AESEQ", ["STUDYID", "USUBJID", "AESTDTC", "AETERM", ".SOURCE_ROW"]),
    "VS": ("VSSEQ", ["STUDYID", "USUBJID", "VSDTC", "VSTESTCD", ".SOURCE_ROW"]),
}
STUDY_DAYS = {"AE": {"AESTDY": "AESTDTC", "AEENDY": "AEENDTC"}, "VS": {"VSDY": "VSDTC"}}


def example_tasks() -> list[Task]:
    tasks = []

    def add(domain: str, target: str, transform: str, sources: tuple[str, ...] = (), **parameters) -> None:
        tasks.append(Task(f"{domain}_{target}", domain, transform, (target,), sources, parameters))

    for domain in DOMAIN_SOURCES:
        add(domain, "DOMAIN", "hardcode_no_ct", value=domain)
        add(domain, "USUBJID", "derive_usubjid", ("STUDY", "PATNUM"), separator="-")
        for target, source in COPIES[domain].items():
            add(domain, target, "assign_no_ct", (source,))
        for target, (source, codelist) in TERMS[domain].items():
            add(domain, target, "assign_ct", (source,), codelist_id=codelist)
        for target, (source, fmt) in DATES[domain].items():
            add(domain, target, "to_iso8601_date", (source,), formats=[fmt])
    add("DM", "SITEID", "extract_delimited_part", ("PATNUM",), separator="-", position=1)
    add("DM", "AGEU", "hardcode_ct", value="YEARS", codelist_id="AGEU")
    add("AE", "AEENRF", "derive_ongoing_flag", ("IT.AEENDAT",), ongoing_value="ONGOING", affirmative_values=[])
    add("VS", "VISITNUM", "derive_visitnum", ("INSTANCE",), visit_map_id="visits_v1")
    for code, source in RESULTS.items():
        name, unit = TEST_PAIRS[code]
        tasks.append(Task(
            f"VS_{code}", "VS", "transpose_findings", ("VSTESTCD", "VSTEST", "VSORRES", "VSORRESU"), (source,),
            {"test_code": code, "test_name": name, "original_unit": unit, "unit_source": None},
        ))
        # the second step of the same task
        tasks.append(Task(
            f"VS_{code}", "VS", "standardize_unit", ("VSSTRESC", "VSSTRESN", "VSSTRESU"), (source,),
            {"conversion_set_id": "vs_standard_v1", "target_unit": unit},
        ))
    for domain, (target, order) in SEQUENCES.items():
        add(domain, target, "derive_sequence", record_variables=order, start_at=1)
    for domain, days in STUDY_DAYS.items():
        for target, date in days.items():
            add(domain, target, "derive_study_day", target_date=date, reference_date="RFSTDTC")
    return tasks
