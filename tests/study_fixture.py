"""A small invented study in the raw shape: 6 subjects in two arms, 9 events, 12 visits."""

import csv
from pathlib import Path

from cohortloom.specs import AnalysisPlan, Treatment

PLAN = AnalysisPlan((Treatment("Placebo", "PBO", 0), Treatment("Active 10 mg", "ACT10", 1)))

DM_COLUMNS = ["STUDY", "PATNUM", "FIRST_DOSE_DT", "LAST_DOSE_DT", "IC_DT", "IT.AGE", "IT.SEX", "IT.ETHNIC", "IT.RACE",
              "COUNTRY", "PLANNED_ARM", "PLANNED_ARMCD", "ACTUAL_ARM", "ACTUAL_ARMCD", "COL_DT"]
_PBO, _ACT = ["Placebo", "PBO"] * 2, ["Active 10 mg", "ACT10"] * 2
DM_ROWS = [
    ["ST01", "11-001", "03/03/2025", "03/31/2025", "02/17/2025", "42", "Female", "Not Hispanic or Latino", "White", "USA", *_PBO, "02/17/2025"],
    ["ST01", "11-002", "03/04/2025", "04/01/2025", "02/18/2025", "57", "Male", "Hispanic or Latino", "Asian", "USA", *_ACT, "02/18/2025"],
    ["ST01", "11-003", "03/05/2025", "04/02/2025", "02/19/2025", "35", "Female", "Not Hispanic or Latino", "Black or African American", "CAN", *_ACT, "02/19/2025"],
    ["ST01", "12-001", "03/06/2025", "04/03/2025", "02/20/2025", "66", "Male", "Unknown", "White", "GBR", *_PBO, "02/20/2025"],
    ["ST01", "12-002", "03/07/2025", "04/04/2025", "02/21/2025", "49", "Female", "Hispanic or Latino", "Multiple", "GBR", *_ACT, "02/21/2025"],
    ["ST01", "12-003", "03/10/2025", "04/07/2025", "02/24/2025", "28", "Male", "Not Hispanic or Latino", "American Indian or Alaska Native", "USA", *_ACT, "02/24/2025"],
]

AE_COLUMNS = ["STUDY", "PATNUM", "FOLDER", "FOLDERL", "IT.AETERM", "AEOUTCOME", "AEDECOD", "AEBODSYS", "IT.AESEV",
              "IT.AESER", "IT.AESHOSP", "IT.AEREL", "IT.AESTDAT", "IT.AEENDAT"]


def _event(subject, term, soc, severity, serious, related, start, end, outcome="Recovered/Resolved"):
    return ["ST01", subject, "AE", "Adverse Events", term, outcome, term.upper(), soc, severity, serious, serious, related, start, end]


_MILD, _MODERATE, _SEVERE = "Mild Adverse Event", "Moderate Adverse Event", "Severe Adverse Event"
NERVOUS, GASTRIC, GENERAL = "Nervous system disorders", "Gastrointestinal disorders", "General disorders"
AE_ROWS = [
    _event("11-001", "Headache", NERVOUS, _MILD, "No", "Possibly Related", "03/04/2025", "03/05/2025"),
    _event("11-002", "Nausea", GASTRIC, _MODERATE, "No", "Probably Related", "03/06/2025", "03/08/2025"),
    _event("11-002", "Chills", GENERAL, _MILD, "No", "Probably Related", "03/09/2025", "", "Not Recovered/not Resolved"),
    _event("11-003", "Dizziness", NERVOUS, _MILD, "No", "Unlikely Related", "03/08/2025", "03/08/2025"),
    # ends before the first dose
    _event("12-001", "Fatigue", GENERAL, _MODERATE, "No", "Possibly Related", "03/01/2025", "03/02/2025"),
    _event("12-002", "Rash", "Skin disorders", _SEVERE, "Yes", "Probably Related", "03/11/2025", "03/15/2025"),
    # starts after the 30-day window
    _event("12-002", "Cough", "Respiratory disorders", _MILD, "No", "Unlikely Related", "05/10/2025", "05/11/2025"),
    _event("12-003", "Headache", NERVOUS, _MILD, "No", "Not Related", "03/12/2025", "03/12/2025"),
    _event("12-003", "Pyrexia", GENERAL, _MODERATE, "No", "Possibly Related", "03/14/2025", "03/15/2025"),
]

VS_COLUMNS = ["STUDY", "PATNUM", "INSTANCE", "FORM", "FORML", "VTLD", "IT.HEIGHT_VSORRES", "IT.WEIGHT", "IT.TEMP",
              "IT.TEMP_LOC", "TMPTC", "SYS_BP", "DIA_BP", "PULSE", "SUBPOS"]


def _visit(subject, visit, day, height, weight, temp, systolic, diastolic, pulse, position):
    return ["ST01", subject, visit, "VS", "Vital Signs", day, height, weight, temp, "ORAL", "After Rest", systolic, diastolic, pulse, position]


VS_ROWS = [
    _visit("11-001", "Screening 1", "17-Feb-2025", "168", "68", "36.7", "122", "78", "64", "SUPINE"),
    _visit("11-002", "Screening 1", "18-Feb-2025", "181", "86", "36.5", "130", "82", "72", "SITTING"),
    _visit("11-003", "Screening 1", "19-Feb-2025", "159", "55", "36.8", "116", "74", "68", "Supine"),
    _visit("12-001", "Screening 1", "20-Feb-2025", "174", "79", "36.6", "138", "86", "70", "SITTING"),
    _visit("12-002", "Screening 1", "21-Feb-2025", "165", "62", "37.0", "124", "80", "76", "STANDING"),
    _visit("12-003", "Screening 1", "24-Feb-2025", "177", "74", "36.4", "118", "76", "62", "SUPINE"),
    _visit("11-001", "Week 2", "17-Mar-2025", "", "", "36.6", "120", "76", "62", "SUPINE"),
    _visit("11-002", "Week 2", "18-Mar-2025", "", "", "36.7", "128", "80", "70", "SITTING"),
    _visit("11-003", "Week 2", "19-Mar-2025", "", "", "36.5", "114", "72", "66", "SUPINE"),
    _visit("12-001", "Week 2", "20-Mar-2025", "", "", "36.8", "136", "84", "68", "SITTING"),
    _visit("12-002", "Week 2", "21-Mar-2025", "", "", "36.9", "122", "78", "74", "STANDING"),
    _visit("12-003", "Week 2", "24-Mar-2025", "", "", "36.5", "116", "74", "60", "SUPINE"),
]

RAW = {"dm_raw": (DM_COLUMNS, DM_ROWS), "ae_raw": (AE_COLUMNS, AE_ROWS), "vs_raw": (VS_COLUMNS, VS_ROWS)}


def write_raw(folder: Path) -> dict[str, str]:
    paths = {}
    for name, (columns, rows) in RAW.items():
        path = folder / f"{name}.csv"
        with path.open("w", newline="") as handle:
            writer = csv.writer(handle)
            writer.writerow(columns)
            writer.writerows(rows)
        paths[name] = str(path)
    return paths
