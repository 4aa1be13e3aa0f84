"""End to end on the raw fixture, with the published dimensions and cells."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom import specs
from cohortloom.errors import DataViolation, GateClosed
from cohortloom.operators import rules
from cohortloom.operators.aggregates import denominators
from cohortloom.operators.profile import candidate_key, grain, profile
from cohortloom.plans import lineage, study
from cohortloom.plans.example_mapping import DOMAIN_SOURCES, example_tasks
from cohortloom.plans.mapping import build_domain
from cohortloom.sources.csv_files import read_literal
from cohortloom.sources.tables import load_table, write_table
from tests.study_fixture import PLAN, write_raw


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    paths = write_raw(tmp_path_factory.mktemp("raw"))
    return {name: read_literal(spark, path) for name, path in paths.items()}


@pytest.fixture(scope="module")
def stages(spark, sources):
    return study.run_study(example_tasks(), sources, DOMAIN_SOURCES, PLAN, "run-1")


def test_mapping_size():
    tasks = example_tasks()
    assert len({t.id for t in tasks}) == 50
    assert len({(t.domain, v) for t in tasks for v in t.targets}) == 51


def test_standard_dimensions_and_no_issues(stages):
    built = stages["standard"].tables
    assert {n: (df.count(), len(df.columns)) for n, df in built.items()} == {"DM": (6, 18), "AE": (9, 17), "VS": (60, 16)}
    assert stages["standard"].issues.count() == 0
    for name, df in built.items():
        assert df.columns == specs.DOMAINS[name].order


def test_standard_values(stages):
    built = stages["standard"].tables
    dm = {r["USUBJID"]: r for r in built["DM"].collect()}
    first = dm["ST01-11-001"]
    assert (first["SITEID"], first["AGE"], first["SEX"], first["RFSTDTC"]) == ("11", 42.0, "F", "2025-03-03")
    ae = {(r["USUBJID"], int(r["AESEQ"])): r for r in built["AE"].collect()}
    chills = ae["ST01-11-002", 2]
    assert (chills["AETERM"], chills["AEENDTC"], chills["AEENRF"], chills["AESTDY"], chills["AEENDY"]) == ("Chills", None, "ONGOING", 6.0, None)
    fatigue = ae["ST01-12-001", 1]
    assert (fatigue["AESTDY"], fatigue["AEENDY"]) == (-5.0, -4.0)
    vs = built["VS"].filter("USUBJID = 'ST01-12-002' and VISIT = 'Screening 1'").collect()
    shown = {r["VSTESTCD"]: (r["VSSTRESC"], r["VSSTRESN"], r["VSSTRESU"], r["VISITNUM"]) for r in vs}
    # one temperature has a tenth, so the whole block shows one decimal
    assert shown["TEMP"] == ("37.0", 37.0, "C", -1.0)
    assert shown["SYSBP"] == ("124", 124.0, "mmHg", -1.0)
    assert built["VS"].filter("VSPOS = 'SUPINE'").count() == 2 * 6 + 4 + 2 * 4 + 2 * 0 + 6


def test_analysis_tables(stages):
    adsl, adae = stages["analysis"].tables["ADSL"], stages["analysis"].tables["ADAE"]
    assert (adsl.count(), len(adsl.columns)) == (6, 19)
    assert (adae.count(), len(adae.columns)) == (9, 30)
    assert adae.filter("TRTEMFL = 'Y'").count() == 7
    assert [r[0] for r in adae.filter("TRTEMFL is null").select("AEDECOD").orderBy("AEDECOD").collect()] == ["COUGH", "FATIGUE"]
    assert adae.filter("TRTEMFL = 'Y'").select("USUBJID").distinct().count() == 5
    assert stages["analysis"].issues.count() == 0
    row = adsl.filter("USUBJID = 'ST01-11-002'").first()
    assert (row["TRT01PN"], row["TRTDURD"], row["ITTFL"], row["SAFFL"]) == (1.0, 29.0, "Y", "Y")


def test_summary_tables(stages):
    demo, events = stages["tables"].tables["T14.1.1"], stages["tables"].tables["T14.3.1"]
    columns = ["Placebo (N=2)", "Active 10 mg (N=4)", "Total (N=6)"]
    assert demo.columns == events.columns == ["Parameter", "Statistic", *columns]
    first = events.filter(F.col("Parameter") == "At least one treatment-emergent adverse event").first()
    assert list(first)[2:] == ["1 (50.0%)", "4 (100.0%)", "5 (83.3%)"]
    shown = [tuple(r) for r in demo.collect()]
    assert shown[:6] == [
        ("Age (years)", "N", "2", "4", "6"),
        ("", "Mean", "54.0", "42.2", "46.2"),
        ("", "Standard deviation", "17.0", "13.1", "14.1"),
        ("", "Median", "54.0", "42.0", "45.5"),
        ("", "Minimum", "42.0", "28.0", "28.0"),
        ("", "Maximum", "66.0", "57.0", "66.0"),
    ]
    assert shown[6] == ("Sex", "  F", "1 (50.0%)", "2 (50.0%)", "3 (50.0%)")
    parameters = [r["Parameter"] for r in events.collect()]
    assert parameters[1:5] == ["Nervous system disorders", "  HEADACHE", "  DIZZINESS", "General disorders"]
    assert stages["tables"].issues.count() == 0


def test_checksums_repeat(spark, sources, stages):
    again = study.standard_stage(example_tasks(), sources, DOMAIN_SOURCES)
    sums = lambda m: {r["dataset"]: r["checksum"] for r in m.collect()}
    assert sums(again.manifest) == sums(stages["standard"].manifest)


def test_gate_closes(spark, stages):
    bad = stages["standard"].tables["DM"].withColumn("SEX", F.lit("INVALID"))
    issues = rules.validate_domain(bad, specs.DM)
    with pytest.raises(GateClosed):
        study.analysis_stage(study.Stage(stages["standard"].tables, issues, stages["standard"].manifest), PLAN)


def test_violation_stops_the_build(spark, sources):
    broken = dict(sources)
    broken["dm_raw"] = sources["dm_raw"].withColumn("IT.SEX", F.lit("Other"))
    with pytest.raises(DataViolation) as caught:
        build_domain("DM", example_tasks(), broken, "dm_raw")
    assert caught.value.counts == {"DM_SEX": 6} and caught.value.examples == {"DM_SEX": ["Other"]}


def _change(df, column, value, row):
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(row, F.lit(value).cast(kind)).otherwise(F.col(column)))


def test_source_mutations(stages):
    built = stages["standard"].tables
    ids = lambda df: {r[0] for r in df.select("rule_id").distinct().collect()}
    one = (F.col("USUBJID") == "ST01-11-002") & (F.col("AESEQ") == 2)
    assert "LOCAL006" in ids(rules.validate_domain(_change(built["DM"], "SEX", "INVALID", F.col("SUBJID") == "11-001"), specs.DM))
    assert "LOCAL011" in ids(rules.sequence_issues(_change(built["AE"], "AESEQ", 1.0, one), specs.AE, "AESEQ"))
    reversed_dates = _change(built["AE"], "AEENDTC", "2024-12-01", F.col("AETERM") == "Nausea")
    assert ids(rules.row_issues(reversed_dates, specs.AE, [rules.event_date_rule()])) == {"LOCAL012"}
    unknown = _change(built["AE"], "USUBJID", "ST01-X", one)
    assert rules.orphan_issues(unknown, built["DM"], specs.AE).select("rule_id", "record_key").collect() == [("LOCAL010", "ST01 | ST01-X | 2")]
    unit = _change(built["VS"], "VSORRESU", "unknown-unit", (F.col("USUBJID") == "ST01-11-001") & (F.col("VSSEQ") == 1))
    assert ids(rules.row_issues(unit, specs.VS, rules.test_pair_rules())) == {"LOCAL016"}
    partial = _change(_change(built["AE"], "AESTDTC", "2025-01", one), "AESTDY", 1.0, one)
    assert ids(rules.row_issues(partial, specs.AE, [rules.study_day_rule("AESTDTC", "AESTDY")])) == {"LOCAL017"}


def test_analysis_mutations(stages):
    adsl, adae = stages["analysis"].tables["ADSL"], stages["analysis"].tables["ADAE"]
    ae = stages["standard"].tables["AE"]
    one = (F.col("USUBJID") == "ST01-11-001") & (F.col("AESEQ") == 1)

    def ids(df):
        return {r["rule_id"]: r["actual_value"] for r in rules.validate_event_table(df, ae, adsl, PLAN).collect()}

    def keys(df):
        return {(r["rule_id"], r["offender"]) for r in rules.event_table_offenders(df, adsl, PLAN).collect()}

    unknown = _change(adae, "USUBJID", "ST01-X", one)
    assert ids(unknown)["ADAE002"] == "1" and ("ADAE002", "ST01-X") in keys(unknown)
    repeated = rules.analysis_structure(adae.unionByName(adae.filter(one)), specs.ADAE).collect()
    assert [(r["rule_id"], r["actual_value"]) for r in repeated] == [("ADAM002", "1")]
    wrong_end = adae.withColumn("AENDT", F.when(one, F.date_sub("ASTDT", 1)).otherwise(F.col("AENDT")))
    assert ids(wrong_end)["ADAE003"] == "1" and ("ADAE003", "ST01-11-001/1") in keys(wrong_end)
    wrong_flag = ids(_change(adae, "TRTEMFL", "N", one))
    assert {"ADAE004", "ADAE005"} <= set(wrong_flag) and wrong_flag["ADAE004"] == ""
    treated = _change(adae, "TRTAN", 99.0, one)
    assert ids(treated) == {"ADAE006": "1"} and keys(treated) == {("ADAE006", "ST01-11-001")}
    assert set(ids(_change(adae, "AOCCFL", None, one))) == {"ADAE007"}


def test_round_trip(spark, stages, tmp_path):
    adsl = stages["analysis"].tables["ADSL"]
    write_table(adsl, str(tmp_path / "adsl"), str(tmp_path / "adsl_csv"))
    back = load_table(spark, str(tmp_path / "adsl"))
    assert back.columns == specs.ADSL.order
    assert isinstance(back.schema["TRTSDT"].dataType, T.DateType)
    assert back.schema["AGE"].metadata["label"] == "Age"
    assert rules.analysis_structure(back, specs.ADSL).count() == 0
    text = read_literal(spark, str(tmp_path / "adsl_csv"), specs.ADSL.order)
    assert {r["TRTSDT"] for r in text.collect()} == {str(r["TRTSDT"]) for r in adsl.collect()}


def test_profile_of_raw(spark, sources):
    dm = sources["dm_raw"]
    keys = candidate_key(dm)
    assert keys == ["PATNUM"] and grain(keys) == "one_record_per_candidate_key"
    rows = {r["source_variable"]: r for r in profile(dm, "dm_raw", "_source_row", specs.SOURCE_LABELS, keys).collect()}
    assert len(rows) == 15
    assert rows["FIRST_DOSE_DT"]["format_candidates"] == "m/d/y_or_d/m/y"
    assert rows["IC_DT"]["format_candidates"] == "m/d/y"
    assert rows["IT.SEX"]["example_values"] == "Female | Male"
    assert rows["PATNUM"]["is_identifier"] and rows["PATNUM"]["label"] == "Subject identifier"


def test_lineage(spark, stages):
    tasks = lineage.task_table(spark, example_tasks(), DOMAIN_SOURCES)
    rows = lineage.field_lineage(tasks, stages["standard"].manifest).collect()
    assert len(rows) == 56
    usubjid = next(r for r in rows if r["task_id"] == "AE_USUBJID")
    assert usubjid["source_fields"] == ["ae_raw.STUDY", "ae_raw.PATNUM"] and usubjid["records_created"] == 9
    variables = lineage.variable_lineage(spark, specs.ADAE, PLAN, study.manifests({**stages["standard"].tables, **stages["analysis"].tables}))
    flags = {r["target_variable"]: r for r in variables.collect()}
    assert len(flags) == 30 and set(flags["TRTEMFL"]["input_checksums"]) == {"AE", "ADSL"}
    tables = lineage.table_lineage(spark, stages["tables"].manifest, PLAN).collect()
    assert all(r["result_checksum"] for r in tables) and len(tables) == 2


def test_unregistered_arm_is_refused(stages):
    with pytest.raises(ValueError):
        denominators(stages["analysis"].tables["ADSL"], "TRT01P", "USUBJID", ["Placebo"])


def test_missing_analysis_table(spark):
    assert [r["rule_id"] for r in rules.validate_analysis({}, {}, PLAN, spark).collect()] == ["ADAM000"]
