"""Scalar functions on small frames with answers worked out by hand or by plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.errors import ContractError, DataViolation
from cohortloom.functions import conditions, dates, numbers, text
from cohortloom.operators import joins, reshape, schema
from cohortloom.operators.profile import infer_date_formats
from cohortloom.plans.mapping import COLUMN_TRANSFORMS, TRANSFORMS, build_domain, constant_from_codelist
from cohortloom.sources import csv_files
from cohortloom.specs import Task


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, fn, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(fn(F.col("x"))).collect()]


def test_one_decimal_matches_c_formatting(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1e4, 1e4) for _ in range(500)] + [rng.randrange(-2000, 2000) / 20 for _ in range(500)]
    values += [100 * rng.randrange(1, 400) / rng.randrange(400, 4000) for _ in range(500)] + [0.15, 0.25, 0.05, 6.25, 0.0, 99.95, 1e15]
    assert apply(spark, values, numbers.one_decimal, "double") == ["%.1f" % v for v in values]


def test_round_half_even(spark):
    values = [2.5, 3.5, -2.5, 0.15, 0.25, 0.35, None]
    assert apply(spark, values, lambda c: numbers.round_half_even(c, 0), "double") == [2.0, 4.0, -2.0, 0.0, 0.0, 0.0, None]
    assert apply(spark, values, lambda c: numbers.round_half_even(c, 1), "double") == [2.5, 3.5, -2.5, 0.1, 0.2, 0.3, None]


def test_count_percent(spark):
    df = spark.createDataFrame([(1, 2), (5, 6), (0, 0), (3, None), (1, 16)], "n int, d int")
    shown = [r[0] for r in df.select(numbers.count_percent(F.col("n"), F.col("d"))).collect()]
    assert shown == ["1 (50.0%)", "5 (83.3%)", "0 (NA)", "3 (NA)", "1 (6.2%)"]


def test_decimals_of_a_number(spark):
    assert apply(spark, [37.0, 36.5, 1234567.5, 123456.5, -0.5], numbers.decimals_needed, "double") == [0, 1, 0, 1, 1]


def test_complete_dates(spark):
    values = ["01/05/2025", "1/5/2025", "13/05/2025", "02/30/2025", "UNK/05/2025", "2025-01-05", None, ""]
    found = apply(spark, values, lambda c: dates.iso_date_text(c, ["m/d/y"]))
    assert found == ["2025-01-05", "2025-01-05", None, None, None, None, None, None]
    bad = apply(spark, values, lambda c: dates.unreadable_date(c, dates.iso_date_text(c, ["m/d/y"])))
    assert bad == [False, False, True, True, True, True, False, True]
    assert apply(spark, ["5-1-2025", "05/01/2025"], lambda c: dates.iso_date_text(c, ["d-m-y"])) == ["2025-01-05"] * 2
    assert apply(spark, ["20-DEC-2024", "20-Foo-2024"], lambda c: dates.iso_date_text(c, ["dd-mmm-yyyy"])) == ["2024-12-20", None]
    with pytest.raises(ContractError):
        dates.iso_date_text(F.lit("x"), ["y/d/m"])


def test_partial_dates(spark):
    values = ["UNK-JAN-2025", "UNK-UNK-2025", "15-UNK-2025", "UNK-UNK-UNK", "05-Feb-2025", "05-FEB-UNK", "5-feb-2025", "x", None]
    found = apply(spark, values, lambda c: dates.iso_partial_text(c, ["dd-mmm-yyyy"], None, ["UNK"]))
    assert found == ["2025-01", "2025", "2025---15", None, "2025-02-05", "--02-05", "2025-02-05", None, None]
    # the known day under an unknown month is kept by the conversion and refused by the date check
    assert apply(spark, ["2025---15", "2025-01", "2025-02-30", "", None], dates.iso_valid) == [False, True, False, True, True]


def test_date_with_time(spark):
    df = spark.createDataFrame([("01/05/2025", "8:05"), ("01/05/2025", "UN:UN"), ("01/05/2025", "13:UN"), ("UN/UN/2025", "UN:UN"), ("01/05/2025", None), ("01/05/2025", "late")], "d string, t string")
    found = [r[0] for r in df.select(dates.iso_datetime_text(F.col("d"), ["m/d/y", "H:M"], F.col("t"))).collect()]
    assert found == ["2025-01-05T08:05", "2025-01-05", "2025-01-05T13", "2025", "2025-01-05", None]
    with pytest.raises(ContractError):
        dates.iso_datetime_text(F.col("d"), ["m/d/y"], F.col("t"))


def test_study_day_has_no_zero(spark):
    df = spark.createDataFrame([("2025-01-06",), ("2025-01-05",), ("2025-01-04",), ("2025-01",)], "d string")
    day = dates.study_day(dates.iso_to_date(F.col("d")), F.to_date(F.lit("2025-01-05")))
    assert [r[0] for r in df.select(day).collect()] == [2, 1, -1, None]


def test_treatment_window(spark):
    rows = [
        ("2025-01-10", None, None, None, None),  # never dosed
        ("2025-01-01", "2025-01-02", "2025-01-05", "2025-02-01", None),  # over before the first dose
        (None, None, "2025-01-05", "2025-02-01", "Y"),  # unknown start
        ("2025-01-05", None, "2025-01-05", "2025-02-01", "Y"),
        ("2025-03-03", None, "2025-01-05", "2025-02-01", "Y"),  # last day of the window
        ("2025-03-04", None, "2025-01-05", "2025-02-01", None),
        ("2025-01-04", "2025-01-06", "2025-01-05", "2025-02-01", None),  # started before, still going on
        ("2025-01-06", None, "2025-01-05", None, None),  # no last dose
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    flag = dates.treatment_emergent(*[F.to_date(c) for c in "abcd"], 30)
    assert [r[0] for r in df.select(flag).collect()] == [r[4] for r in rows]


def test_combining_and_splitting(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", None, 2)], "x string, y string, n int")
    strict = text.combine([F.col("x"), F.col("y"), F.col("n")], "-")
    loose = text.combine([F.col("x"), F.col("y"), F.col("n")], "-", "skip_missing")
    assert [tuple(r) for r in df.select(strict, loose).collect()] == [("a-b-1", "a-b-1"), (None, "a-2")]
    assert apply(spark, ["701.1001", "701", None], lambda c: text.part(c, ".", 2)) == ["1001", None, None]
    with pytest.raises(ContractError):
        text.combine([F.col("x")], "-", "guess")


def test_coalesce_and_conflict(spark):
    df = spark.createDataFrame([(" ", "b"), ("a", "b"), ("a", "a"), (None, None), (None, "")], "x string, y string")
    got = df.select(text.coalesce_fields([F.col("x"), F.col("y")]), text.fields_disagree([F.col("x"), F.col("y")])).collect()
    assert [tuple(r) for r in got] == [("b", True), ("a", True), ("a", False), (None, False), ("", False)]


def test_names(spark):
    assert apply(spark, ["My File (1)", "2024 data", "__x__", "??"], text.slug)[:3] == ["my_file_1", "d_2024_data", "x"]
    assert apply(spark, ["??"], text.slug)[0].startswith("dataset_")
    assert apply(spark, ["a" * 60], text.slug) == ["a" * 48]
    roles = ["STUDYID", "patnum", "Centre", "VISITDAT", "EXSTTIM", "X"]
    assert apply(spark, roles, text.field_role) == ["study_identifier", "subject_identifier", "site_identifier", "date", "time", ""]
    assert apply(spark, ["IT.AGE", "A_b.c"], lambda c: text.field_label(c, specs.SOURCE_LABELS)) == ["Age", "A b c"]


def test_secrets(spark):
    values = ["x sk-abcdefghijklmnop1 y", "api_key = 'abcdefghijklmnopq'", "API-KEY:abcdefghijklmnopq", "sk-short", "hunter2", None]
    assert apply(spark, values, lambda c: text.has_secret(c, literals=["hunter2"])) == [True, True, True, False, True, False]
    assert apply(spark, ["a hunter2 b hunter2"], lambda c: text.redact(c, ["hunter2", ""])) == ["a [REDACTED] b [REDACTED]"]


def test_conditions(spark):
    values = ["F", " ", None]
    assert apply(spark, values, lambda c: conditions.conditional_assign(conditions.condition(c, "equals", "F"), 1, 0)) == [1, 0, 0]
    assert apply(spark, values, conditions.ongoing_flag) == [None, "ONGOING", "ONGOING"]
    with pytest.raises(ContractError):
        conditions.condition(F.col("x"), "matches", ".*")


def test_name_similarity(spark):
    df = spark.createDataFrame([("IT.AGE",), ("age",), ("I-T AGE",), ("WEIGHT",)], "w string")
    found = {r["w"]: (r["suggested"], r["score"]) for r in joins.match_names(df, "w", ["IT.AGE", "AGE", "HEIGHT"]).collect()}
    assert found == {"IT.AGE": ("IT.AGE", 1.0), "age": ("AGE", 0.99), "I-T AGE": ("IT.AGE", 0.97), "WEIGHT": ("HEIGHT", 0.833)}


def test_terms_and_visits(spark):
    df = column(spark, ["Female", "Male", " ", None])
    assert [r["s"] for r in joins.map_terms(df, "x", "s", "SEX").orderBy("i").collect()] == ["F", "M", None, None]
    with pytest.raises(DataViolation) as caught:
        joins.map_terms(column(spark, ["Female", "Woman", "Woman"]), "x", "s", "SEX")
    assert caught.value.counts == {"s": 2} and caught.value.examples == {"s": ["Woman"]}
    with pytest.raises(DataViolation):
        joins.visit_number(column(spark, ["Week 99"]), "x", "n", "visits_v1")
    with pytest.raises(ContractError):
        joins.map_terms(df, "x", "s", "NOPE")
    with pytest.raises(ContractError):
        constant_from_codelist("MONTHS", "AGEU")


def test_unit_conversion(spark):
    rows = [("HEIGHT", "70", "inches"), ("WEIGHT", "180", "lbs"), ("TEMP", "98.6", "degF"), ("PULSE", "64.5", "beats/min")]
    df = spark.createDataFrame(rows, "t string, v string, u string")
    targets = text.text_literal_map({"HEIGHT": "cm", "WEIGHT": "kg", "TEMP": "C", "PULSE": "beats/min"})[F.col("t")]
    sets = specs.UNIT_CONVERSIONS["vs_standard_v1"]
    found = {r["t"]: r["r"] for r in joins.convert_units(df, "v", "u", "t", targets, sets, result="r").collect()}
    assert found == {"HEIGHT": 177.8, "WEIGHT": 81.6, "TEMP": 37.0, "PULSE": 64.0}
    for bad in [("HEIGHT", "tall", "cm"), ("HEIGHT", "70", "feet")]:
        with pytest.raises(DataViolation):
            joins.convert_units(spark.createDataFrame([bad], df.schema), "v", "u", "t", targets, sets)


def test_conform(spark):
    raw = spark.createDataFrame([("S", "AE", "1", "1", "x", "7")], "STUDYID string, DOMAIN string, USUBJID string, AESEQ string, AETERM string, EXTRA string")
    fitted = schema.conform(raw, specs.AE)
    assert fitted.columns == ["STUDYID", "DOMAIN", "USUBJID", "AESEQ", "AETERM"] and fitted.first()["AESEQ"] == 1.0
    assert fitted.schema["AETERM"].metadata["label"] == "Reported Term for the Adverse Event"
    with pytest.raises(ContractError):
        schema.conform(raw.drop("AETERM"), specs.AE)
    with pytest.raises(DataViolation):
        schema.conform(raw.withColumn("AESEQ", F.lit("one")), specs.AE)
    labelled = schema.apply_labels(raw, specs.AE)
    assert labelled.schema["DOMAIN"].metadata["label"] == "Domain Abbreviation"
    with pytest.raises(ValueError):
        schema.drop_source(raw, "EXTRA", "x")


def test_csv_checks(spark, tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    good = write("good.csv", '﻿a,"b, c",d\n1, x ,NA\n2,N/A,\n')
    assert csv_files.header(spark, good) == ["a", "b, c", "d"]
    assert [tuple(r) for r in csv_files.check_csv(spark, good).collect()] == [("1", " x ", None), ("2", None, None)]
    assert [tuple(r)[:3] for r in csv_files.read_literal(spark, good).collect()] == [("1", "x", None), ("2", None, None)]
    for name, content in [("blank.csv", "a,,c\n1,2,3\n"), ("twice.csv", "a,b,a\n1,2,3\n"), ("long.csv", "a,b\n1,2,3\n"), ("short.csv", "a,b\n1\n"), ("broken.csv", 'a,b\n"x\ny",2\n'), ("empty.csv", "")]:
        with pytest.raises(ContractError):
            csv_files.check_csv(spark, write(name, content))


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("n,d,b,s,e\n1,2025-01-05,TRUE,x,\n2.5,2025-01-06,FALSE,1,\nNA,NA,NA,NA,NA\n")
    assert dict(csv_files.read_inferred(spark, str(path)).dtypes) == {"n": "double", "d": "date", "b": "boolean", "s": "string", "e": "boolean"}


def test_formats(spark):
    def formats(values):
        return infer_date_formats(column(spark, values), "x").first()[0]

    assert formats(["01/05/2025"]) == "m/d/y_or_d/m/y"
    assert formats(["01/15/2025", "x"]) == "m/d/y"
    assert formats(["15/01/2025", None]) == "d-m-y"
    assert formats(["15/01/2025", "01/15/2025"]) == "mixed_m/d/y_and_d/m/y"
    assert formats(["UN-jan-2025", "2025-01-05", "8:05", "08:05:00"]) == "dd-mmm-yyyy | y-m-d | H:M:S"
    assert formats([None]) == ""


def test_same_content(spark):
    a = spark.createDataFrame([("x", None), ("y", "1"), ("y", "1")], "a string, b string")
    assert reshape.same_content(a, spark.createDataFrame([("y", "1"), ("x", ""), ("y", "1")], "a string, b string"))
    assert not reshape.same_content(a, a.distinct())
    assert not reshape.same_content(a, a.select("b", "a"))


def test_remaining_transforms(spark):
    """Transforms that the example mapping does not use."""
    assert len(TRANSFORMS) == 23 and len(COLUMN_TRANSFORMS) == 15
    raw = spark.createDataFrame(
        [("S", "1", "01/05/2025", "8:30", "UNK-JAN-2025", "yes", "x", 1), ("S", "2", "01/06/2025", None, "05-JAN-2025", None, "y", 2)],
        "STUDY string, PATNUM string, D string, T string, P string, A string, B string, _source_row int",
    )
    other = spark.createDataFrame([("1", "01/03/2025", "extra"), ("2", "02/01/2025", "more")], "PATNUM string, EX string, COUNTRY string")
    tasks = [
        Task("m", "DM", "merge_sources", (), (), {"left_dataset": "raw", "right_dataset": "ex", "output_dataset": "both", "by": {"PATNUM": "PATNUM"},
             "relationship": "one-to-one", "select": ["COUNTRY"]}),
        Task("1", "DM", "assign_no_ct", ("STUDYID",), ("STUDY",)),
        Task("2", "DM", "hardcode_no_ct", ("DOMAIN",), (), {"value": "DM"}),
        Task("3", "DM", "combine_fields", ("USUBJID",), ("STUDY", "PATNUM"), {"separator": "/", "missing_policy": "return_missing"}),
        Task("4", "DM", "assign_no_ct", ("SUBJID",), ("PATNUM",)),
        Task("5", "DM", "derive_reference_datetime", ("RFSTDTC",), (), {"selection": "min", "subject_keys": ["PATNUM"], "sources": [
            {"dataset": "raw", "date_variable": "D", "time_variable": "T", "date_formats": ["m/d/y"], "time_formats": ["H:M"]},
            {"dataset": "ex", "date_variable": "EX", "date_formats": ["m/d/y"]}]}),
        Task("6", "DM", "to_iso8601_datetime", ("RFENDTC",), ("D", "T"), {"formats": ["m/d/y", "H:M"]}),
        Task("7", "DM", "to_iso8601_partial_datetime", ("RFICDTC",), ("P",), {"formats": ["dd-mmm-yyyy"], "unknown_tokens": ["UNK"]}),
        Task("8", "DM", "coalesce_fields", ("SITEID",), ("A", "B"), {"priority": ["A", "B"]}),
        Task("9", "DM", "normalize_case", ("ARM",), ("B",), {"case": "upper"}),
        Task("10", "DM", "conditional_assign", ("SEX",), ("A",), {"condition": {"operator": "is_missing", "variable": "A", "compare_to": None}, "value": "F", "else_value": "M"}),
        Task("11", "DM", "assign_no_ct", ("COUNTRY",), ("COUNTRY",)),
        Task("12", "DM", "do_not_map", (), ("P",), {"reason": "not used"}),
    ]
    rows = {r["SUBJID"]: r for r in build_domain("DM", tasks, {"raw": raw, "ex": other}, "raw").collect()}
    one, two = rows["1"], rows["2"]
    assert (one["USUBJID"], one["RFSTDTC"], one["RFENDTC"], one["RFICDTC"], one["SITEID"], one["ARM"], one["SEX"], one["COUNTRY"]) == (
        "S/1", "2025-01-03", "2025-01-05T08:30", "2025-01", "yes", "X", "M", "extra")
    assert (two["RFSTDTC"], two["RFENDTC"], two["SITEID"], two["SEX"]) == ("2025-01-06", "2025-01-06", "y", "F")
    with pytest.raises(ContractError):
        build_domain("DM", [Task("x", "DM", "run_code", ("A",))], {"raw": raw}, "raw")
