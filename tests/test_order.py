"""Output order of the display tables and of ranked rows."""

from catalog.window_queries import levels_in_order, newest_orders, ranked_parts, subjects_in_order

FOLDER = "/root/testdata/sf0.001"


def test_orders(spark):
    levels = [r["level"] for r in levels_in_order(spark, FOLDER).collect()]
    assert levels == [*sorted(levels[:-1]), "Missing"]
    ids = [r["USUBJID"] for r in subjects_in_order(spark, FOLDER).collect()]
    assert ids == sorted(ids)
    ranked = [(-r["n"], r["l_partkey"]) for r in ranked_parts(spark, FOLDER).collect()]
    assert ranked == sorted(ranked)
    assert len(newest_orders(spark, FOLDER).collect()) == 60


def test_rows_of_several_files_stand_in_file_order(spark, tmp_path):
    import pytest

    from cohortloom.sources.csv_files import ROW, read_literal

    (tmp_path / "a.csv").write_text("A,B\n1,x\n")
    (tmp_path / "b.csv").write_text("A,B\n" + "".join(f"{i},y\n" for i in range(2, 2000)))
    found = read_literal(spark, str(tmp_path), ["A", "B"]).orderBy(ROW).collect()
    assert [r["A"] for r in found] == [str(i) for i in range(1, 2000)]
    (tmp_path / "c.csv").write_text("B,A\nz,5\n")
    with pytest.raises(Exception, match="c.csv"):
        read_literal(spark, str(tmp_path), ["A", "B"]).collect()


def test_anchored_constants_and_lone_times(spark):
    from cohortloom.plans.mapping import _constant, _datetime

    df = spark.createDataFrame([("x", "08:30"), (None, "2025-01-02")], "a string, t string")
    value, _ = _constant(type("T", (), {"id": "1", "sources": ["a"], "parameters": {"value": "K"}})())
    assert [r[0] for r in df.select(value).collect()] == ["K", None]
    task = type("T", (), {"id": "2", "sources": ["t"], "parameters": {"formats": ["H:M"]}})()
    text, checks = _datetime(task)
    assert [r[0] for r in df.select(text).collect()][0] is None and checks


def test_accents_fold(spark):
    from pyspark.sql import functions as F

    from cohortloom.functions.text import norm_name

    df = spark.createDataFrame([("Prénom_Naïf-Ångström",)], "n string")
    assert df.select(norm_name(F.col("n"))).first()[0] == "PRENOMNAIFANGSTROM"
