"""Profiles that add up, and keys that are refuted by proof."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import profile as profiling


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, f"name {i % 5000}", None if i % 7 == 0 else f"{1 + i % 28:02d}/{1 + i % 12:02d}/2024", "UNK-JAN-2025" if i == 5 else "x") for i in range(20_000)]
    return spark.createDataFrame(rows, "id int, name string, day string, part string").repartition(6)


def test_sketches_of_parts_add_up_to_the_whole(spark, df, tmp_path):
    path = str(tmp_path / "sketches")
    for k in range(4):  # files that come one after the other
        profiling.sketches(df.where(F.col("id") % 4 == k), F.lit(f"f{k}"), "id").write.mode("append").parquet(path)
    added = {r["source_variable"]: r for r in profiling.profile_of(spark.read.parquet(path), "t").collect()}
    whole = {r["source_variable"]: r for r in profiling.profile_of(profiling.sketches(df, None, "id"), "t").collect()}
    exact = {r["source_variable"]: r for r in profiling.profile(df, "t", "id").collect()}
    assert set(added) == set(exact) == {"id", "name", "day", "part"}
    for name, e in exact.items():
        a, w = added[name], whole[name]
        for field in ("record_count", "missing_rate", "format_candidates", "partial_tokens", "data_type", "concept_roles"):
            assert a[field] == w[field] == e[field], (name, field)
        assert abs(a["unique_count"] - e["unique_count"]) <= 0.06 * e["unique_count"] + 1
        assert abs(a["unique_count"] - w["unique_count"]) <= 0.03 * e["unique_count"] + 1
    assert added["part"]["example_values"] == exact["part"]["example_values"]
    assert len(added["name"]["example_values"].split(" | ")) == 5


def test_merging_is_free_of_order(spark, df):
    parts = [profiling.sketches(df.where(F.col("id") % 3 == k), F.lit(f"f{k}"), "id") for k in range(3)]
    one = profiling.profile_of(parts[0].union(parts[1]).union(parts[2]), "t").orderBy("source_variable").collect()
    other = profiling.profile_of(parts[2].union(parts[0]).union(parts[1]), "t").orderBy("source_variable").collect()
    assert one == other


def test_one_repeat_refutes_a_key(spark):
    n = 60_000
    once = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") == n - 1, 0).otherwise(F.col("id")).alias("seq"))
    twice = once.withColumn("row_id", F.when(F.col("row_id") == n - 1, 0).otherwise(F.col("row_id"))).repartition(8)
    # both columns look unique to any estimate; one value of each is there twice, in rows of different partitions
    assert profiling.candidate_key(once.repartition(8)) == ["row_id"]
    assert profiling.candidate_key(twice) == []
    assert profiling.candidate_key(twice.withColumn("site", F.when(F.col("row_id") == 0, F.monotonically_increasing_id()).otherwise(1))) == ["row_id", "site"]


def test_blank_values_are_no_key(spark):
    rows = spark.createDataFrame([("a", "1"), (" ", "2"), ("b", "2")], "id string, n string")
    assert profiling.candidate_key(rows) == []
    assert profiling.candidate_key(rows.where("id <> ' '")) == ["id"]


def test_formats_of_whole_texts(spark):
    long = " " * 200 + "2024-01-02"
    df = spark.createDataFrame([(long,), ("2024-01-02" + "x" * 300,)], "t string")
    assert profiling.infer_date_formats(df, "t").first()["formats"] == "y-m-d"
    assert profiling.profile(df.limit(1), "d").first()["format_candidates"] == ""
