"""Where each field, analysis variable and table comes from."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.specs import UNIT_CONVERSION_VERSION, AnalysisPlan, TableSpec, Task

TASK_SCHEMA = (
    "task_id string, assembly_group_id string, target_domain string, output_kind string, "
    "target_variables array<string>, source_fields array<string>, status string, "
    "steps array<struct<transform_id:string, target_variables:array<string>, source_refs:array<string>, "
    "parameters:map<string,string>>>"
)


def task_table(spark: SparkSession, tasks: Sequence[Task], sources: Mapping[str, str]) -> DataFrame:
    """The mapping specification as a table; one task is one row with nested steps."""
    rows = []
    for t in tasks:
        refs = [f"{sources[t.domain]}.{s}" for s in t.sources]
        parameters = {k: json.dumps(v) for k, v in t.parameters.items()}
        step = (t.transform, list(t.targets), refs, parameters)
        rows.append((t.id, t.mapping_id, t.domain, "variables", list(t.targets), refs, "approved", [step]))
    return spark.createDataFrame(rows, TASK_SCHEMA)


# Parameters that say how tables are joined, and how dates are chosen.
JOIN_PARAMETERS = ["left_dataset", "right_dataset", "by", "relationship", "join_type"]
AGGREGATION_PARAMETERS = ["selection", "subject_keys", "sources"]


def _rule(transform: str, names: Sequence[str]) -> Column:
    """The named parameters of a step of one kind of transform as JSON text, empty for other steps."""
    chosen = F.map_filter("step.parameters", lambda k, _: k.isin(list(names)))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(chosen)))
    return F.when(F.col("step.transform_id") == transform, F.to_json(ordered)).otherwise("")


def field_lineage(tasks: DataFrame, manifests: DataFrame, counts: Mapping[str, int] | None = None) -> DataFrame:
    """One row per step with its sources and targets, its rules, the rows it made, and the checksum of the table it helped to build.

    ``manifests`` (dataset, records, checksum, ...) has one row per table. ``counts`` gives the rows of each step
    (``Draft.counted``, taken while the table was written); without it a step has the rows of its table.
    """
    steps = tasks.select("task_id", F.col("assembly_group_id").alias("mapping_id"), "target_domain", "source_fields", F.explode("steps").alias("step"))
    rows = steps.select(
        "task_id", "mapping_id", "target_domain",
        F.col("step.target_variables").alias("target_variables"),
        F.array_sort(F.array_distinct(F.transform("source_fields", lambda f: F.split(f, r"\.")[0]))).alias("source_datasets"),
        "source_fields",
        _rule("merge_sources", JOIN_PARAMETERS).alias("join_rule"),
        _rule("derive_reference_datetime", AGGREGATION_PARAMETERS).alias("aggregation_rule"),
        F.col("step.transform_id").alias("transform_id"),
        F.to_json("step.parameters").alias("transform_parameters"),
        F.when(F.col("step.transform_id") == "standardize_unit", UNIT_CONVERSION_VERSION).otherwise("").alias("unit_conversion_version"),
    )
    sizes = manifests.select(F.col("dataset").alias("target_domain"), F.col("records").alias("__records"), "checksum")
    made = tasks.sparkSession.createDataFrame([(k, int(n)) for k, n in (counts or {}).items()], "__step string, __made bigint")
    # both have one row per table or step of the specification
    known = rows.join(F.broadcast(sizes), "target_domain", "left").join(
        F.broadcast(made), F.concat_ws("/", "task_id", "transform_id") == F.col("__step"), "left")
    counted = known.withColumn("records_created", F.coalesce("__made", "__records")).drop("__made", "__records", "__step")
    return counted.orderBy("target_domain", "mapping_id", "task_id", "transform_id")


def variable_lineage(spark: SparkSession, spec: TableSpec, plan: AnalysisPlan, inputs: DataFrame) -> DataFrame:
    """One row per analysis variable with its rule, its sources and the checksums of the inputs.

    ``inputs`` has one row per input table.
    """
    rows = [(spec.name, v.name, list(v.sources), v.rule_id, plan.version) for v in spec.variables]
    schema = "target_dataset string, target_variable string, source_variables array<string>, rule_id string, plan_version string"
    variables = spark.createDataFrame(rows, schema)
    used = variables.select(
        "target_dataset", "target_variable",
        F.explode(F.array_distinct(F.transform("source_variables", lambda v: F.split(v, r"\.")[0]))).alias("dataset"),
    )
    sums = used.join(F.broadcast(inputs.select("dataset", "checksum")), "dataset", "left").groupBy("target_dataset", "target_variable").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "checksum")))).alias("input_checksums")
    )
    return variables.join(sums, ["target_dataset", "target_variable"], "left")


def table_lineage(spark: SparkSession, outputs: DataFrame, plan: AnalysisPlan) -> DataFrame:
    """One row per summary table with its shell rule, population and result checksum."""
    # Table id, sources, shell rule, population, treatment basis.
    rows = [
        ("T14.1.1", ["ADSL"], "T_DEMOGRAPHICS_STANDARD", "Intent-to-treat population", "planned", plan.version),
        ("T14.3.1", ["ADSL", "ADAE"], "T_TEAE_SOC_PT", "Safety population", "actual", plan.version),
    ]
    schema = (
        "table_id string, source_datasets array<string>, shell_rule_id string, population string, "
        "treatment_basis string, plan_version string"
    )
    sums = outputs.select(F.col("dataset").alias("table_id"), F.col("checksum").alias("result_checksum"))
    return spark.createDataFrame(rows, schema).join(F.broadcast(sums), "table_id", "left")


def lineage_rows(spark: SparkSession, tasks: Sequence[Task]) -> DataFrame:
    """(target_domain, target_variables, mapping_id) per task, for finding the ids behind a variable."""
    rows = [(t.domain, list(t.targets), t.mapping_id) for t in tasks]
    return spark.createDataFrame(rows, "target_domain string, target_variables array<string>, mapping_id string")

