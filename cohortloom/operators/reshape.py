"""Wide to long, stacking, comparing, display tables, flattening a nested plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.functions.conditions import is_blank
from cohortloom.functions.text import unit_alias
from cohortloom.operators.skew import running_total
from cohortloom.session import ROW_ID, held


@dataclass(frozen=True)
class Finding:
    """One wide result column and what it becomes in the long table."""

    column: str
    code: str
    name: str
    unit: str | None = None
    unit_column: str | None = None


def transpose_findings(
    df: DataFrame,
    findings: Sequence[Finding],
    keep: Sequence[str],
    names: Mapping[str, str] | None = None,
    aliases: Mapping[str, str] = specs.UNIT_ALIASES,
) -> DataFrame:
    """Result columns become rows, blank results drop out, unit aliases are normalised.

    All columns are unfolded in one scan. Each source row makes as many rows as there are findings,
    a number fixed by the specification.
    """
    out = {"code": "VSTESTCD", "name": "VSTEST", "result": "VSORRES", "unit": "VSORRESU"} | dict(names or {})
    records = []
    for f in findings:
        unit = F.col(f"`{f.unit_column}`") if f.unit_column else F.lit(f.unit).cast("string")
        records.append(F.struct(
            F.lit(f.code).alias(out["code"]),
            F.lit(f.name).alias(out["name"]),
            F.col(f"`{f.column}`").cast("string").alias(out["result"]),
            unit_alias(unit, aliases).alias(out["unit"]),
        ))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(*records)))
    return rows.filter(~is_blank(F.col(out["result"])))


def stack_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a block lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have."""
    return a.subtract(b)


def content_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, null and empty text taken as equal.

    One pre-aggregated count per distinct row serves both directions: a row counts +1 on the left
    and -1 on the right.
    """
    columns = list(a.columns)
    as_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    left = a.select(*as_text, F.lit(1).alias("__sign"))
    right = b.select(*as_text, F.lit(-1).alias("__sign"))
    balance = left.unionByName(right).groupBy(*[f"`{c}`" for c in columns]).agg(F.sum("__sign").alias("surplus"))
    return balance.filter(F.col("surplus") != 0)


def numbered_rows(df: DataFrame, target: str = "row_number") -> DataFrame:
    """The rows with their place from 1, in the order in which the table has them.

    The table is written once, each row with a number that grows in that order; those numbers are then made dense piece by
    piece, so a table of any size is numbered without one task that sees all rows.
    """
    return running_total(held(df, "ordered"), [], [], target).drop(ROW_ID)


def ordered_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that do not stand at the same place in both tables, null and empty text taken as equal: ``place``, the columns as
    text, and ``surplus`` (1 in the first table only, -1 in the second only).

    The place is a part of what is compared, so two rows that changed places differ although the tables hold the same rows.
    """
    place = "__place"
    while place in a.columns:
        place += "_"
    return content_difference(numbered_rows(a, place), numbered_rows(b, place)).withColumn(place, F.col(place).cast("bigint")).withColumnRenamed(place, "place")


def same_content(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Whether two tables hold the same rows, with ``ordered`` also in the same order."""
    return a.columns == b.columns and (ordered_difference if ordered else content_difference)(a, b).isEmpty()


def table_wide(
    long: DataFrame, row: Sequence[str], group: str, display: str, registered: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """One display column per registered group; the group list is given, so no extra pass finds it."""
    cells = [F.max(F.when(F.col(group) == g, F.col(display))).alias(g) for g in registered]
    keys = list(dict.fromkeys([*order, *row]))
    return long.groupBy(*keys).agg(*cells).orderBy(*order).select(*[F.col(f"`{c}`") for c in [*keys, *registered]])


def plan_rows(tasks: DataFrame) -> DataFrame:
    """One row per planned task, nested parts as JSON text."""
    return tasks.select(
        "task_id", "assembly_group_id", "target_domain", "output_kind",
        F.to_json("target_variables").alias("target_variables"),
        F.to_json(F.struct("steps")).alias("plan_json"),
        F.coalesce("status", F.lit("proposed")).alias("status"),
    )


def step_rows(tasks: DataFrame) -> DataFrame:
    """One row per step with its position from 1."""
    steps = tasks.select("task_id", "assembly_group_id", F.posexplode("steps").alias("pos", "step"))
    return steps.select(
        "task_id", "assembly_group_id", (F.col("pos") + 1).alias("step_order"),
        F.col("step.transform_id").alias("transform_id"),
        F.to_json("step.source_refs").alias("source_refs"),
        F.to_json("step.target_variables").alias("target_variables"),
        F.to_json("step.parameters").alias("parameters"),
    )


def parameter_rows(tasks: DataFrame) -> DataFrame:
    """One row per parameter of a step; values are JSON text already."""
    steps = tasks.select("task_id", F.posexplode("steps").alias("pos", "step"))
    return steps.select("task_id", (F.col("pos") + 1).alias("step_order"), F.explode("step.parameters").alias("parameter", "value"))

