"""Lookup tables that come with the specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.errors import ContractError
from cohortloom.operators.skew import key_join


def as_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def codelist_rows(codelist: str, codelists: Mapping[str, Mapping[str, str]] = specs.CODELISTS) -> list[tuple[str, str]]:
    if codelist not in codelists:
        raise ContractError(f"unknown codelist {codelist!r}")
    return list(codelists[codelist].items())


def visit_rows(visit_map: str, visit_maps: Mapping[str, Mapping[str, float]] = specs.VISIT_MAPS) -> list[tuple[str, float]]:
    if visit_map not in visit_maps:
        raise ContractError(f"unknown visit map {visit_map!r}")
    return [(name, float(n)) for name, n in visit_maps[visit_map].items()]


def conversion_rows(conversion_set: str, sets: Mapping[str, Sequence[tuple]] = specs.UNIT_CONVERSIONS) -> list[tuple]:
    if conversion_set not in sets:
        raise ContractError(f"unknown conversion set {conversion_set!r}")
    return [tuple(row) for row in sets[conversion_set]]


def attach(
    df: DataFrame, rows: Sequence[tuple], schema: str, on: Mapping[str, str]
) -> DataFrame:
    """Left join to a lookup with one row per key.

    The rows come with the specification, as a list of the driver, so they are broadcast: a shuffle would deal the rows of
    ``df`` to as many tasks as the lookup has keys. Without the hint Spark takes a table made of a list for a large one.
    """
    return key_join(df, F.broadcast(as_table(df.sparkSession, rows, schema)), on)
