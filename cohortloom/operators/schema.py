"""Fitting a table to its specification: columns, types, labels, dropped sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.numbers import not_a_number, strict_number
from cohortloom.operators.checks import Check, Watch, enforce, require_columns
from cohortloom.specs import TableSpec, Variable

SPARK_TYPES = {"character": "string", "numeric": "double", "date": "date"}


def has_kind(kind: str, data_type: T.DataType) -> bool:
    if kind == "character":
        return isinstance(data_type, T.StringType)
    if kind == "numeric":
        return isinstance(data_type, T.NumericType)
    return kind == "date" and isinstance(data_type, T.DateType)


def _metadata(v: Variable) -> dict:
    return {"label": v.label, "kind": v.kind, "controlled": list(v.controlled), "iso8601": v.iso8601, "required": v.required}


def apply_labels(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Attach label, kind, controlled terms and date flag as column metadata."""
    for v in spec.variables:
        if v.name in df.columns:
            df = df.withMetadata(v.name, _metadata(v))
    return df


def _to_number(df: DataFrame, spec: TableSpec) -> list[Variable]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [v for v in spec.variables if v.name in types and v.kind == "numeric" and not isinstance(types[v.name], T.NumericType)]


def number_checks(df: DataFrame, spec: TableSpec) -> list[Check]:
    """Non-blank text that is no number, in the numeric columns that ``df`` has as text."""
    return [Check(f"{spec.name}.{v.name}", not_a_number(F.col(v.name)), F.col(v.name)) for v in _to_number(df, spec)]


def conform(df: DataFrame, spec: TableSpec, check: bool = True, watch: Watch | None = None) -> DataFrame:
    """Keep the specified columns in their order and cast them.

    A missing required column is an error, a missing optional one is left out, anything else in the
    table is dropped. Non-blank text that is no number in a numeric column is an error, with a ``watch`` when the table
    is written.
    """
    require_columns(df, spec.required, spec.name)
    present = [v for v in spec.variables if v.name in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    to_number = _to_number(df, spec)
    if check:
        df = enforce(df, number_checks(df, spec), watch)
    columns = []
    for v in present:
        c = F.col(v.name)
        if v in to_number:
            c = strict_number(c)
        elif not has_kind(v.kind, types[v.name]):
            c = c.cast(SPARK_TYPES[v.kind])
        columns.append(c.alias(v.name, metadata=_metadata(v)))
    return df.select(*columns)


def drop_source(df: DataFrame, column: str, reason: str) -> tuple[DataFrame, dict]:
    """Leave a source column out on purpose; the second value is its lineage row."""
    if len(reason.strip()) < 3:
        raise ValueError("say why the source is not used")
    row = {"source": column, "transform": "do_not_map", "reason": reason}
    return df.drop(column), row
