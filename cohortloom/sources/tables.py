"""Typed table sink that keeps labels, and read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.conditions import blank_to_null
from cohortloom.sources.csv_files import write_csv


def write_table(df: DataFrame, path: str, csv_path: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet keeps types and column metadata; a CSV copy is optional."""
    df.write.mode(mode).parquet(path)
    if csv_path:
        write_csv(df, csv_path, mode)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read back with blank text as null; labels stay on the columns."""
    df = spark.read.parquet(path)
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        columns.append(
            blank_to_null(c).alias(f.name, metadata=f.metadata) if isinstance(f.dataType, T.StringType) else c
        )
    return df.select(*columns)
