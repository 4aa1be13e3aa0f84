"""Event logs: one JSON object per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at string, project_id string, run_id string, actor string, event string, details string"


def read_event_log(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Objects with the named fields; unreadable lines are left out."""
    lines = spark.read.text(path)
    return parse_events(lines, F.col("value"), schema)


def parse_events(df: DataFrame, text: Column, schema: str = SCHEMA) -> DataFrame:
    """Add the fields of a JSON text column; rows whose text is no object are left out."""
    parsed = df.withColumn("__e", F.from_json(text, schema))
    whole = F.get_json_object(text, "$").startswith("{")
    kept = parsed.filter(F.coalesce(whole, F.lit(False)) & F.col("__e").isNotNull())
    return kept.select(*[c for c in df.columns if c != "value"], "__e.*")


def select_events(log: DataFrame, run_id: str, always: Sequence[str] = ("project_created",)) -> DataFrame:
    """Events of one run, and events of the listed kinds whatever run they name."""
    return log.filter((F.col("run_id") == run_id) | F.col("event").isin(list(always)))
