"""Reading and writing: tables are written to the shared scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import PRIORITIES, iso, table
from cohortloom.operators import lookups
from cohortloom.session import shared_folder
from cohortloom.sources import csv_files, event_log, tables


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _customer_csv(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    out = c.select(
        "c_custkey", F.when(k % 10 == 1, "NA").when(k % 10 == 2, "N/A").when(k % 10 == 3, "").otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.concat(F.lit('a "quoted", '), "c_mktsegment").alias("segment.name"),
    )
    path = scratch(spark, "customer_csv")
    csv_files.write_csv(out, path)
    return path


def literal(spark, d):
    return csv_files.read_literal(spark, _customer_csv(spark, d)).drop(csv_files.ROW).withColumnRenamed("segment.name", "segment")


def inferred(spark, d):
    df = csv_files.read_inferred(spark, _customer_csv(spark, d))
    return df.withColumnRenamed("segment.name", "segment").withColumn("types", F.lit(",".join(t for _, t in df.dtypes)))


def checked(spark, d):
    return csv_files.check_csv(spark, _customer_csv(spark, d)).groupBy().agg(F.count(F.lit(1)).alias("n"), F.count("c_name").alias("named"))


def stored(spark, d):
    """Blank text comes back as null from the typed table."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), "o_totalprice", "o_orderdate")
    path = scratch(spark, "orders_table")
    tables.write_table(o.withMetadata("status", {"label": "Status"}), path)
    back = tables.load_table(spark, path)
    return back.select("o_orderkey", "status", "o_totalprice", iso("o_orderdate").alias("day"), F.lit(back.schema["status"].metadata["label"]).alias("label"))


def logged_events(spark, d):
    """Rows whose JSON names a run or a kind of event."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    log = event_log.parse_events(e, F.col("props"), "k bigint").withColumns({"run_id": F.concat(F.lit("r"), F.col("k") % 10), "event": F.col("event_type")})
    return event_log.select_events(log, "r3", ["error"]).select("event_id", "event_type", "k")


def event_log_file(spark, d):
    """One JSON object per line, with lines that are no object."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 50 == 0, "not json").otherwise(
        F.to_json(F.struct(F.concat(F.lit("r"), F.col("user_id")).alias("run_id"), F.col("event_type").alias("event"), F.col("props").alias("details")))
    )
    path = scratch(spark, "events_jsonl")
    e.select(line.alias("value")).write.text(path)
    log = event_log.read_event_log(spark, path)
    return event_log.select_events(log, "r5", ["error"]).groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("n"))


def lookup_table(spark, d):
    """Orders with the entry of a lookup; an unknown value stays null."""
    rows = [(p, i) for i, p in enumerate(PRIORITIES[:4])]
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return lookups.attach(o, rows, "name string, rank bigint", {"o_orderpriority": "name"})


_CUSTOMER_SQL = """SELECT {key} AS c_custkey, CASE WHEN c_custkey % 10 NOT IN (1, 2, 3) THEN c_name END AS c_name,
  CASE WHEN c_custkey % 5 <> 0 THEN {bal} END AS c_acctbal, 'a "quoted", ' || c_mktsegment AS segment{more} FROM customer"""

QUERIES = {
    "read_literal": (literal, _CUSTOMER_SQL.format(key="CAST(c_custkey AS VARCHAR)", bal="CAST(c_acctbal AS VARCHAR)", more="")),
    "read_inferred": (inferred, _CUSTOMER_SQL.format(key="CAST(c_custkey AS DOUBLE)", bal="c_acctbal", more=", 'double,string,double,string' AS types")),
    "check_csv": (checked, "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 10 NOT IN (1, 2, 3)) AS named FROM customer"),
    "stored_table": (stored, """
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS day, 'Status' AS label FROM orders"""),
    "event_log_props": (logged_events, """
      SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
      WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 3 OR event_type = 'error'"""),
    "event_log_file": (event_log_file, """
      SELECT 'r' || user_id AS run_id, event_type AS event, count(*) AS n FROM events
      WHERE event_id % 50 <> 0 AND (user_id = 5 OR event_type = 'error') GROUP BY ALL"""),
    "lookup_table": (lookup_table, """
      SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
        WHEN '4-NOT SPECIFIED' THEN 3 END::BIGINT AS rank FROM orders"""),
}
