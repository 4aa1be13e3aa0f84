"""Sequences, first-occurrence and baseline flags, duplicates, block formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ADAE_SQL, ADSL_SQL, adae, adsl, dose_dates, iso, table
from catalog.reshape_queries import CONVERSIONS, FINDINGS, long_measures
from cohortloom.operators import joins, ordering, skew, windows


def order_sequence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return windows.sequence(o, "seq", ["o_custkey", "o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "seq")


def event_sequence(spark, d):
    """Users with many events, each cut into pieces that are numbered apart."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    numbered = windows.sequence(e, "seq", ["ts", "event_id"], ["user_id"], 5)
    return numbered.select("event_id", "user_id", "seq")


def running_value(spark, d):
    """Running sums of whole numbers over one group that holds every row."""
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return skew.running_total(l.withColumn("one", F.lit(1)), ["one"], ["l_partkey"], "upto", "q").drop("one")


FLAGS = {"AOCCFL": ["USUBJID"], "AOCCSFL": ["USUBJID", "AEBODSYS"], "AOCCPFL": ["USUBJID", "AEBODSYS", "AEDECOD"]}


def first_events(spark, d):
    return adae(spark, d).select("USUBJID", "AESEQ", "TRTEMFL", *FLAGS)


def baseline(spark, d):
    """Last order total per customer and priority before the last dose, on the day itself for urgent ones."""
    o = table(spark, d, "orders").drop("o_orderstatus")
    doses = dose_dates(spark, d)
    k = F.col("o_orderkey")
    rows = o.join(doses, "o_custkey", "left").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.when(k % 19 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(iso("o_orderdate")).alias("dtc"),
        F.date_format("last_dose", "yyyy-MM-dd").alias("ref"),
        F.when(k % 23 != 0, F.col("o_totalprice")).alias("result"),
        F.when(k % 29 == 0, "NOT DONE").alias("status"),
    )
    flagged = windows.baseline_flag(
        rows, "blfl", ["o_custkey", "o_orderpriority"], "dtc", "ref", "result", ["o_orderkey"],
        "o_orderpriority", ["1-URGENT"], status="status",
    )
    return flagged.select("o_orderkey", "o_custkey", "blfl")


BASELINE_SQL = """
  WITH doses AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS ref FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  valid AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM orders JOIN doses ON k = o_custkey
    WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0
      AND (o_orderdate < ref OR (CAST(o_orderdate AS DATE) = ref AND o_orderpriority = '1-URGENT'))),
  last AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM valid)
  SELECT o.o_orderkey, o_custkey, CASE WHEN r = 1 THEN 'Y' END AS blfl FROM orders o LEFT JOIN last USING (o_orderkey)"""


def repeated_lines(spark, d):
    l = table(spark, d, "lineitem")
    return windows.duplicate_rows(l, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def repeated_types(spark, d):
    """Five keys own all rows; each is spread over many tasks."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return windows.duplicate_rows(e, ["event_type"])


def block_text(spark, d):
    long = long_measures(spark, d)
    done = joins.convert_units(long, "result", "unit", "code", "std", CONVERSIONS, {"dollars": "USD"}, "x", check=False)
    shown = windows.common_decimals_text(done, "x", "code", "shown", [f.code for f in FINDINGS])
    return shown.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("shown").contains(".")).alias("with_decimals"),
        F.sum(F.length("shown")).alias("chars"),
    )


def customer_blocks(spark, d):
    """Balances per nation with the decimals that the nation's widest balance needs."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.bround("c_acctbal", 0).alias("x"))
    c = c.withColumn("x", F.when(F.col("c_nationkey") % 3 == 0, F.col("x") + 0.5).otherwise(F.col("x")))
    return windows.common_decimals_text(c, "x", "c_nationkey", "shown").select("c_custkey", "shown")


def ranked_parts(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return ordering.by_count_then_name(l, "n", ["l_partkey"])


def newest_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return ordering.first_n(o, [F.desc("o_orderdate"), "o_orderkey"], 60).drop("o_orderdate")


def subjects_in_order(spark, d):
    """Subjects sorted by their unique keys, as the analysis table is written."""
    return ordering.total_order(adsl(spark, d).select("STUDYID", "USUBJID", "SITEID", "TRT01P"), ["STUDYID", "USUBJID"])


def levels_in_order(spark, d):
    """Levels with their counts, Missing last."""
    s = adsl(spark, d).select(F.coalesce("ETHNIC", F.lit("Missing")).alias("level"))
    return ordering.missing_last(s.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level")


QUERIES = {
    "sequence": (order_sequence, """
      SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders"""),
    "sequence_spread": (event_sequence, """
      SELECT event_id, user_id, 4 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"""),
    "running_total_spread": (running_value, """
      SELECT l_partkey, CAST(q AS BIGINT) AS q, CAST(sum(q) OVER (ORDER BY l_partkey) AS BIGINT) AS upto
      FROM (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_partkey)"""),
    "first_occurrence": (first_events, f"""
      WITH {ADAE_SQL} SELECT "USUBJID", "AESEQ", "TRTEMFL", "AOCCFL", "AOCCSFL", "AOCCPFL" FROM adae"""),
    "baseline_flag": (baseline, BASELINE_SQL),
    "duplicate_rows": (repeated_lines, """
      SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
      QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"""),
    "duplicate_rows_spread": (repeated_types, "SELECT event_id, event_type FROM events"),
    "common_decimals": (block_text, """
      WITH qty AS (SELECT 'QTY' AS code, printf('%.1f', l_quantity * 0.5 + 1) AS shown, l_quantity * 0.5 + 1 AS x FROM lineitem),
      price AS (SELECT 'PRICE' AS code, x, printf('%.1f', CASE WHEN x - floor(x * 10) / 10 < ceil(x * 10) / 10 - x
               OR (x - floor(x * 10) / 10 = ceil(x * 10) / 10 - x AND CAST(floor(x * 10) AS BIGINT) % 2 = 0)
             THEN floor(x * 10) / 10 ELSE ceil(x * 10) / 10 END) AS shown FROM (SELECT l_extendedprice * 0.9::DOUBLE AS x FROM lineitem)),
      disc AS (SELECT 'DISC' AS code, CAST(CAST(round_even(l_discount * 100, 0) AS BIGINT) AS VARCHAR) AS shown FROM lineitem WHERE l_discount <> 0),
      tax AS (SELECT 'TAX' AS code, CAST(CAST(round_even(l_tax * 1000, 0) AS BIGINT) AS VARCHAR) AS shown FROM lineitem),
      shown AS (SELECT code, shown FROM qty UNION ALL SELECT code, shown FROM price UNION ALL SELECT * FROM disc UNION ALL SELECT * FROM tax)
      SELECT code, count(*) AS n, count(*) FILTER (WHERE contains(shown, '.')) AS with_decimals, CAST(sum(length(shown)) AS BIGINT) AS chars
      FROM shown GROUP BY code"""),
    "common_decimals_by_nation": (customer_blocks, """
      SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN printf('%.1f', round_even(c_acctbal, 0) + 0.5)
        ELSE CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) END AS shown FROM customer"""),
    "total_order": (subjects_in_order, f"""
      WITH {ADSL_SQL} SELECT "STUDYID", "USUBJID", "SITEID", "TRT01P" FROM adsl"""),
    "missing_last": (levels_in_order, f"""
      WITH {ADSL_SQL} SELECT coalesce("ETHNIC", 'Missing') AS level, count(*) AS n FROM adsl GROUP BY 1"""),
    "count_ranking": (ranked_parts, "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey"),
    "newest_orders": (newest_orders, """
      SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60"""),
}
