"""The driver tables seen as a study: customers are subjects, orders are events.

Each view exists twice: as a DataFrame and as the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.plans import analysis
from cohortloom.session import materialised
from cohortloom.specs import AnalysisPlan, Treatment

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PLAN = AnalysisPlan(tuple(Treatment(s, s[:3], float(i)) for i, s in enumerate(SEGMENTS)))
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(name: str):
    return F.col(name).cast("date")


def iso(name: str):
    return F.date_format(day(name), "yyyy-MM-dd")


def dose_dates(spark: SparkSession, folder: str) -> DataFrame:
    """First and last dose per customer: the span of finished orders."""
    done = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    return done.groupBy("o_custkey").agg(
        F.min(day("o_orderdate")).alias("first_dose"), F.max(day("o_orderdate")).alias("last_dose")
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Nation and region names; the nation table has a fixed size."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def dm(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    joined = customer.join(dose_dates(spark, folder), customer.c_custkey == F.col("o_custkey"), "left")
    joined = joined.join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.lit("S1").alias("STUDYID"),
        F.lit("DM").alias("DOMAIN"),
        F.col("c_custkey").cast("string").alias("USUBJID"),
        F.col("c_name").alias("SUBJID"),
        F.date_format("first_dose", "yyyy-MM-dd").alias("RFSTDTC"),
        F.date_format("last_dose", "yyyy-MM-dd").alias("RFENDTC"),
        F.col("n_name").alias("SITEID"),
        F.col("c_acctbal").alias("AGE"),
        F.lit("USD").alias("AGEU"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("SEX"),
        F.col("r_name").alias("RACE"),
        # every eleventh subject has no value here
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("ETHNIC"),
        F.col("n_name").alias("COUNTRY"),
        F.substring("c_mktsegment", 1, 3).alias("ARMCD"),
        F.col("c_mktsegment").alias("ARM"),
        F.substring("c_mktsegment", 1, 3).alias("ACTARMCD"),
        # an actual arm whose name is unknown is found by its code
        F.when(F.col("c_custkey") % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("ACTARM"),
    )


DM_SQL = """dm AS (
  SELECT 'S1' AS "STUDYID", 'DM' AS "DOMAIN", CAST(c_custkey AS VARCHAR) AS "USUBJID", c_name AS "SUBJID",
    strftime(d.first_dose, '%Y-%m-%d') AS "RFSTDTC", strftime(d.last_dose, '%Y-%m-%d') AS "RFENDTC",
    n_name AS "SITEID", c_acctbal AS "AGE", 'USD' AS "AGEU",
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS "SEX", r_name AS "RACE",
    CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS "ETHNIC", n_name AS "COUNTRY",
    substr(c_mktsegment, 1, 3) AS "ARMCD", c_mktsegment AS "ARM", substr(c_mktsegment, 1, 3) AS "ACTARMCD",
    CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS "ACTARM"
  FROM customer
  LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_dose, max(CAST(o_orderdate AS DATE)) AS last_dose
             FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) d ON d.o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

ARM_SQL = """arms(name, code, num) AS (VALUES ('AUTOMOBILE','AUT',0.0), ('BUILDING','BUI',1.0), ('FURNITURE','FUR',2.0),
  ('HOUSEHOLD','HOU',3.0), ('MACHINERY','MAC',4.0))"""

ADSL_SQL = f"""{DM_SQL}, {ARM_SQL}, adsl AS (
  SELECT "STUDYID", "USUBJID", "SUBJID", "SITEID", "AGE", "AGEU", "SEX", "RACE", "ETHNIC", "COUNTRY",
    "ARM" AS "TRT01P", CAST(coalesce(pn.num, pc.num) AS DOUBLE) AS "TRT01PN",
    "ACTARM" AS "TRT01A", CAST(coalesce(an.num, ac.num) AS DOUBLE) AS "TRT01AN",
    CAST("RFSTDTC" AS DATE) AS "TRTSDT", CAST("RFENDTC" AS DATE) AS "TRTEDT",
    CAST(CAST("RFENDTC" AS DATE) - CAST("RFSTDTC" AS DATE) + 1 AS DOUBLE) AS "TRTDURD",
    CASE WHEN "ARM" <> '' THEN 'Y' ELSE 'N' END AS "ITTFL",
    CASE WHEN "RFSTDTC" IS NOT NULL THEN 'Y' ELSE 'N' END AS "SAFFL"
  FROM dm LEFT JOIN arms pn ON pn.name = "ARM" LEFT JOIN arms pc ON pc.code = "ARMCD"
  LEFT JOIN arms an ON an.name = "ACTARM" LEFT JOIN arms ac ON ac.code = "ACTARMCD")"""


def ae(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders as events; the order key is the sequence number, unique per subject."""
    o = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "O")
    end = F.date_add(day("o_orderdate"), (F.col("o_orderkey") % 5).cast("int"))
    return o.select(
        F.lit("S1").alias("STUDYID"),
        F.lit("AE").alias("DOMAIN"),
        F.col("o_custkey").cast("string").alias("USUBJID"),
        F.col("o_orderkey").alias("AESEQ"),
        F.concat(F.lit("ORDER "), "o_orderkey").alias("AETERM"),
        F.concat("o_orderpriority", F.lit("-Q"), F.quarter(day("o_orderdate"))).alias("AEDECOD"),
        F.col("o_orderpriority").alias("AEBODSYS"),
        F.lit("MILD").alias("AESEV"),
        F.lit("N").alias("AESER"),
        F.lit("NOT RELATED").alias("AEREL"),
        F.lit("UNKNOWN").alias("AEOUT"),
        F.lit("N").alias("AESHOSP"),
        # every seventeenth start is known to the month only
        F.when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(iso("o_orderdate")).alias("AESTDTC"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_format(end, "yyyy-MM-dd")).alias("AEENDTC"),
        F.lit(None).cast("double").alias("AESTDY"),
        F.lit(None).cast("double").alias("AEENDY"),
        F.when(F.col("o_orderkey") % 7 == 0, "ONGOING").alias("AEENRF"),
    )


AE_SQL = """ae AS (
  SELECT 'S1' AS "STUDYID", CAST(o_custkey AS VARCHAR) AS "USUBJID", o_orderkey AS "AESEQ",
    'ORDER ' || o_orderkey AS "AETERM",
    o_orderpriority || '-Q' || quarter(o_orderdate) AS "AEDECOD", o_orderpriority AS "AEBODSYS",
    CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "AESTDTC",
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), '%Y-%m-%d') END AS "AEENDTC"
  FROM orders WHERE o_orderstatus = 'O')"""

ADAE_SQL = f"""{ADSL_SQL}, {AE_SQL}, dated AS (
  SELECT ae.*, CASE WHEN length("AESTDTC") = 10 THEN CAST("AESTDTC" AS DATE) END AS "ASTDT", CAST("AEENDTC" AS DATE) AS "AENDT",
    "TRT01P" AS "TRTP", "TRT01PN" AS "TRTPN", "TRT01A" AS "TRTA", "TRT01AN" AS "TRTAN", "TRTSDT", "TRTEDT", "SAFFL"
  FROM ae LEFT JOIN adsl USING ("STUDYID", "USUBJID")),
emergent AS (
  SELECT *, CASE WHEN "TRTSDT" IS NULL THEN NULL WHEN "AENDT" < "TRTSDT" THEN NULL WHEN "ASTDT" IS NULL THEN 'Y'
    WHEN "ASTDT" >= "TRTSDT" AND "ASTDT" <= "TRTEDT" + 30 THEN 'Y' END AS "TRTEMFL" FROM dated),
adae AS (
  SELECT *,
    CASE WHEN "TRTEMFL" = 'Y' AND row_number() OVER (PARTITION BY "USUBJID", "TRTEMFL" ORDER BY "ASTDT" NULLS LAST, "AESEQ") = 1
      THEN 'Y' END AS "AOCCFL",
    CASE WHEN "TRTEMFL" = 'Y' AND row_number() OVER (PARTITION BY "USUBJID", "AEBODSYS", "TRTEMFL" ORDER BY "ASTDT" NULLS LAST, "AESEQ") = 1
      THEN 'Y' END AS "AOCCSFL",
    CASE WHEN "TRTEMFL" = 'Y' AND row_number() OVER (PARTITION BY "USUBJID", "AEBODSYS", "AEDECOD", "TRTEMFL" ORDER BY "ASTDT" NULLS LAST, "AESEQ") = 1
      THEN 'Y' END AS "AOCCPFL"
  FROM emergent)"""


def adsl(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.derive_subjects(dm(spark, folder), PLAN, ordered=False)


def adae(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.derive_events(ae(spark, folder), adsl(spark, folder), PLAN, ordered=False)


def built(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Subject and event tables, written once: the checks read them many times."""
    subjects = materialised(adsl(spark, folder), "ADSL")
    events = analysis.derive_events(ae(spark, folder), subjects, PLAN, ordered=False)
    return subjects, materialised(events, "ADAE")


def masked(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates with unknown parts, empty texts and nulls."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey") % 10
    return o.select(
        "o_orderkey", "o_orderdate",
        F.when(k == 0, F.concat(F.lit("UNK-"), F.date_format("o_orderdate", "MMM-yyyy")))
        .when(k == 1, F.concat(F.lit("UNK-UNK-"), F.date_format("o_orderdate", "yyyy")))
        .when(k == 2, "")
        .when(k == 3, F.lit(None).cast("string"))
        .otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("raw"),
    )


MASKED_SQL = """masked AS (
  SELECT o_orderkey, o_orderdate, CASE o_orderkey % 10 WHEN 0 THEN 'UNK-' || strftime(o_orderdate, '%b-%Y')
    WHEN 1 THEN 'UNK-UNK-' || strftime(o_orderdate, '%Y') WHEN 2 THEN '' WHEN 3 THEN NULL
    ELSE strftime(o_orderdate, '%d-%b-%Y') END AS raw FROM orders)"""

# The same dates as ISO text of the known precision.
PARTIAL_SQL = f"""{MASKED_SQL}, partial AS (
  SELECT o_orderkey, o_orderdate, raw, CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m')
    WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN NULL WHEN 3 THEN NULL
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dtc FROM masked)"""
