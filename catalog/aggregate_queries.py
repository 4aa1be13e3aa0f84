"""Group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ADAE_SQL, ADSL_SQL, MASKED_SQL, PARTIAL_SQL, SEGMENTS, adae, adsl, masked, table
from cohortloom.functions import dates
from cohortloom.operators import aggregates, rules
from cohortloom.plans import tables
from cohortloom.specs import TableSpec, Variable

GROUPS_SQL = "groups(grp, place) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate([*SEGMENTS, "Total"])) + ")"


def tokens(spark, d):
    return aggregates.partial_tokens(masked(spark, d), "raw")


def reference_dates(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    sources = [
        (o, "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")),
        (l, "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd")),
    ]
    base = o.select("o_orderkey", "o_custkey")
    first = aggregates.reference_datetime(base, "o_orderkey", sources, "min", "earliest")
    return aggregates.reference_datetime(first, "o_orderkey", sources, "max", "latest")


def subjects_per_arm(spark, d):
    people = tables.population(adsl(spark, d), "SAFFL")
    return aggregates.denominators(people, "TRT01P", "USUBJID", SEGMENTS).select("grp", "n")


def balance_summary(spark, d):
    c = table(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 3, F.col("c_acctbal")))
    s = aggregates.describe(c, "c_acctbal", "c_mktsegment", SEGMENTS)
    return s.select("grp", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median", "minimum", "maximum")


def price_median(spark, d):
    """A median over groups that are cut into pieces."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return aggregates.exact_median(l, "l_extendedprice", "l_returnflag", ["A", "N", "R"])


def categories(spark, d):
    counts = aggregates.category_counts(adsl(spark, d), ["ETHNIC", "RACE"], "TRT01P", SEGMENTS)
    return counts.select("variable", "level", F.col("is_missing").cast("bigint").alias("is_missing"), "grp", "n")


def flagged_subjects(spark, d):
    counts = tables.event_counts(adae(spark, d), SEGMENTS)
    return counts.select(F.col("lvl").cast("bigint").alias("lvl"), "AEBODSYS", "AEDECOD", "grp", "n")


FLAGGED_SQL = f"""
  WITH {ADAE_SQL}, {GROUPS_SQL},
  cells AS (
    SELECT 0 AS lvl, NULL AS "AEBODSYS", NULL AS "AEDECOD", "TRTA", "USUBJID" FROM adae WHERE "AOCCFL" = 'Y'
    UNION ALL SELECT 1, "AEBODSYS", NULL, "TRTA", "USUBJID" FROM adae WHERE "AOCCSFL" = 'Y'
    UNION ALL SELECT 2, "AEBODSYS", "AEDECOD", "TRTA", "USUBJID" FROM adae WHERE "AOCCPFL" = 'Y'),
  shown AS (SELECT DISTINCT lvl, "AEBODSYS", "AEDECOD" FROM cells)
  SELECT CAST(s.lvl AS BIGINT) AS lvl, s."AEBODSYS", s."AEDECOD", grp, count(DISTINCT c."USUBJID") AS n
  FROM shown s CROSS JOIN groups LEFT JOIN cells c ON c.lvl = s.lvl AND c."AEBODSYS" IS NOT DISTINCT FROM s."AEBODSYS"
    AND c."AEDECOD" IS NOT DISTINCT FROM s."AEDECOD" AND (grp = 'Total' OR c."TRTA" = grp)
  GROUP BY s.lvl, s."AEBODSYS", s."AEDECOD", grp"""


def incomplete_dates(spark, d):
    m = masked(spark, d)
    p = m.select(dates.iso_partial_text(F.col("raw"), ["dd-mmm-yyyy"]).alias("AESTDTC"), F.col("raw").alias("AEENDTC"), "o_orderkey")
    return aggregates.partial_date_notes(p, "AE")


def several_suppliers(spark, d):
    return aggregates.fd_violations(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


LINES = TableSpec("LINES", "Line items", ("l_orderkey", "l_linenumber"), (Variable("l_returnflag", "Flag"),))


def line_issues(spark, d):
    l = table(spark, d, "lineitem")
    return rules.row_issues(l, LINES, [
        rules.controlled_rule("l_returnflag", ["A", "N"]),
        rules.RowRule("LOCAL012", "l_tax", F.col("l_tax") > 0.06, "Tax is high."),
    ])


def summary(spark, d):
    return aggregates.issue_summary(line_issues(spark, d))


def by_class(spark, d):
    return aggregates.issues_by_class(line_issues(spark, d))


def sizes(spark, d):
    names = ["orders", "lineitem", "customer", "documents"]
    return rules.union_all([aggregates.manifest(table(spark, d, n), n) for n in names]).select(
        "dataset", "records", F.col("variables").cast("bigint").alias("variables")
    )


def checksums(spark, d):
    names = ["orders", "lineitem", "customer", "documents", "events"]
    return rules.union_all([aggregates.manifest(table(spark, d, n), n) for n in names])


def offenders(spark, d):
    """Parts of each supplier group, numbered."""
    l = table(spark, d, "lineitem").withColumn("grp", F.col("l_suppkey") % 3)
    return aggregates.offender_keys(l, F.lpad(F.col("l_partkey").cast("string"), 8, "0"), ["grp"])


_CHECKED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def _checksum_sql(name, columns):
    text = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns)
    half = "sum(CAST(CAST('0x' || substr(h, {}, 16) AS UBIGINT) AS HUGEINT))"
    return f"""SELECT '{name}' AS dataset, count(*) AS records, {len(columns)} AS variables,
      count(*) || '-' || {half.format(1)} || '-' || {half.format(17)} AS checksum FROM (SELECT md5({text}) AS h FROM {name})"""


CHECKSUMS_SQL = " UNION ALL ".join(_checksum_sql(n, c) for n, c in _CHECKED.items())

QUERIES = {
    "partial_tokens": (tokens, f"""
      WITH {MASKED_SQL} SELECT DISTINCT unnest(regexp_extract_all(raw, 'UNK|\\bUN\\b')) AS token FROM masked"""),
    "reference_datetime": (reference_dates, """
      SELECT o_orderkey, o_custkey, strftime(least(o_orderdate, coalesce(lo, o_orderdate)), '%Y-%m-%d') AS earliest,
        strftime(greatest(o_orderdate, coalesce(hi, o_orderdate)), '%Y-%m-%d') AS latest
      FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1)
        ON l_orderkey = o_orderkey"""),
    "denominators": (subjects_per_arm, f"""
      WITH {ADSL_SQL}, {GROUPS_SQL} SELECT grp, count(DISTINCT "USUBJID") AS n FROM groups
      LEFT JOIN (SELECT * FROM adsl WHERE "SAFFL" = 'Y') ON grp = 'Total' OR grp = "TRT01P" GROUP BY grp"""),
    "describe": (balance_summary, f"""
      WITH {GROUPS_SQL} SELECT grp, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, median(x) AS median,
        min(x) AS minimum, max(x) AS maximum
      FROM groups JOIN (SELECT c_mktsegment, CASE WHEN c_custkey % 10 <> 3 THEN c_acctbal END AS x FROM customer)
        ON grp = 'Total' OR grp = c_mktsegment GROUP BY grp"""),
    "exact_median_spread": (price_median, """
      SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1"""),
    "category_counts": (categories, f"""
      WITH {ADSL_SQL}, {GROUPS_SQL}, leveled AS (SELECT 'ETHNIC' AS variable, coalesce("ETHNIC", 'Missing') AS level,
        CAST(CASE WHEN "ETHNIC" IS NULL THEN 1 ELSE 0 END AS BIGINT) AS is_missing, "TRT01P" AS arm FROM adsl
        UNION ALL SELECT 'RACE', "RACE", 0, "TRT01P" FROM adsl),
      levels AS (SELECT DISTINCT variable, level, is_missing FROM leveled)
      SELECT s.variable, s.level, s.is_missing, grp, count(v.arm) AS n FROM levels s CROSS JOIN groups
      LEFT JOIN leveled v ON v.variable = s.variable AND v.level = s.level AND (grp = 'Total' OR v.arm = grp) GROUP BY ALL"""),
    "subject_counts": (flagged_subjects, FLAGGED_SQL),
    "partial_date_notes": (incomplete_dates, f"""
      WITH {PARTIAL_SQL} SELECT DISTINCT 'AE' AS domain, 'AESTDTC' AS variable, dtc AS value FROM partial WHERE length(dtc) < 10
      UNION SELECT DISTINCT 'AE', 'AEENDTC', raw FROM partial WHERE raw <> ''"""),
    "fd_violations": (several_suppliers, """
      SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"""),
    "issue_summary": (summary, """
      SELECT n AS issue_count, n AS errors, CAST(0 AS BIGINT) AS warnings, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS result
      FROM (SELECT CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem)"""),
    "issues_by_class": (by_class, """
      SELECT 'generated_domain_defect' AS issue_class, CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END
        + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem"""),
    "manifest_sizes": (sizes, """
      SELECT 'orders' AS dataset, count(*) AS records, CAST(6 AS BIGINT) AS variables FROM orders
      UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'customer', count(*), 5 FROM customer
      UNION ALL SELECT 'documents', count(*), 5 FROM documents"""),
    "manifest_checksums": (checksums, CHECKSUMS_SQL),
    "offender_list": (offenders, """
      WITH k AS (SELECT DISTINCT l_suppkey % 3 AS grp, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key FROM lineitem)
      SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY key) AS ordinal, key AS offender FROM k"""),
}
