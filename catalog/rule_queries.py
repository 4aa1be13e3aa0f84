"""Data-quality rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ADAE_SQL, ADSL_SQL, AE_SQL, DM_SQL, PARTIAL_SQL, PLAN, PRIORITIES, SEGMENTS,
    adae, adsl, ae, built, dm, masked, table,
)
from catalog.reshape_queries import CONVERSIONS, LONG_SQL, long_measures
from cohortloom.functions import dates
from cohortloom.operators import aggregates, rules
from cohortloom.plans import tables
from cohortloom.specs import ADAE, ADSL, DM, TableSpec, Variable

SHORT = ["rule_id", "variable", "record_key", "actual_value"]
ANALYSIS = ["rule_id", "dataset", "variable", "actual_value"]


def domain_checks(spark, d):
    """All checks of one table: schema, row rules in one scan, duplicate keys."""
    k = F.col("USUBJID").cast("bigint")
    people = dm(spark, d).drop("SEX").withColumns({
        "USUBJID": F.when(k % 90 == 8, (k - 1).cast("string")).otherwise(F.col("USUBJID")),
        "AGE": F.col("AGE").cast("string"),
        "DOMAIN": F.when(k % 50 == 1, "XX").when(k % 50 == 2, F.lit(None)).otherwise(F.col("DOMAIN")),
        "SITEID": F.when(k % 60 == 3, "  ").otherwise(F.col("SITEID")),
        "ETHNIC": F.when(k % 70 == 4, "INVALID").otherwise("UNKNOWN"),
        "RFICDTC": F.when(k % 80 == 5, "2025-02-30").when(k % 80 == 6, "05/01/2025").otherwise("2025-02"),
        "AGEU": F.lit(None).cast("string"), "RACE": F.lit("WHITE"),
    })
    return rules.validate_domain(people, DM, "r").select(*SHORT)


_DM_COLUMNS = ("STUDYID,DOMAIN,USUBJID,SUBJID,RFSTDTC,RFENDTC,SITEID,AGE,AGEU,RACE,ETHNIC,COUNTRY,ARMCD,ARM,ACTARMCD,ACTARM,RFICDTC")
DOMAIN_SQL = f"""
  WITH {DM_SQL}, k AS (SELECT k, 'S1 | ' || u AS key FROM (
    SELECT CAST("USUBJID" AS BIGINT) AS k, CASE WHEN CAST("USUBJID" AS BIGINT) % 90 = 8 THEN CAST(CAST("USUBJID" AS BIGINT) - 1 AS VARCHAR) ELSE "USUBJID" END AS u FROM dm))
  SELECT 'LOCAL002' AS rule_id, 'DOMAIN' AS variable, key AS record_key, CASE WHEN k % 50 = 1 THEN 'XX' END AS actual_value FROM k WHERE k % 50 IN (1, 2)
  UNION ALL SELECT 'LOCAL004', 'DOMAIN', key, NULL FROM k WHERE k % 50 = 2
  UNION ALL SELECT 'LOCAL004', 'SITEID', key, '  ' FROM k WHERE k % 60 = 3
  UNION ALL SELECT 'LOCAL006', 'ETHNIC', key, 'INVALID' FROM k WHERE k % 70 = 4
  UNION ALL SELECT 'LOCAL007', 'RFICDTC', key, CASE WHEN k % 80 = 5 THEN '2025-02-30' ELSE '05/01/2025' END FROM k WHERE k % 80 IN (5, 6)
  UNION ALL SELECT 'LOCAL003', 'STUDYID,USUBJID', key, key FROM k WHERE k % 90 IN (7, 8)
    AND (k % 90 = 8 OR k + 1 <= (SELECT max(k) FROM k))
  UNION ALL SELECT 'LOCAL001', 'SEX', '', '' UNION ALL SELECT 'LOCAL005', 'AGE', '', 'string'
  UNION ALL SELECT 'LOCAL009', '', '', '{_DM_COLUMNS}'"""


LINE = TableSpec("LI", "Line items", ("l_orderkey", "l_linenumber"), (Variable("l_orderkey", "Order", "numeric"),))
ORDER = TableSpec("ORD", "Orders", ("o_orderkey",), (
    Variable("o_orderpriority", "Priority", controlled=tuple(PRIORITIES[:3])),
))
TEXT = TableSpec("DOC", "Documents", ("doc_id",), (Variable("text", "Text"),))


def duplicate_keys(spark, d):
    issues = rules.duplicate_key_issues(table(spark, d, "lineitem"), LINE, "r")
    return issues.select("rule_id", "domain", "variable", "record_key", "actual_value")


def outside_list(spark, d):
    o = table(spark, d, "orders")
    return rules.row_issues(o, ORDER, [rules.controlled_rule("o_orderpriority", PRIORITIES[:3])]).select(*SHORT)


def bad_iso(spark, d):
    m = masked(spark, d).select("o_orderkey", dates.iso_partial_text(F.col("raw"), ["dd-mmm-yyyy"]).alias("good"), "raw")
    mixed = m.withColumn("dtc", F.when(F.col("o_orderkey") % 10 == 5, F.concat("good", F.lit("x"))).when(F.col("o_orderkey") % 10 == 4, F.col("raw")).otherwise(F.col("good")))
    rule = rules.RowRule("LOCAL007", "dtc", ~dates.iso_valid(F.col("dtc")), "Not a valid ISO 8601 date.")
    return rules.row_issues(mixed, ORDER, [rule]).select(*SHORT)


def long_texts(spark, d):
    issues = rules.row_issues(table(spark, d, "documents"), TEXT, [rules.length_rule("text")])
    return issues.select("rule_id", "record_key", F.md5("actual_value").alias("digest"))


def orphan_rows(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    spec = TableSpec("DOC", "Documents", ("doc_id",), ())
    return rules.orphan_issues(docs, labels, spec, "doc_id").select(*SHORT)


def broken_sequences(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rules.sequence_issues(l, LINE, "l_linenumber", "l_orderkey").select(*SHORT)


def reversed_dates(spark, d):
    events = ae(spark, d).withColumn("AEENDTC", F.when(F.col("AESEQ") % 50 == 0, "1990-01-01").otherwise(F.col("AEENDTC")))
    spec = TableSpec("AE", "Events", ("AESEQ",), ())
    return rules.row_issues(events, spec, [rules.event_date_rule()]).select(*SHORT)


PAIRS = {"QTY": ("Quantity", "std"), "PRICE": ("Price", "std"), "DISC": ("Discount", "std")}


def pair_rules(spark, d):
    """Names, units and results of the unfolded measures against registered pairs."""
    k = F.col("l_partkey")
    long = long_measures(spark, d).withColumns({
        "std_unit": F.when(k % 40 == 1, F.lit("other")).otherwise("std"),
        "value": F.when(k % 50 != 2, F.col("result").try_cast("double")),
        "unit": F.when(k % 60 == 3, "unknown-unit").otherwise(F.col("unit")),
    })
    found = rules.test_pair_rules(PAIRS, CONVERSIONS, "code", "name", "unit", "std_unit", "value")
    issues = rules.row_issues(long, TableSpec("LI", "Line items", ("l_orderkey", "l_linenumber", "code"), ()), found)
    return issues.select(*SHORT)


PAIR_SQL = f"""
  WITH {LONG_SQL}, m AS (SELECT code, name, l_orderkey || ' | ' || l_linenumber || ' | ' || code AS record_key, l_partkey,
    CASE WHEN l_partkey % 40 = 1 THEN 'other' ELSE 'std' END AS std_unit, CASE WHEN l_partkey % 60 = 3 THEN 'unknown-unit' ELSE unit END AS unit,
    CASE WHEN l_partkey % 50 <> 2 THEN CAST(result AS DOUBLE) END AS value FROM long)
  SELECT 'LOCAL013' AS rule_id, 'name' AS variable, record_key, name AS actual_value FROM m WHERE code = 'TAX' OR (code = 'PRICE')
  UNION ALL SELECT 'LOCAL014', 'std_unit', record_key, std_unit FROM m WHERE code = 'TAX' OR std_unit <> 'std'
  UNION ALL SELECT 'LOCAL016', 'unit', record_key, unit FROM m WHERE code = 'TAX' OR unit = 'unknown-unit'
  UNION ALL SELECT 'LOCAL015', 'value', record_key, NULL FROM m WHERE value IS NULL"""


def early_study_days(spark, d):
    m = masked(spark, d).select("o_orderkey", dates.iso_partial_text(F.col("raw"), ["dd-mmm-yyyy"]).alias("dtc"))
    days = m.withColumn("dy", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")))
    return rules.row_issues(days, ORDER, [rules.study_day_rule("dtc", "dy")]).select(*SHORT)


def analysis_structure(spark, d):
    doubled = adsl(spark, d)
    some = doubled.filter(F.col("USUBJID").cast("bigint") % 40 == 5)
    wrong = doubled.unionByName(some).withColumn("TRTSDT", F.col("TRTSDT").cast("string")).drop("SAFFL")
    return rules.analysis_structure(wrong, ADSL).select(*ANALYSIS)


STRUCTURE_SQL = f"""
  WITH {DM_SQL} SELECT 'ADAM001' AS rule_id, 'ADSL' AS dataset, '' AS variable, '{",".join(c for c in ADSL.order if c != "SAFFL")}' AS actual_value
  UNION ALL SELECT 'ADAM003', 'ADSL', 'TRTSDT', 'string'
  UNION ALL SELECT 'ADAM002', 'ADSL', 'STUDYID,USUBJID', CAST(count(*) AS VARCHAR)
    FROM dm WHERE CAST("USUBJID" AS BIGINT) % 40 = 5"""


def broken_subjects(spark, d):
    """Every subject rule broken on some subjects, and some subjects left out."""
    k = F.col("USUBJID").cast("bigint")
    table_ = adsl(spark, d).filter(k % 100 != 9).withColumns({
        "TRT01PN": F.when(k % 100 == 1, 9.0).otherwise(F.col("TRT01PN")),
        "TRTEDT": F.when(k % 100 == 2, F.to_date(F.lit("1980-01-01"))).otherwise(F.col("TRTEDT")),
        "TRTDURD": F.when(k % 100 == 3, -1.0).otherwise(F.col("TRTDURD")),
        "ITTFL": F.when(k % 100 == 4, "N").otherwise(F.col("ITTFL")),
        "SAFFL": F.when(k % 100 == 5, F.lit(None)).otherwise(F.col("SAFFL")),
    })
    return table_


def subject_rules(spark, d):
    return rules.validate_subject_table(broken_subjects(spark, d), dm(spark, d), PLAN).select(*ANALYSIS)


def subject_offenders(spark, d):
    return rules.subject_table_offenders(broken_subjects(spark, d), dm(spark, d), PLAN)


SUBJECT_LISTS_SQL = f"""
  WITH {ADSL_SQL}, s AS (SELECT *, CAST("USUBJID" AS BIGINT) AS k FROM adsl WHERE CAST("USUBJID" AS BIGINT) % 100 <> 9),
  lists AS (
    SELECT 'ADSL002' AS rule_id, 'TRT01PN' AS variable, "USUBJID" AS u FROM s WHERE k % 100 = 1
    UNION ALL SELECT 'ADSL003', 'TRT01AN', "USUBJID" FROM s WHERE k % 13 = 0
    UNION ALL SELECT 'ADSL004', 'TRTEDT', "USUBJID" FROM s WHERE k % 100 = 2 AND "TRTSDT" IS NOT NULL
    UNION ALL SELECT 'ADSL005', 'TRTDURD', "USUBJID" FROM s WHERE k % 100 = 3 OR (k % 100 = 2 AND "TRTSDT" IS NOT NULL)
    UNION ALL SELECT 'ADSL008', 'USUBJID', "USUBJID" FROM dm WHERE CAST("USUBJID" AS BIGINT) % 100 = 9)"""

SUBJECT_RULES_SQL = f"""{SUBJECT_LISTS_SQL}
  SELECT rule_id, 'ADSL' AS dataset, variable, CAST(count(DISTINCT u) AS VARCHAR) AS actual_value FROM lists GROUP BY rule_id, variable
  UNION ALL SELECT 'ADSL001', 'ADSL', 'USUBJID', CAST(count(*) AS VARCHAR) FROM s
  UNION ALL SELECT 'ADSL006', 'ADSL', 'ITTFL', '' FROM (SELECT 1 FROM s WHERE k % 100 = 4 LIMIT 1)
  UNION ALL SELECT 'ADSL007', 'ADSL', 'SAFFL', '' FROM (SELECT 1 FROM s WHERE k % 100 = 5 LIMIT 1)"""


def broken_events(spark, d):
    """Every event rule broken on some events."""
    k = F.col("AESEQ")
    subjects, base = built(spark, d)
    broken = base.filter(k % 200 != 11).withColumns({
        "USUBJID": F.when(k % 500 == 1, F.concat(F.lit("X"), "USUBJID")).otherwise(F.col("USUBJID")),
        "AENDT": F.when(k % 100 == 2, F.to_date(F.lit("1980-01-01"))).otherwise(F.col("AENDT")),
        "TRTEMFL": F.when(k % 100 == 3, "N").otherwise(F.col("TRTEMFL")),
        "TRTAN": F.when(k % 100 == 4, 99.0).otherwise(F.col("TRTAN")),
    })
    return subjects, broken


def event_rules(spark, d):
    subjects, broken = broken_events(spark, d)
    return rules.validate_event_table(broken, ae(spark, d), subjects, PLAN).select(*ANALYSIS)


def event_offenders(spark, d):
    subjects, broken = broken_events(spark, d)
    return rules.event_table_offenders(broken, subjects, PLAN)


EVENT_LISTS_SQL = f"""
  WITH {ADAE_SQL}, b AS (SELECT "AESEQ" AS k, CASE WHEN "AESEQ" % 500 = 1 THEN 'X' || "USUBJID" ELSE "USUBJID" END AS u, "USUBJID" AS was,
      "ASTDT", CASE WHEN "AESEQ" % 100 = 2 THEN DATE '1980-01-01' ELSE "AENDT" END AS "AENDT", "TRTSDT", "TRTEDT",
      CASE WHEN "AESEQ" % 100 = 3 THEN 'N' ELSE "TRTEMFL" END AS flag, "AEBODSYS" AS soc, "AEDECOD" AS pt,
      "AOCCFL", "AOCCSFL", "AOCCPFL" FROM adae WHERE "AESEQ" % 200 <> 11),
  r AS (SELECT *, CASE WHEN "TRTSDT" IS NULL THEN NULL WHEN "AENDT" < "TRTSDT" THEN NULL WHEN "ASTDT" IS NULL THEN 'Y'
      WHEN "ASTDT" BETWEEN "TRTSDT" AND "TRTEDT" + 30 THEN 'Y' END AS again FROM b),
  lists AS (
    SELECT DISTINCT 'ADAE002' AS rule_id, 'USUBJID' AS variable, u AS key FROM r WHERE k % 500 = 1
    UNION SELECT 'ADAE003', 'AENDT', u || '/' || k FROM r WHERE "ASTDT" > "AENDT"
    UNION SELECT 'ADAE005', 'TRTEMFL', u || '/' || k FROM r WHERE coalesce(flag, '') <> coalesce(again, '')
    UNION SELECT 'ADAE006', 'TRTA', u FROM r WHERE k % 500 = 1 OR k % 100 = 4),
  bad(rule_id, variable, n) AS (
    SELECT 'ADAE007', 'AOCCFL', count(*) FROM (SELECT u FROM r GROUP BY u HAVING count(*) FILTER (WHERE "AOCCFL" = 'Y') <> max(CASE WHEN flag = 'Y' THEN 1 ELSE 0 END))
    UNION ALL SELECT 'ADAE008', 'AOCCSFL', count(*) FROM (SELECT u FROM r GROUP BY u, soc HAVING count(*) FILTER (WHERE "AOCCSFL" = 'Y') <> max(CASE WHEN flag = 'Y' THEN 1 ELSE 0 END))
    UNION ALL SELECT 'ADAE009', 'AOCCPFL', count(*) FROM (SELECT u FROM r GROUP BY u, soc, pt HAVING count(*) FILTER (WHERE "AOCCPFL" = 'Y') <> max(CASE WHEN flag = 'Y' THEN 1 ELSE 0 END)))"""

EVENT_RULES_SQL = f"""{EVENT_LISTS_SQL}
  SELECT rule_id, 'ADAE' AS dataset, variable, CAST(count(*) AS VARCHAR) AS actual_value FROM lists GROUP BY rule_id, variable
  UNION ALL SELECT 'ADAE001', 'ADAE', '', 'ADAE=' || (SELECT count(*) FROM r) || ', source=' || (SELECT count(*) FROM ae)
    WHERE (SELECT count(*) FROM r) <> (SELECT count(*) FROM ae)
  UNION ALL SELECT 'ADAE004', 'ADAE', 'TRTEMFL', '' FROM (SELECT 1 FROM r WHERE flag <> 'Y' LIMIT 1)
  UNION ALL SELECT rule_id, 'ADAE', variable, '' FROM bad WHERE n > 0"""


def clean_analysis(spark, d):
    """No event rule fires on tables that the library built."""
    subjects, events = built(spark, d)
    issues = rules.validate_event_table(events, ae(spark, d), subjects, PLAN)
    structure = rules.analysis_structure(events, ADAE)
    return issues.unionByName(structure).select(*ANALYSIS)


def occurrence_groups(spark, d):
    wrong = adae(spark, d).withColumn("AOCCPFL", F.when(F.col("AESEQ") % 3 == 0, "Y").otherwise(F.col("AOCCPFL")))
    return rules.bad_occurrence_groups(wrong, ["USUBJID", "AEBODSYS", "AEDECOD"], "AOCCPFL")


def denominator_check(spark, d):
    people = tables.population(adsl(spark, d), "SAFFL")
    right = aggregates.denominators(people, "TRT01P", "USUBJID", SEGMENTS)
    stored = right.withColumn("n", F.when(F.col("grp").isin("BUILDING", "Total"), F.col("n") + 1).otherwise(F.col("n")))
    return rules.denominator_issues(stored, people, "TRT01P", "USUBJID", SEGMENTS, "T1").select(*ANALYSIS)


def stored_table_check(spark, d):
    subjects, events = built(spark, d)
    cells = tables.event_cells(subjects, events, SEGMENTS, "TRT01P", arm="TRTP").select("lvl", "AEBODSYS", "AEDECOD", "grp", "display")
    changed = cells.withColumn("display", F.when((F.col("lvl") == 0) & (F.col("grp") == "Total"), "0").otherwise(F.col("display")))
    same = rules.stored_table_issue(cells, cells, "T0")
    return same.unionByName(rules.stored_table_issue(changed, cells, "T1")).select(*ANALYSIS)


def empty_table_check(spark, d):
    e = table(spark, d, "events")
    return rules.empty_table_issue(e, "T0").unionByName(rules.empty_table_issue(e.filter(F.col("value") < -1e18), "T1")).select(*ANALYSIS)


def flagged_subject_check(spark, d):
    wrong = adae(spark, d).withColumn("AOCCFL", F.when(F.col("AESEQ") % 5 != 0, F.col("AOCCFL")))
    return rules.flagged_subject_issue(wrong, "T1").select(*ANALYSIS)


def overall_check(spark, d):
    _, events = built(spark, d)
    cells = aggregates.subject_counts(events.filter("AOCCFL = 'Y'"), [], "TRTP", "USUBJID", SEGMENTS)
    recount = aggregates.subject_counts(events.filter("SAFFL = 'Y' AND TRTEMFL = 'Y' AND AESEQ % 2 = 0"), [], "TRTP", "USUBJID", SEGMENTS)
    as_text = lambda df: df.select("grp", F.col("n").cast("string").alias("display"))
    return rules.overall_row_issue(as_text(cells), as_text(recount), "T1").select(*ANALYSIS)


def classified(spark, d):
    """Events as findings of an external validator."""
    e = table(spark, d, "events")
    k = (F.col("event_id") % 9).cast("int")
    ids = F.array(*[F.lit(x) for x in ("SD0057", "SD0057", "SD1077", "DD0101", "SD0001", "SD0002", "SD0003", "SD1321", "SD9999")])
    texts = F.array(*[F.lit(x) for x in (
        "Expected variable not present", "Other text", "Any text", "Any text", "Missing dictionary version", "Missing EX dataset",
        "MISSING define.XML file", "Any text", "missing TS dataset")])
    domains = F.array(*[F.lit(x) for x in ("DM", "AE", "DM", "AE", "AE", "EX", "VS", "CM", "GLOBAL")])
    findings = e.select(
        F.when(F.col("event_id") % 4 == 3, F.lit("LB")).otherwise(domains[k]).alias("domain"), ids[k].alias("rule_id"), texts[k].alias("message"),
        F.lit("").alias("variable"), F.lit(None).cast("string").alias("value"),
        F.when(F.col("event_id") % 2 == 0, "Reject").alias("severity"), F.col("event_id").alias("record"),
    )
    return rules.import_findings(findings).select("record_key", "severity", "issue_class")


CLASS_SQL = """
  WITH f AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'LB' ELSE ['DM','AE','DM','AE','AE','EX','VS','CM','GLOBAL'][event_id % 9 + 1] END AS domain,
    event_id % 9 AS k FROM events)
  SELECT domain || ' | ' || event_id AS record_key, CASE WHEN event_id % 2 = 0 THEN 'Reject' ELSE 'UNSPECIFIED' END AS severity,
    CASE WHEN k = 4 THEN 'external_dictionary_unavailable' WHEN k IN (0, 2, 3, 6, 7) THEN 'expected_mvp_scope'
      WHEN k IN (5, 8) AND domain IN ('EX', 'LB', 'GLOBAL') THEN 'expected_mvp_scope'
      WHEN domain IN ('DM', 'AE', 'VS') THEN 'generated_domain_defect' ELSE 'needs_review' END AS issue_class FROM f"""


def other_nations(spark, d):
    named = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rules.study_id_mismatch(named.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("STUDYID")), ["STUDYID"], " NATION_3 ")


def key_health(spark, d):
    l = table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber").cast("string")).otherwise(" ").alias("line")
    )
    return rules.key_health(l, ["l_orderkey", "line"])


SUBJECT_OFFENDERS_SQL = f"""{SUBJECT_LISTS_SQL}
  SELECT rule_id, 'ADSL' AS dataset, row_number() OVER (PARTITION BY rule_id ORDER BY u) AS ordinal, u AS offender FROM (SELECT DISTINCT rule_id, u FROM lists)"""

EVENT_OFFENDERS_SQL = f"""{EVENT_LISTS_SQL}
  SELECT rule_id, 'ADAE' AS dataset, row_number() OVER (PARTITION BY rule_id ORDER BY key) AS ordinal, key AS offender FROM lists"""

QUERIES = {
    "subject_table_offenders": (subject_offenders, SUBJECT_OFFENDERS_SQL),
    "event_table_offenders": (event_offenders, EVENT_OFFENDERS_SQL),
    "domain_checks": (domain_checks, DOMAIN_SQL),
    "duplicate_key_rule": (duplicate_keys, """
      SELECT 'LOCAL003' AS rule_id, 'LI' AS domain, 'l_orderkey,l_linenumber' AS variable, l_orderkey || ' | ' || l_linenumber AS record_key,
        l_orderkey || ' | ' || l_linenumber AS actual_value FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"""),
    "controlled_list_rule": (outside_list, """
      SELECT 'LOCAL006' AS rule_id, 'o_orderpriority' AS variable, CAST(o_orderkey AS VARCHAR) AS record_key, o_orderpriority AS actual_value
      FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""),
    "iso_date_rule": (bad_iso, f"""
      WITH {PARTIAL_SQL} SELECT 'LOCAL007' AS rule_id, 'dtc' AS variable, CAST(o_orderkey AS VARCHAR) AS record_key,
        CASE o_orderkey % 10 WHEN 5 THEN dtc || 'x' ELSE raw END AS actual_value FROM partial WHERE o_orderkey % 10 IN (4, 5)"""),
    "text_length_rule": (long_texts, """
      SELECT 'LOCAL008' AS rule_id, CAST(doc_id AS VARCHAR) AS record_key, md5(text) AS digest FROM documents WHERE strlen(text) > 200"""),
    "orphan_rule": (orphan_rows, """
      SELECT 'LOCAL010' AS rule_id, 'doc_id' AS variable, CAST(doc_id AS VARCHAR) AS record_key, CAST(doc_id AS VARCHAR) AS actual_value
      FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "sequence_rule": (broken_sequences, """
      SELECT 'LOCAL011' AS rule_id, 'l_linenumber' AS variable, l_orderkey || ' | ' || l_linenumber AS record_key, CAST(l_linenumber AS VARCHAR) AS actual_value
      FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1
        HAVING NOT (count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*)))"""),
    "event_date_rule": (reversed_dates, f"""
      WITH {AE_SQL} SELECT 'LOCAL012' AS rule_id, 'AEENDTC' AS variable, CAST("AESEQ" AS VARCHAR) AS record_key,
        "AESTDTC" || ' -> 1990-01-01' AS actual_value FROM ae WHERE "AESEQ" % 50 = 0 AND "AESEQ" % 17 <> 0"""),
    "test_pair_rules": (pair_rules, PAIR_SQL),
    "study_day_rule": (early_study_days, f"""
      WITH {PARTIAL_SQL} SELECT 'LOCAL017' AS rule_id, 'dy' AS variable, CAST(o_orderkey AS VARCHAR) AS record_key,
        CAST(o_orderkey AS VARCHAR) AS actual_value FROM partial WHERE length(dtc) < 10 AND o_orderkey % 4 <> 0"""),
    "analysis_structure_rules": (analysis_structure, STRUCTURE_SQL),
    "subject_table_rules": (subject_rules, SUBJECT_RULES_SQL),
    "event_table_rules": (event_rules, EVENT_RULES_SQL),
    "clean_event_table": (clean_analysis, """
      SELECT '' AS rule_id, '' AS dataset, '' AS variable, '' AS actual_value FROM orders WHERE false"""),
    "occurrence_rule": (occurrence_groups, f"""
      WITH {ADAE_SQL}, b AS (SELECT *, CASE WHEN "AESEQ" % 3 = 0 THEN 'Y' ELSE "AOCCPFL" END AS f FROM adae),
      g AS (SELECT "USUBJID", "AEBODSYS", "AEDECOD", count(*) FILTER (WHERE f = 'Y') AS marked, count(*) FILTER (WHERE "TRTEMFL" = 'Y') AS eligible,
        CAST(0 AS BIGINT) AS odd FROM b GROUP BY ALL)
      SELECT * FROM g WHERE (eligible > 0 AND marked <> 1) OR (eligible = 0 AND marked <> 0)"""),
    "denominator_rule": (denominator_check, f"""
      WITH {ADSL_SQL}, p AS (SELECT * FROM adsl WHERE "SAFFL" = 'Y')
      SELECT 'TLF001' AS rule_id, 'T1' AS dataset, 'denominator' AS variable,
        'BUILDING:' || (count(DISTINCT "USUBJID") FILTER (WHERE "TRT01P" = 'BUILDING') + 1) || ',Total:' || (count(DISTINCT "USUBJID") + 1) AS actual_value FROM p"""),
    "stored_table_rule": (stored_table_check, """
      SELECT 'TLF003' AS rule_id, 'T1' AS dataset, '' AS variable, '' AS actual_value WHERE (SELECT count(*) FROM orders) > 0"""),
    "empty_table_rule": (empty_table_check, """
      SELECT 'TLF002' AS rule_id, 'T1' AS dataset, '' AS variable, '' AS actual_value WHERE (SELECT count(*) FROM events) > 0"""),
    "flagged_subject_rule": (flagged_subject_check, f"""
      WITH {ADAE_SQL}, n AS (SELECT count(DISTINCT "USUBJID") FILTER (WHERE "AOCCFL" = 'Y' AND "AESEQ" % 5 <> 0) AS f,
        count(DISTINCT "USUBJID") FILTER (WHERE "SAFFL" = 'Y' AND "TRTEMFL" = 'Y') AS e FROM adae)
      SELECT 'TLF005' AS rule_id, 'T1' AS dataset, 'USUBJID' AS variable, CAST(f AS VARCHAR) AS actual_value FROM n WHERE f <> e"""),
    "overall_row_rule": (overall_check, f"""
      WITH {ADAE_SQL}, groups(grp) AS (VALUES {", ".join(f"('{s}')" for s in [*SEGMENTS, "Total"])}),
      n AS (SELECT grp, count(DISTINCT "USUBJID") FILTER (WHERE "AOCCFL" = 'Y') AS f,
        count(DISTINCT "USUBJID") FILTER (WHERE "SAFFL" = 'Y' AND "TRTEMFL" = 'Y' AND "AESEQ" % 2 = 0) AS e
        FROM groups JOIN adae ON grp = 'Total' OR grp = "TRTP" GROUP BY grp)
      SELECT 'TLF004' AS rule_id, 'T1' AS dataset, 'overall' AS variable, string_agg(grp || ':' || f, ',' ORDER BY grp || ':' || f) AS actual_value
      FROM n WHERE f <> e HAVING count(*) > 0"""),
    "classify_issue": (classified, CLASS_SQL),
    "study_id_mismatch": (other_nations, """
      SELECT DISTINCT n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> 'NATION_3'"""),
    "key_health": (key_health, """
      WITH k AS (SELECT l_orderkey, CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_linenumber AS VARCHAR) ELSE ' ' END AS line FROM lineitem)
      SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(line) = '') AS blank_key_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, line FROM k)) AS duplicate_rows FROM k"""),
}
