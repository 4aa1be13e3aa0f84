"""Composite tables on the driver tables: standard, analysis and summary tables, lineage, issue report."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ADAE_SQL, ADSL_SQL, PLAN, SEGMENTS, adae, adsl, ae, built, dose_dates, places, table
from cohortloom.functions.dates import iso_to_date, treatment_emergent
from cohortloom.operators import aggregates
from cohortloom.operators.joins import add_subject_vars
from cohortloom.operators.rules import OCCURRENCE_FLAGS, union_all
from cohortloom.operators.windows import first_occurrence
from cohortloom.plans import analysis, lineage, study, tables
from cohortloom.plans.example_mapping import DOMAIN_SOURCES, example_tasks
from cohortloom.plans.mapping import build_domain, draft_domain
from cohortloom.session import materialised
from cohortloom.specs import ADAE, CODELISTS

GROUPS = [*SEGMENTS, "Total"]
GROUPS_SQL = "groups(grp, place) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(GROUPS)) + ")"


def emergent_overall(spark, d):
    """Subjects with an emergent event, per arm and overall, with percentages of the safety population."""
    events = ae(spark, d).select("STUDYID", "USUBJID", "AESEQ", "AESTDTC", "AEENDTC", "AEBODSYS", "AEDECOD")
    dated = events.withColumns({"ASTDT": iso_to_date(F.col("AESTDTC")), "AENDT": iso_to_date(F.col("AEENDTC"))})
    subjects = materialised(adsl(spark, d), "ADSL")
    joined = add_subject_vars(dated, subjects, ["STUDYID", "USUBJID"], ["TRT01P", "TRTSDT", "TRTEDT"])
    flag = treatment_emergent(*[F.col(c) for c in ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")], PLAN.window_days)
    flagged = first_occurrence(joined.withColumn("TRTEMFL", flag), {"AOCCFL": OCCURRENCE_FLAGS["AOCCFL"]})
    counts = aggregates.subject_counts(flagged.filter("AOCCFL = 'Y'"), [], "TRT01P", "USUBJID", SEGMENTS)
    sizes = aggregates.denominators(tables.population(subjects, "SAFFL"), "TRT01P", "USUBJID", SEGMENTS)
    both = counts.join(F.broadcast(sizes.select("grp", F.col("n").alias("d"))), "grp")
    return both.select("grp", "n", tables.count_percent(F.col("n"), F.col("d")).alias("display"))


OVERALL_SQL = f"""
  WITH {ADAE_SQL}, {GROUPS_SQL},
  d AS (SELECT grp, count(DISTINCT "USUBJID") AS d FROM groups LEFT JOIN (SELECT * FROM adsl WHERE "SAFFL" = 'Y') ON grp = 'Total' OR grp = "TRT01P" GROUP BY grp),
  n AS (SELECT grp, count(DISTINCT "USUBJID") AS n FROM groups LEFT JOIN (SELECT * FROM adae WHERE "TRTEMFL" = 'Y') ON grp = 'Total' OR grp = "TRTP" GROUP BY grp)
  SELECT grp, n, CASE WHEN d = 0 THEN printf('%d (NA)', n) ELSE printf('%d (%.1f%%)', n, 100.0::DOUBLE * n / d) END AS display FROM n JOIN d USING (grp)"""


def subject_table(spark, d):
    s = adsl(spark, d)
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("TRTSDT", "TRTEDT")})


def event_analysis_table(spark, d):
    e = adae(spark, d)
    shown = [c for c in ADAE.order if c in EVENT_COLUMNS]
    return e.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")}).select(*shown)


def event_analysis_table_spread(spark, d):
    """The same table from a subject table that was written before."""
    subjects = materialised(adsl(spark, d), "ADSL")
    e = analysis.derive_events(ae(spark, d), subjects, PLAN, ordered=False)
    return e.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")}).select(*EVENT_COLUMNS)


EVENT_COLUMNS = [
    "STUDYID", "USUBJID", "AESEQ", "AETERM", "AEDECOD", "AEBODSYS", "AESTDTC", "AEENDTC", "ASTDT", "AENDT", "TRTP", "TRTPN", "TRTA",
    "TRTAN", "TRTSDT", "TRTEDT", "SAFFL", "TRTEMFL", "AOCCFL", "AOCCSFL", "AOCCPFL",
]


def _sql_columns(names, dates_):
    return ", ".join(f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" if c in dates_ else f'"{c}"' for c in names)


def demographics(spark, d):
    cells = tables.demographic_cells(
        materialised(adsl(spark, d), "ADSL"), SEGMENTS, numeric=("AGE", "Balance"), categories={"SEX": "Sex", "RACE": "Region", "ETHNIC": "Segment"}
    )
    return cells.select("title", "Statistic", "grp", "display")


DEMOGRAPHICS_SQL = f"""
  WITH {ADSL_SQL}, {GROUPS_SQL}, p AS (SELECT * FROM adsl WHERE "ITTFL" = 'Y'),
  x AS (SELECT grp, p.* FROM groups LEFT JOIN p ON grp = 'Total' OR grp = "TRT01P"),
  s AS (SELECT grp, count("AGE") AS n, avg("AGE") AS m, stddev_samp("AGE") AS sd, median("AGE") AS md, min("AGE") AS lo, max("AGE") AS hi FROM x GROUP BY grp),
  c AS (SELECT grp, 'Sex' AS title, "SEX" AS level FROM x UNION ALL SELECT grp, 'Region', "RACE" FROM x UNION ALL SELECT grp, 'Segment', coalesce("ETHNIC", 'Missing') FROM x),
  d AS (SELECT grp, count(DISTINCT "USUBJID") AS d FROM x GROUP BY grp),
  l AS (SELECT DISTINCT title, level FROM c), z AS (SELECT title, level, grp FROM l CROSS JOIN groups),
  k AS (SELECT z.title, z.level, z.grp, count(c.level) AS n FROM z LEFT JOIN c ON c.title = z.title AND c.level = z.level AND c.grp = z.grp GROUP BY ALL)
  SELECT 'Balance' AS title, 'N' AS "Statistic", grp, CAST(n AS VARCHAR) AS display FROM s
  UNION ALL SELECT 'Balance', 'Mean', grp, printf('%.1f', m) FROM s UNION ALL SELECT 'Balance', 'Standard deviation', grp, printf('%.1f', sd) FROM s
  UNION ALL SELECT 'Balance', 'Median', grp, printf('%.1f', md) FROM s UNION ALL SELECT 'Balance', 'Minimum', grp, printf('%.1f', lo) FROM s
  UNION ALL SELECT 'Balance', 'Maximum', grp, printf('%.1f', hi) FROM s
  UNION ALL SELECT title, '  ' || level, grp, printf('%d (%.1f%%)', n, 100.0::DOUBLE * n / d) FROM k JOIN d USING (grp)"""


def event_summary(spark, d):
    """T14.3.1 with its display position, by planned arm."""
    cells = tables.event_cells(*built(spark, d), SEGMENTS, "TRT01P", arm="TRTP")
    return cells.select("AEBODSYS", "AEDECOD", "Parameter", "soc_n", "pt_n", "grp", "display")


def event_display(spark, d):
    subjects, events = built(spark, d)
    sizes = aggregates.denominators(tables.population(subjects, "SAFFL"), "TRT01P", "USUBJID", SEGMENTS)
    cells = tables.event_cells(subjects, events, SEGMENTS, "TRT01P", arm="TRTP")
    shown = tables.event_table(cells, sizes, SEGMENTS)
    # the oracle cannot name columns after counts, so the counts are taken off the headers
    return shown.toDF(*[c.split(" (N=")[0] for c in shown.columns])


EVENT_CELLS_SQL = f"""
  {ADAE_SQL}, {GROUPS_SQL},
  d AS (SELECT grp, count(DISTINCT "USUBJID") AS d FROM groups LEFT JOIN (SELECT * FROM adsl WHERE "SAFFL" = 'Y') ON grp = 'Total' OR grp = "TRT01P" GROUP BY grp),
  e AS (SELECT * FROM adae WHERE "TRTEMFL" = 'Y' AND "SAFFL" = 'Y'),
  soc AS (SELECT "AEBODSYS", count(DISTINCT "USUBJID") AS soc_n FROM e GROUP BY 1),
  pt AS (SELECT "AEBODSYS", "AEDECOD", count(DISTINCT "USUBJID") AS pt_n FROM e GROUP BY 1, 2),
  rows_ AS (SELECT NULL AS "AEBODSYS", NULL AS "AEDECOD", NULL AS soc_n, NULL AS pt_n, 'At least one treatment-emergent adverse event' AS "Parameter"
    UNION ALL SELECT "AEBODSYS", NULL, soc_n, NULL, "AEBODSYS" FROM soc
    UNION ALL SELECT "AEBODSYS", "AEDECOD", soc_n, pt_n, '  ' || "AEDECOD" FROM pt JOIN soc USING ("AEBODSYS")),
  cells AS (SELECT r."AEBODSYS", r."AEDECOD", r."Parameter", soc_n, pt_n, grp, count(DISTINCT e."USUBJID") AS n FROM rows_ r CROSS JOIN groups
    LEFT JOIN e ON (grp = 'Total' OR grp = e."TRTP") AND (r."AEBODSYS" IS NULL OR r."AEBODSYS" = e."AEBODSYS") AND (r."AEDECOD" IS NULL OR r."AEDECOD" = e."AEDECOD")
    GROUP BY ALL),
  shown AS (SELECT * EXCLUDE (n, d), printf('%d (%.1f%%)', n, 100.0::DOUBLE * n / d) AS display FROM cells JOIN d USING (grp))"""


# Raw sources made of the driver tables, mapped by the example tasks -----------------------------

_SEXES, _RACES, _ETHNICS = list(CODELISTS["SEX"]), list(CODELISTS["RACE"]), list(CODELISTS["ETHNIC"])


def _pick(words, index):
    return F.array(*[F.lit(w) for w in words])[F.pmod(index, F.lit(len(words))).cast("int")]


def raw_subjects(spark, d):
    c = table(spark, d, "customer")
    joined = c.join(dose_dates(spark, d), c.c_custkey == F.col("o_custkey"), "left").join(places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    us = lambda x: F.date_format(x, "MM/dd/yyyy")
    return joined.select(
        F.lit("S1").alias("STUDY"), F.concat_ws("-", F.col("c_nationkey"), k).alias("PATNUM"), us("first_dose").alias("FIRST_DOSE_DT"),
        us("last_dose").alias("LAST_DOSE_DT"), us(F.date_sub("first_dose", 14)).alias("IC_DT"), F.floor("c_acctbal").cast("string").alias("IT.AGE"),
        _pick(_SEXES, k).alias("IT.SEX"), _pick(_ETHNICS, k).alias("IT.ETHNIC"), _pick(_RACES, k).alias("IT.RACE"), F.col("r_name").alias("COUNTRY"),
        F.col("c_mktsegment").alias("PLANNED_ARM"), F.substring("c_mktsegment", 1, 3).alias("PLANNED_ARMCD"),
        F.col("c_mktsegment").alias("ACTUAL_ARM"), F.substring("c_mktsegment", 1, 3).alias("ACTUAL_ARMCD"), k.alias("_source_row"),
    )


def _orders_of_subjects(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("PATNUM", F.concat_ws("-", "c_nationkey", "c_custkey"))


def raw_events(spark, d):
    o, k = _orders_of_subjects(spark, d).filter(F.col("o_orderstatus") == "O"), F.col("o_orderkey")
    yes_no = _pick(["Yes", "No"], k)
    return o.select(
        F.lit("S1").alias("STUDY"), "PATNUM", F.concat(F.lit("Term "), k % 20).alias("IT.AETERM"), _pick(list(CODELISTS["AEOUT"]), k).alias("AEOUTCOME"),
        F.concat(F.lit("TERM "), k % 20).alias("AEDECOD"), F.col("o_orderpriority").alias("AEBODSYS"), _pick(list(CODELISTS["AESEV"]), k).alias("IT.AESEV"),
        yes_no.alias("IT.AESER"), yes_no.alias("IT.AESHOSP"), _pick(list(CODELISTS["AEREL"]), k).alias("IT.AEREL"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("IT.AESTDAT"),
        F.when(k % 7 != 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 5).cast("int")), "MM/dd/yyyy")).alias("IT.AEENDAT"),
        k.alias("_source_row"),
    )


def raw_vitals(spark, d):
    o, k = _orders_of_subjects(spark, d).filter(F.col("o_orderstatus") == "F"), F.col("o_orderkey")
    late = k % 3 == 2
    return o.select(
        F.lit("S1").alias("STUDY"), "PATNUM", _pick(["Screening 1", "Baseline", "Week 2"], k).alias("INSTANCE"),
        F.date_format("o_orderdate", "dd-MMM-yyyy").alias("VTLD"), (100 + k % 60).cast("string").alias("SYS_BP"), (60 + k % 30).cast("string").alias("DIA_BP"),
        (50 + k % 45).cast("string").alias("PULSE"), F.when(~late, (150 + k % 40).cast("string")).alias("IT.HEIGHT_VSORRES"),
        F.when(~late, F.concat((50 + k % 50).cast("string"), F.lit(".5"))).otherwise("").alias("IT.WEIGHT"),
        F.concat(F.lit("36."), k % 10).alias("IT.TEMP"), _pick(list(CODELISTS["VSPOS"]), k).alias("SUBPOS"), k.alias("_source_row"),
    )


def standard_subjects(spark, d):
    return build_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw")


def standard_events(spark, d):
    subjects = draft_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw")
    events = draft_domain("AE", example_tasks(), {"ae_raw": raw_events(spark, d)}, "ae_raw", subjects.finish(subjects.rows))
    events.watch.include(subjects.watch)
    return events.write().withColumn("AESEQ", F.col("AESEQ").cast("bigint"))


def standard_vitals(spark, d):
    """Subjects and vital signs in one plan: each source is read once, all checks ride on the one write."""
    subjects = draft_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw")
    vitals = draft_domain("VS", example_tasks(), {"vs_raw": raw_vitals(spark, d)}, "vs_raw", subjects.finish(subjects.rows))
    vitals.watch.include(subjects.watch)
    return vitals.write().withColumn("VSSEQ", F.col("VSSEQ").cast("bigint"))


def standard_vitals_spread(spark, d):
    """The same table from a subject table that was written and checked before."""
    subjects = build_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw")
    vitals = build_domain("VS", example_tasks(), {"vs_raw": raw_vitals(spark, d)}, "vs_raw", subjects)
    return vitals.withColumn("VSSEQ", F.col("VSSEQ").cast("bigint"))


def _term_sql(codelist, key):
    terms = list(CODELISTS[codelist].values())
    return f"[{', '.join(repr(t) for t in terms)}][{key} % {len(terms)} + 1]"


_ID = "'S1-' || c_nationkey || '-' || c_custkey"
_DOSES = """(SELECT o_custkey AS dk, min(o_orderdate) AS first_dose, max(o_orderdate) AS last_dose FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""
_DAY = "CAST(date_diff('day', first_dose, {x}) + CASE WHEN {x} >= first_dose THEN 1 ELSE 0 END AS DOUBLE)"

STANDARD_DM_SQL = f"""
  SELECT 'S1' AS "STUDYID", 'DM' AS "DOMAIN", {_ID} AS "USUBJID", c_nationkey || '-' || c_custkey AS "SUBJID",
    strftime(first_dose, '%Y-%m-%d') AS "RFSTDTC", strftime(last_dose, '%Y-%m-%d') AS "RFENDTC",
    strftime(CAST(first_dose AS DATE) - 14, '%Y-%m-%d') AS "RFICDTC", CAST(c_nationkey AS VARCHAR) AS "SITEID", floor(c_acctbal) AS "AGE", 'YEARS' AS "AGEU",
    {_term_sql("SEX", "c_custkey")} AS "SEX", {_term_sql("RACE", "c_custkey")} AS "RACE", {_term_sql("ETHNIC", "c_custkey")} AS "ETHNIC",
    substr(c_mktsegment, 1, 3) AS "ARMCD", c_mktsegment AS "ARM", substr(c_mktsegment, 1, 3) AS "ACTARMCD", c_mktsegment AS "ACTARM", r_name AS "COUNTRY"
  FROM customer LEFT JOIN {_DOSES} ON dk = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""

STANDARD_AE_SQL = f"""
  SELECT 'S1' AS "STUDYID", 'AE' AS "DOMAIN", {_ID} AS "USUBJID",
    row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, 'Term ' || o_orderkey % 20, o_orderkey) AS "AESEQ",
    'Term ' || o_orderkey % 20 AS "AETERM", 'TERM ' || o_orderkey % 20 AS "AEDECOD", o_orderpriority AS "AEBODSYS",
    {_term_sql("AESEV", "o_orderkey")} AS "AESEV", ['Y', 'N'][o_orderkey % 2 + 1] AS "AESER", {_term_sql("AEREL", "o_orderkey")} AS "AEREL",
    {_term_sql("AEOUT", "o_orderkey")} AS "AEOUT", ['Y', 'N'][o_orderkey % 2 + 1] AS "AESHOSP", strftime(o_orderdate, '%Y-%m-%d') AS "AESTDTC",
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(ended, '%Y-%m-%d') END AS "AEENDTC", {_DAY.format(x="o_orderdate")} AS "AESTDY",
    CASE WHEN o_orderkey % 7 <> 0 THEN {_DAY.format(x="ended")} END AS "AEENDY", CASE WHEN o_orderkey % 7 = 0 THEN 'ONGOING' END AS "AEENRF"
  FROM (SELECT *, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS ended FROM orders WHERE o_orderstatus = 'O')
  JOIN customer ON c_custkey = o_custkey LEFT JOIN {_DOSES} ON dk = c_custkey"""

STANDARD_VS_SQL = f"""
  WITH v AS (SELECT *, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN {_DOSES} ON dk = c_custkey WHERE o_orderstatus = 'F'),
  r AS (
    SELECT *, 'SYSBP' AS code, 'Systolic Blood Pressure' AS test, 'mmHg' AS unit, CAST(100 + k % 60 AS VARCHAR) AS res, 0 AS dec FROM v
    UNION ALL SELECT *, 'DIABP', 'Diastolic Blood Pressure', 'mmHg', CAST(60 + k % 30 AS VARCHAR), 0 FROM v
    UNION ALL SELECT *, 'PULSE', 'Pulse Rate', 'beats/min', CAST(50 + k % 45 AS VARCHAR), 0 FROM v
    UNION ALL SELECT *, 'HEIGHT', 'Height', 'cm', CAST(150 + k % 40 AS VARCHAR), 0 FROM v WHERE k % 3 <> 2
    UNION ALL SELECT *, 'WEIGHT', 'Weight', 'kg', 50 + k % 50 || '.5', 1 FROM v WHERE k % 3 <> 2
    UNION ALL SELECT *, 'TEMP', 'Temperature', 'C', '36.' || k % 10, 1 FROM v)
  SELECT 'S1' AS "STUDYID", 'VS' AS "DOMAIN", {_ID} AS "USUBJID",
    row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, code, k) AS "VSSEQ", code AS "VSTESTCD", test AS "VSTEST",
    {_term_sql("VSPOS", "k")} AS "VSPOS", res AS "VSORRES", unit AS "VSORRESU", res AS "VSSTRESC", CAST(res AS DOUBLE) AS "VSSTRESN", unit AS "VSSTRESU",
    [-1.0, 0.0, 2.0][k % 3 + 1]::DOUBLE AS "VISITNUM", ['Screening 1', 'Baseline', 'Week 2'][k % 3 + 1] AS "VISIT",
    strftime(o_orderdate, '%Y-%m-%d') AS "VSDTC", {_DAY.format(x="o_orderdate")} AS "VSDY" FROM r"""


def standard_issue_report(spark, d):
    """All rules over two standard tables, with damaged rows and mapping ids."""
    subjects = materialised(build_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw"), "DM")
    events = raw_events(spark, d).withColumn("PATNUM", F.when(F.col("_source_row") % 40 == 3, F.concat("PATNUM", F.lit("x"))).otherwise(F.col("PATNUM")))
    mapped = materialised(build_domain("AE", example_tasks(), {"ae_raw": events}, "ae_raw", subjects), "AE")
    damaged = mapped.withColumn("AESEV", F.when(F.col("AETERM") == "Term 5", "AWFUL").otherwise(F.col("AESEV")))
    issues = study.check_standard_tables({"DM": subjects, "AE": damaged}, example_tasks(), "run")
    return issues.groupBy("rule_id", "domain", "variable", "mapping_id").agg(F.count(F.lit(1)).alias("n"))


REPORT_SQL = """
  SELECT 'LOCAL006' AS rule_id, 'AE' AS domain, 'AESEV' AS variable, 'AE_AESEV' AS mapping_id, count(*) AS n FROM orders
    JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderkey % 20 = 5
  UNION ALL SELECT 'LOCAL010', 'AE', 'USUBJID', 'AE_USUBJID', count(*) FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'O' AND o_orderkey % 40 = 3"""


def table_manifests(spark, d):
    return study.manifests({"ADSL": adsl(spark, d), "ADAE": adae(spark, d)}).select("dataset", "records", F.col("variables").cast("bigint").alias("variables"))


def lineage_report(spark, d):
    """Field lineage of the mapping, joined to the size of each table that was built from the driver tables."""
    raw = {"DM": raw_subjects(spark, d), "AE": raw_events(spark, d), "VS": raw_vitals(spark, d)}
    sizes, subjects = [], None
    for domain, source in raw.items():
        done = build_domain(domain, example_tasks(), {DOMAIN_SOURCES[domain]: source}, DOMAIN_SOURCES[domain], subjects)
        subjects = done if domain == "DM" else subjects
        sizes.append(done.agg(F.lit(domain).alias("dataset"), F.count(F.lit(1)).alias("records"), F.lit("").alias("checksum")))
    rows = lineage.field_lineage(lineage.task_table(spark, example_tasks(), DOMAIN_SOURCES), union_all(sizes))
    return rows.groupBy("target_domain", "transform_id").agg(F.count(F.lit(1)).alias("n_steps"), F.max("records_created").alias("records"))


LINEAGE_SQL = """
  WITH n AS (SELECT 'DM' AS target_domain, count(*) AS records FROM customer UNION ALL SELECT 'AE', count(*) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'VS', 4 * count(*) + 2 * count(*) FILTER (WHERE o_orderkey % 3 <> 2) FROM orders WHERE o_orderstatus = 'F'),
  s(target_domain, transform_id, n_steps) AS (VALUES
    ('DM', 'assign_no_ct', 8), ('DM', 'hardcode_no_ct', 1), ('DM', 'derive_usubjid', 1), ('DM', 'assign_ct', 3), ('DM', 'to_iso8601_date', 3),
    ('DM', 'extract_delimited_part', 1), ('DM', 'hardcode_ct', 1),
    ('AE', 'assign_no_ct', 4), ('AE', 'hardcode_no_ct', 1), ('AE', 'derive_usubjid', 1), ('AE', 'assign_ct', 5), ('AE', 'to_iso8601_date', 2),
    ('AE', 'derive_ongoing_flag', 1), ('AE', 'derive_sequence', 1), ('AE', 'derive_study_day', 2),
    ('VS', 'assign_no_ct', 2), ('VS', 'hardcode_no_ct', 1), ('VS', 'derive_usubjid', 1), ('VS', 'assign_ct', 1), ('VS', 'to_iso8601_date', 1),
    ('VS', 'derive_visitnum', 1), ('VS', 'transpose_findings', 6), ('VS', 'standardize_unit', 6), ('VS', 'derive_sequence', 1), ('VS', 'derive_study_day', 1))
  SELECT target_domain, transform_id, CAST(n_steps AS BIGINT) AS n_steps, records FROM s JOIN n USING (target_domain)"""

QUERIES = {
    "emergent_overall": (emergent_overall, OVERALL_SQL),
    "standard_subjects": (standard_subjects, STANDARD_DM_SQL),
    "standard_events": (standard_events, STANDARD_AE_SQL),
    "standard_vitals": (standard_vitals, STANDARD_VS_SQL),
    "subject_table": (subject_table, f"""
      WITH {ADSL_SQL} SELECT * REPLACE (strftime("TRTSDT", '%Y-%m-%d') AS "TRTSDT", strftime("TRTEDT", '%Y-%m-%d') AS "TRTEDT") FROM adsl"""),
    "event_table": (event_analysis_table, f"WITH {ADAE_SQL} SELECT " + _sql_columns(EVENT_COLUMNS, ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")) + " FROM adae"),
    "event_table_spread": (event_analysis_table_spread, f"WITH {ADAE_SQL} SELECT " + _sql_columns(EVENT_COLUMNS, ("ASTDT", "AENDT", "TRTSDT", "TRTEDT")) + " FROM adae"),
    "standard_vitals_spread": (standard_vitals_spread, STANDARD_VS_SQL),
    "demographic_table": (demographics, DEMOGRAPHICS_SQL),
    "event_summary": (event_summary, f"WITH {EVENT_CELLS_SQL} SELECT \"AEBODSYS\", \"AEDECOD\", \"Parameter\", soc_n, pt_n, grp, display FROM shown"),
    "event_summary_display": (event_display, f"WITH {EVENT_CELLS_SQL} SELECT \"Parameter\", '' AS \"Statistic\", " + ", ".join(
        f"max(display) FILTER (WHERE grp = '{g}') AS \"{g}\"" for g in GROUPS) + ' FROM shown GROUP BY "AEBODSYS", "AEDECOD", "Parameter"'),
    "issue_report": (standard_issue_report, REPORT_SQL),
    "table_manifests": (table_manifests, """
      SELECT 'ADSL' AS dataset, count(*) AS records, CAST(19 AS BIGINT) AS variables FROM customer
      UNION ALL SELECT 'ADAE', count(*), 30 FROM orders WHERE o_orderstatus = 'O'"""),
    "field_lineage": (lineage_report, LINEAGE_SQL),
}
