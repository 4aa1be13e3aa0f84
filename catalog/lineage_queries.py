"""Where steps, variables and tables come from: full rows over tables that are built here."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DM_SQL, PLAN, SEGMENTS, adsl, built, dm, table
from catalog.table_queries import EVENT_CELLS_SQL, GROUPS, _orders_of_subjects, event_display, raw_events, raw_subjects, raw_vitals
from cohortloom import specs
from cohortloom.operators.aggregates import manifest
from cohortloom.operators.rules import union_all
from cohortloom.plans import lineage
from cohortloom.plans.example_mapping import DOMAIN_SOURCES, example_tasks
from cohortloom.plans.mapping import draft_domain
from cohortloom.specs import Task


def _text(name):
    return F.array_join(name, " | ").alias(name)


def _shown(rows):
    return rows.select(
        "task_id", "target_domain", "transform_id", _text("target_variables"), _text("source_datasets"), _text("source_fields"),
        "join_rule", "aggregation_rule", "unit_conversion_version", "records_created",
    )


def lineage_steps(spark, d):
    """Every step of the mapping of three tables, with the rows that it made, counted while its table was written."""
    raw = {"DM": raw_subjects(spark, d), "AE": raw_events(spark, d), "VS": raw_vitals(spark, d)}
    subjects, counts, sizes = None, {}, []
    for domain, source in raw.items():
        draft = draft_domain(domain, example_tasks(), {DOMAIN_SOURCES[domain]: source}, DOMAIN_SOURCES[domain], subjects)
        done = draft.write()
        subjects = done if domain == "DM" else subjects
        counts |= draft.counted()
        sizes.append(done.agg(F.lit(domain).alias("dataset"), F.count(F.lit(1)).alias("records"), F.lit("").alias("checksum")))
    return _shown(lineage.field_lineage(lineage.task_table(spark, example_tasks(), DOMAIN_SOURCES), union_all(sizes), counts))


_BLOCK_ROWS = {code: "orders WHERE o_orderstatus = 'F'" + (" AND o_orderkey % 3 <> 2" if code in ("HEIGHT", "WEIGHT") else "") for code in specs.TEST_PAIRS}


def _step_sql(tasks, rows_of, rules=None):
    """SQL of a lineage row for each task; ``rows_of`` says of which rows its count is, as text after FROM."""
    out = []
    for t in tasks:
        fields = [f"{DOMAIN_SOURCES[t.domain]}.{s}" for s in t.sources]
        join, aggregation = (rules or {}).get(t.transform, ("", ""))
        version = specs.UNIT_CONVERSION_VERSION if t.transform == "standardize_unit" else ""
        out.append(f"""SELECT '{t.id}' AS task_id, '{t.domain}' AS target_domain, '{t.transform}' AS transform_id, '{" | ".join(t.targets)}' AS target_variables,
          '{DOMAIN_SOURCES[t.domain] if t.sources else ""}' AS source_datasets, '{" | ".join(fields)}' AS source_fields, '{join}' AS join_rule,
          '{aggregation}' AS aggregation_rule, '{version}' AS unit_conversion_version, (SELECT count(*) FROM {rows_of(t)}) AS records_created""")
    return " UNION ALL ".join(out)


def _rows_of_example(t):
    if t.domain == "DM":
        return "customer"
    if t.domain == "AE":
        return "orders WHERE o_orderstatus = 'O'"
    if t.transform in ("transpose_findings", "standardize_unit"):
        return _BLOCK_ROWS[t.parameters["test_code"] if "test_code" in t.parameters else t.id.removeprefix("VS_")]
    if t.transform in ("derive_sequence", "derive_study_day"):
        return "(" + " UNION ALL ".join(f"SELECT 1 FROM {r}" for r in _BLOCK_ROWS.values()) + ") x"
    return "orders WHERE o_orderstatus = 'F'"


# A small mapping with a merge and a reference date, in place of the one that copies both from its source.
_BY, _PARTS = {"PATNUM": "PATNUM"}, [
    {"dataset": "open", "date_variable": "DAY", "date_formats": ["y-m-d"]}, {"dataset": "done", "date_variable": "DAY", "date_formats": ["y-m-d"]}]
MERGED = [
    Task("SITE", "DM", "merge_sources", (), (), {
        "left_dataset": "dm_raw", "right_dataset": "sites", "by": _BY, "relationship": "many-to-one", "select": ["PLACE"], "output_dataset": "dm_placed"}),
    Task("FIRST", "DM", "derive_reference_datetime", ("RFSTDTC",), (), {"selection": "min", "subject_keys": ["PATNUM"], "sources": _PARTS}),
    *[t for t in example_tasks() if t.domain == "DM" and t.targets[0] not in ("RFSTDTC", "COUNTRY")],
    Task("COUNTRY", "DM", "assign_no_ct", ("COUNTRY",), ("PLACE",), {}),
]


def merged_draft(spark, d):
    people = raw_subjects(spark, d)
    orders = _orders_of_subjects(spark, d).select("PATNUM", F.date_format("o_orderdate", "yyyy-MM-dd").alias("DAY"), "o_orderstatus", F.col("o_orderkey").alias("_source_row"))
    sources = {
        "dm_raw": people.drop("COUNTRY"), "sites": people.select("PATNUM", F.col("COUNTRY").alias("PLACE")),
        "open": orders.where("o_orderstatus = 'O'"), "done": orders.where("o_orderstatus = 'F'"),
    }
    return draft_domain("DM", MERGED, sources, "dm_raw")


def merged_lineage(spark, d):
    """Steps of a mapping that merges sources and takes a date from two others: both rules are in the lineage."""
    draft = merged_draft(spark, d)
    done = draft.write()
    size = done.agg(F.lit("DM").alias("dataset"), F.count(F.lit(1)).alias("records"), F.lit("").alias("checksum"))
    rows = lineage.field_lineage(lineage.task_table(spark, MERGED, DOMAIN_SOURCES), size, draft.counted())
    return _shown(rows)


def merged_subjects(spark, d):
    """The table of that mapping: country from the merged source, first date from open and finished orders."""
    return merged_draft(spark, d).write().select("USUBJID", "COUNTRY", "RFSTDTC", "RFENDTC", "AGE")


_MERGE_RULE = '{"by":"{\\"PATNUM\\": \\"PATNUM\\"}","left_dataset":"\\"dm_raw\\"","relationship":"\\"many-to-one\\"","right_dataset":"\\"sites\\""}'
_DATE_RULE = (
    '{"selection":"\\"min\\"","sources":"[{\\"dataset\\": \\"open\\", \\"date_variable\\": \\"DAY\\", \\"date_formats\\": [\\"y-m-d\\"]}, '
    '{\\"dataset\\": \\"done\\", \\"date_variable\\": \\"DAY\\", \\"date_formats\\": [\\"y-m-d\\"]}]","subject_keys":"[\\"PATNUM\\"]"}')


def variable_lineage(spark, d):
    """Every variable of the subject table with its rule and the checksum of what it was derived from."""
    rows = lineage.variable_lineage(spark, specs.ADSL, PLAN, manifest(dm(spark, d), "DM"))
    return rows.select("target_dataset", "target_variable", _text("source_variables"), "rule_id", "plan_version", F.to_json("input_checksums").alias("input_checksums"))


def checksum_sql(source, columns):
    """The checksum of a table as SQL: rows, and the sums of both halves of the rows' md5."""
    text = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns)
    half = "coalesce(sum(CAST(CAST('0x' || substr(h, {}, 16) AS UBIGINT) AS HUGEINT)), 0)"
    return f"SELECT count(*) || '-' || {half.format(1)} || '-' || {half.format(17)} AS checksum FROM (SELECT md5({text}) AS h FROM {source})"


_DM_COLUMNS = [f'"{c}"' for c in (
    "STUDYID", "DOMAIN", "USUBJID", "SUBJID", "RFSTDTC", "RFENDTC", "SITEID", "AGE", "AGEU", "SEX", "RACE", "ETHNIC", "COUNTRY", "ARMCD", "ARM", "ACTARMCD", "ACTARM")]


def table_lineage(spark, d):
    """The summary tables with rule, population and the checksum of the built event table."""
    outputs = manifest(event_display(spark, d), "T14.3.1")
    rows = lineage.table_lineage(spark, outputs, PLAN)
    return rows.select("table_id", _text("source_datasets"), "shell_rule_id", "population", "treatment_basis", "plan_version", "result_checksum")


_DISPLAY_SQL = "SELECT \"Parameter\", '' AS \"Statistic\", " + ", ".join(
    f"max(display) FILTER (WHERE grp = '{g}') AS \"{g}\"" for g in GROUPS) + ' FROM shown GROUP BY "AEBODSYS", "AEDECOD", "Parameter"'

QUERIES = {
    "lineage_steps": (lineage_steps, _step_sql(example_tasks(), _rows_of_example)),
    "merged_lineage": (merged_lineage, _step_sql(MERGED, lambda t: "customer", {"merge_sources": (_MERGE_RULE, ""), "derive_reference_datetime": ("", _DATE_RULE)})),
    "merged_subjects": (merged_subjects, """
      SELECT 'S1-' || c_nationkey || '-' || c_custkey AS "USUBJID", r_name AS "COUNTRY", strftime(least(f, o), '%Y-%m-%d') AS "RFSTDTC",
        strftime(l, '%Y-%m-%d') AS "RFENDTC", floor(c_acctbal) AS "AGE"
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS f, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS o,
        max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS l FROM orders GROUP BY 1) x ON o_custkey = c_custkey"""),
    "variable_lineage": (variable_lineage, f"""
      WITH {DM_SQL}, c AS ({checksum_sql("dm", _DM_COLUMNS)}),
      v(target_variable, source_variables, rule_id) AS (VALUES {", ".join(f"('{v.name}', '{' | '.join(v.sources)}', '{v.rule_id}')" for v in specs.ADSL.variables)})
      SELECT 'ADSL' AS target_dataset, target_variable, source_variables, rule_id, '{PLAN.version}' AS plan_version,
        '{{"DM":"' || checksum || '"}}' AS input_checksums FROM v, c"""),
    "table_lineage": (table_lineage, f"""
      WITH {EVENT_CELLS_SQL}, wide AS ({_DISPLAY_SQL}), c AS ({checksum_sql("wide", [f'"{c}"' for c in ["Parameter", "Statistic", *GROUPS]])})
      SELECT 'T14.1.1' AS table_id, 'ADSL' AS source_datasets, 'T_DEMOGRAPHICS_STANDARD' AS shell_rule_id, 'Intent-to-treat population' AS population,
        'planned' AS treatment_basis, '{PLAN.version}' AS plan_version, NULL AS result_checksum
      UNION ALL SELECT 'T14.3.1', 'ADSL | ADAE', 'T_TEAE_SOC_PT', 'Safety population', 'actual', '{PLAN.version}', checksum FROM c"""),
}
