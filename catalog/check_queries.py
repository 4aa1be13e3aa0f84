"""Checks that ride on a write, gates, labels, refused lines, comparisons in order, and profiles that add up."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SEGMENTS, table
from catalog.join_queries import CODES
from catalog.reshape_queries import CONVERSIONS, LONG_SQL, long_measures
from catalog.source_queries import scratch
from catalog.table_queries import raw_subjects, raw_vitals
from cohortloom import specs
from cohortloom.errors import DataViolation
from cohortloom.operators import joins, reshape, rules, schema
from cohortloom.operators import profile as profiling
from cohortloom.operators.checks import Watch
from cohortloom.plans import study
from cohortloom.plans.example_mapping import example_tasks
from cohortloom.plans.mapping import draft_domain
from cohortloom.session import materialised
from cohortloom.sources import csv_files


def checks_on_write(spark, d):
    """Bad values of three checks that ride on one write: numbers, units, codes. One row a check."""
    long = long_measures(spark, d).withColumn("result", F.when(F.col("l_partkey") % 50 == 7, "n/a").otherwise(F.col("result")))
    long = long.withColumn("unit", F.when(F.col("l_orderkey") % 40 == 3, "barrels").otherwise(F.col("unit")))
    watch = Watch()
    done = joins.convert_units(long, "result", "unit", "code", "std", CONVERSIONS, {"dollars": "USD"}, "x", watch=watch)
    coded = done.withColumn("priority", F.when(F.col("l_linenumber") == 1, "1-URGENT").when(F.col("l_linenumber") == 2, "9-NEVER"))
    coded = joins.map_terms(coded, "priority", "short", "PRIORITY", CODES, watch=watch)
    try:
        materialised(coded, "watched", watch)
        failed = {}
    except DataViolation as found:
        failed = {name: (n, len(found.examples[name]) > 0) for name, n in found.counts.items()}
    return spark.createDataFrame([(name, n, quoted) for name, (n, quoted) in failed.items()], "check_name string, n bigint, quoted boolean")


def watched_left_join(spark, d):
    """The guarded join whose keys are judged by the write of its result."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    watch = Watch()
    joined = joins.guarded_left_join(o, c, {"o_custkey": "c_custkey"}, "many-to-one", ["c_mktsegment", "c_acctbal"], watch)
    return materialised(joined, "joined", watch).select("o_orderkey", "o_custkey", "c_mktsegment", "c_acctbal")


def gate_outcomes(spark, d):
    """The gate behind a table with errors, and behind one without."""
    line = specs.TableSpec("LINE", "Lines", ("l_orderkey",), (specs.Variable("l_returnflag", "Flag", controlled=("A", "N")),))
    lines = rules.row_issues(table(spark, d, "lineitem"), line, [rules.controlled_rule("l_returnflag", ["A", "N"])])
    nation = specs.TableSpec("NATION", "Nations", ("n_nationkey",), (specs.Variable("n_name", "Name", required=True),))
    nations = rules.row_issues(table(spark, d, "nation"), nation, rules.required_rules(table(spark, d, "nation"), nation))
    return rules.gate_outcome(lines, "lines").unionByName(rules.gate_outcome(nations, "nations"))


def labelled_columns(spark, d):
    """Labels and kinds as a written table keeps them, with the number of known values of each column."""
    subjects = draft_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw").write()
    stored = materialised(schema.apply_labels(subjects, specs.DM), "labelled")
    meta = [(f.name, f.metadata["label"], f.metadata["kind"], bool(f.metadata["required"])) for f in stored.schema.fields]
    known = stored.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("variable"), F.col(f.name).isNotNull().alias("known")) for f in stored.schema.fields])))
    counts = known.groupBy("variable").agg(F.count_if("known").alias("n_known"))
    return spark.createDataFrame(meta, "variable string, label string, kind string, required boolean").join(counts, "variable")


_KNOWN = {"RFSTDTC": "first_dose", "RFENDTC": "first_dose", "RFICDTC": "first_dose"}
LABEL_SQL = "WITH p AS (SELECT c_custkey, min(o_orderdate) AS first_dose FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT '{v.name}' AS variable, '{v.label}' AS label, '{v.kind}' AS kind, {str(v.required).lower()} AS required, count({_KNOWN.get(v.name, '*')}) AS n_known FROM p"
    for v in specs.DM.variables)


def absent_table_rule(spark, d):
    """Analysis tables that have no rows are taken as absent."""
    kept = {"ADSL": table(spark, d, "customer"), "ADAE": table(spark, d, "orders").where("o_totalprice < 0")}
    present = [name for name, df in kept.items() if not df.isEmpty()]
    return rules.missing_tables(spark, present).select("rule_id", "severity", "dataset", "message")


def _ranked(spark, d, second):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), second)


def rows_in_order(spark, d):
    """Nations by size: the stored table breaks ties the other way, so rows stand at other places."""
    return reshape.ordered_difference(_ranked(spark, d, "c_nationkey"), _ranked(spark, d, F.desc("c_nationkey")))


def swapped_rows_rule(spark, d):
    """A stored table whose rows are in another order raises the rule, one in the same order does not."""
    ordered = table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    swapped = ordered.orderBy(F.when(F.col("c_custkey") == 1, 2).when(F.col("c_custkey") == 2, 1).otherwise(F.col("c_custkey")))
    found = [rules.stored_table_issue(t, ordered, name, ordered=True) for name, t in {"T0": ordered, "T1": swapped}.items()]
    unordered = rules.stored_table_issue(swapped, ordered, "T2")
    return rules.union_all([*found, unordered]).select("rule_id", "dataset", "message")


def _bad_folder(spark, d):
    """Three files: one that fits, one with lines that don't, one whose header has another column."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").coalesce(1)
    path = scratch(spark, "mixed_csv")
    name = F.col("c_name")
    fit = F.concat_ws(",", "c_custkey", name, F.concat(F.lit('"a, ""b"" '), "c_mktsegment", F.lit('"')))
    k = F.col("c_custkey")
    odd = F.when(k % 30 == 4, F.concat_ws(",", "c_custkey", name)).when(k % 30 == 5, F.concat(fit, F.lit(",more"))).when(k % 30 == 6, F.concat(fit, F.lit('"'))).otherwise(fit)
    for file, line, head in (("a", fit, "key,name,segment"), ("b", odd, "key,name,segment"), ("c", fit, "key,title,segment")):
        first = spark.createDataFrame([(head,)], "value string").coalesce(1)
        first.union(c.where(k % 3 == {"a": 0, "b": 1, "c": 2}[file]).select(line.alias("value"))).coalesce(1).write.text(f"{path}/file={file}")
    return f"{path}/*"


def refused_lines(spark, d):
    lines = csv_files.refused_lines(spark, _bad_folder(spark, d), ["key", "name", "segment"])
    return lines.select(F.regexp_extract("file", "file=([a-z])", 1).alias("file"), "line", "text", "reason")


def header_report(spark, d):
    report = csv_files.header_report(spark, _bad_folder(spark, d), ["key", "name", "segment"])
    return report.select(F.regexp_extract("file", "file=([a-z])", 1).alias("file"), "header", "difference")


def profile_types(spark, d):
    """Types, grain and identifiers of the profile."""
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "PATNUM", "o_orderkey": "ORDER_ID"})
    p = profiling.profile(o, "orders", "ORDER_ID", None, ["ORDER_ID"], "one_record_per_candidate_key")
    return p.select("source_variable", "data_type", "grain", "is_identifier", "record_count")


def profile_sketch(spark, d):
    """Sketches of three files added up: exact counts and formats, and whether the estimates are those of the whole table and near
    the exact distinct counts."""
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    parts = [materialised(profiling.sketches(o.where(F.col("o_custkey") % 3 == k), F.lit(f"f{k}"), "o_orderkey"), "sketches") for k in range(3)]
    whole = profiling.sketches(o, None, "o_orderkey")
    added = profiling.profile_of(rules.union_all(parts), "orders", None, ["o_orderkey"])
    again = profiling.profile_of(rules.union_all([whole, whole.where("false")]), "orders").select("source_variable", F.col("unique_count").alias("whole"))
    exact = profiling.profile(o, "orders", "o_orderkey").select("source_variable", F.col("unique_count").alias("exact"))
    both = added.join(again, "source_variable").join(exact, "source_variable")
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.06 * F.col("exact") + 1
    same = F.abs(F.col("unique_count") - F.col("whole")) <= 0.03 * F.col("whole") + 1
    return both.select("source_variable", "record_count", F.round("missing_rate", 6).alias("missing_rate"), "format_candidates", near.alias("near_exact"), same.alias("as_whole"))


def vital_issue_rows(spark, d):
    """All rules over subjects and damaged vital signs, as full issue rows with mapping ids."""
    subjects = materialised(draft_domain("DM", example_tasks(), {"dm_raw": raw_subjects(spark, d)}, "dm_raw").write(), "DM")
    vitals = draft_domain("VS", example_tasks(), {"vs_raw": raw_vitals(spark, d)}, "vs_raw", subjects).write()
    pulse = F.col("VSTESTCD") == "PULSE"
    damaged = vitals.withColumns({
        "VSORRESU": F.when(pulse & (F.col("VSORRES") == "77"), "furlongs").otherwise(F.col("VSORRESU")),
        "VSTEST": F.when(pulse & (F.col("VSORRES") == "78"), "Pulsation").otherwise(F.col("VSTEST")),
        "VSSTRESN": F.when(pulse & (F.col("VSORRES") == "79"), F.lit(None).cast("double")).otherwise(F.col("VSSTRESN")),
        "VSPOS": F.when(pulse & (F.col("VSORRES") == "80"), "HANGING").otherwise(F.col("VSPOS")),
    })
    issues = study.check_standard_tables({"DM": subjects, "VS": materialised(damaged, "VS")}, example_tasks(), "run")
    return issues.select("rule_id", "severity", "domain", "variable", "record_key", "message", "actual_value", "mapping_id", "run_id", "validator", "issue_class")


_PULSE_ROWS = """WITH f AS (SELECT *, 50 + o_orderkey % 45 AS pulse, 'S1-' || c_nationkey || '-' || c_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
  r AS (SELECT f.*, code FROM f, (VALUES ('SYSBP'), ('DIABP'), ('PULSE'), ('HEIGHT'), ('WEIGHT'), ('TEMP')) t(code) WHERE code NOT IN ('HEIGHT', 'WEIGHT') OR o_orderkey % 3 <> 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, code, o_orderkey) AS seq FROM r),
  p AS (SELECT *, 'S1 | ' || id || ' | ' || seq AS record_key FROM n WHERE code = 'PULSE')"""


def _issue_sql(rule, variable, message, actual, pulse, ids):
    return f"""SELECT '{rule}' AS rule_id, 'ERROR' AS severity, 'VS' AS domain, '{variable}' AS variable, record_key, '{message}' AS message, {actual} AS actual_value,
      '{ids}' AS mapping_id, 'run' AS run_id, 'local' AS validator, 'generated_domain_defect' AS issue_class FROM p WHERE pulse = {pulse}"""


_ALL_TESTS = " | ".join(sorted(f"VS_{c}" for c in specs.TEST_PAIRS))

QUERIES = {
    "checks_on_write": (checks_on_write, f"""
      WITH {LONG_SQL} SELECT 'not_numeric' AS check_name, count(*) AS n, true AS quoted FROM long WHERE l_partkey % 50 = 7
      UNION ALL SELECT 'not_registered', count(*), true FROM long WHERE l_orderkey % 40 = 3
      UNION ALL SELECT 'short', count(*), true FROM long WHERE l_linenumber = 2"""),
    "watched_left_join": (watched_left_join, """
      SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "gate_outcomes": (gate_outcomes, """
      SELECT 'lines' AS stage, n AS errors, CAST(0 AS BIGINT) AS warnings, CASE WHEN n = 0 THEN 'open' ELSE 'closed' END AS gate
      FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
      UNION ALL SELECT 'nations', n, 0, CASE WHEN n = 0 THEN 'open' ELSE 'closed' END FROM (SELECT count(*) AS n FROM nation WHERE n_name IS NULL OR trim(n_name) = '')"""),
    "labelled_columns": (labelled_columns, LABEL_SQL),
    "absent_table_rule": (absent_table_rule, """
      SELECT 'ADAM000' AS rule_id, 'ERROR' AS severity, string_agg(name, ',' ORDER BY place) AS dataset, 'Analysis table is missing.' AS message
      FROM (SELECT 1 AS place, 'ADSL' AS name WHERE NOT EXISTS (FROM customer) UNION ALL SELECT 2, 'ADAE' WHERE NOT EXISTS (FROM orders WHERE o_totalprice < 0))
      HAVING count(*) > 0"""),
    "rows_in_order": (rows_in_order, """
      WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
      a AS (SELECT row_number() OVER (ORDER BY n DESC, c_nationkey) AS place, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(n AS VARCHAR) AS n FROM c),
      b AS (SELECT row_number() OVER (ORDER BY n DESC, c_nationkey DESC) AS place, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(n AS VARCHAR) AS n FROM c)
      SELECT *, CAST(1 AS BIGINT) AS surplus FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, -1 FROM (FROM b EXCEPT FROM a)"""),
    "swapped_rows_rule": (swapped_rows_rule, """
      SELECT 'TLF003' AS rule_id, 'T1' AS dataset, 'The stored table differs from the recomputed one.' AS message
      WHERE (SELECT count(*) FROM customer WHERE c_custkey IN (1, 2)) = 2"""),
    "refused_lines": (refused_lines, """
      WITH l AS (SELECT *, c_custkey || ',' || c_name || ',"a, ""b"" ' || c_mktsegment || '"' AS fit, 1 + row_number() OVER (ORDER BY c_custkey) AS line
        FROM customer WHERE c_custkey % 3 = 1),
      m AS (SELECT *, 1 + row_number() OVER (ORDER BY c_custkey) AS line FROM customer WHERE c_custkey % 3 = 1)
      SELECT 'b' AS file, line, c_custkey || ',' || c_name AS text, '2 fields, the header names 3' AS reason FROM l WHERE c_custkey % 30 = 4
      UNION ALL SELECT 'b', line, fit || ',more', '4 fields, the header names 3' FROM l WHERE c_custkey % 30 = 5
      UNION ALL SELECT 'b', line, fit || '"', 'a quote is not closed' FROM l WHERE c_custkey % 30 = 6"""),
    "header_report": (header_report, """
      SELECT file, header, difference FROM (VALUES ('a', 'key,name,segment', NULL), ('b', 'key,name,segment', NULL),
        ('c', 'key,title,segment', 'column 2: title in place of name')) t(file, header, difference) WHERE (SELECT count(*) FROM customer) > 0"""),
    "profile_types": (profile_types, """
      SELECT source_variable, data_type, 'one_record_per_candidate_key' AS grain, is_identifier, (SELECT count(*) FROM orders) AS record_count
      FROM (VALUES ('ORDER_ID', 'bigint', true), ('PATNUM', 'bigint', true), ('o_orderstatus', 'string', false), ('o_totalprice', 'double', false),
        ('o_orderdate', 'timestamp_ntz', false), ('o_orderpriority', 'string', false)) t(source_variable, data_type, is_identifier)"""),
    "profile_sketch": (profile_sketch, """
      SELECT name AS source_variable, (SELECT count(*) FROM orders) AS record_count,
        CASE WHEN name = 'o_totalprice' THEN (SELECT round(count(*) FILTER (WHERE o_orderkey % 9 = 0) / count(*), 6) FROM orders) ELSE 0 END::DOUBLE AS missing_rate,
        CASE WHEN name = 'day' THEN 'y-m-d' ELSE '' END AS format_candidates, true AS near_exact, true AS as_whole
      FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority'), ('day')) t(name)"""),
    "vital_issue_rows": (vital_issue_rows, " ".join([_PULSE_ROWS, " UNION ALL ".join([
        _issue_sql("LOCAL016", "VSORRESU", "Original unit is not registered for conversion.", "'furlongs'", 77, _ALL_TESTS),
        _issue_sql("LOCAL013", "VSTEST", "VSTEST does not belong to VSTESTCD.", "'Pulsation'", 78, _ALL_TESTS),
        _issue_sql("LOCAL015", "VSSTRESN", "Numeric result is missing.", "NULL", 79, _ALL_TESTS),
        _issue_sql("LOCAL006", "VSPOS", "Value is not in the controlled list.", "'HANGING'", 80, "VS_VSPOS"),
    ])])),
}
