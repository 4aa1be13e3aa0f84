"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import PRIORITIES, table
from catalog.reshape_queries import CONVERSIONS, LONG_SQL, long_measures
from cohortloom.operators import joins, rules
from cohortloom.plans.example_mapping import example_tasks
from cohortloom.plans.lineage import lineage_rows
from cohortloom.specs import TableSpec, Variable

CODES = {"PRIORITY": {p: p[:1] for p in PRIORITIES}, "SHORT": {p: p[:1] for p in PRIORITIES[:3]}}


def customer_of_order(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = joins.guarded_left_join(o, c, {"o_custkey": "c_custkey"}, "many-to-one", ["c_mktsegment", "c_acctbal"])
    return joined.select("o_orderkey", "o_custkey", "c_mktsegment", "c_acctbal")


def user_of_event(spark, d):
    """A left side with few keys, each cut into pieces."""
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    joined = joins.guarded_left_join(e, c, {"user_id": "c_custkey"}, "many-to-one", ["c_name"])
    return joined.select("event_id", "user_id", "c_name")


def priority_code(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return joins.map_terms(o, "o_orderpriority", "code", "PRIORITY", CODES)


def unknown_priorities(spark, d):
    return joins.unmatched_terms(table(spark, d, "orders"), "o_orderpriority", list(CODES["SHORT"].items()))


def role_number(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    maps = {"roles": {"system": 0, "user": 1, "assistant": 2}}
    return joins.visit_number(c, "role", "role_number", "roles", maps)


def nation_number(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 13, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise("elsewhere").alias("name"),
        F.when(F.col("c_nationkey") < 20, F.concat(F.lit("N"), "c_nationkey")).alias("code"),
    )
    rows = [(f"NATION_{i}", f"N{i}", float(i)) for i in range(25)]
    return joins.code_by_name_then_code(c, "name", "code", "number", rows)


def converted_units(spark, d):
    long = long_measures(spark, d)
    done = joins.convert_units(long, "result", "unit", "code", "std", CONVERSIONS, {"dollars": "USD"}, "std_result")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "code", "unit", "std_result")


def order_with_subject(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = joins.add_subject_vars(o, c, ["o_custkey"], ["c_mktsegment", "c_name"], {"c_mktsegment": "arm"})
    return joined.select("o_orderkey", "arm", "c_name")


def unlabelled_documents(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return joins.orphans(docs, labels, {"doc_id": "doc_id"}).select("doc_id", "lang", "n_chars")


DOCUMENT = TableSpec("DM", "Documents", ("doc_id",), (Variable("text", "Text"),))


def mapped_issues(spark, d):
    """Issues with the mapping ids of the variable they are about."""
    docs = table(spark, d, "documents").withColumnsRenamed({"lang": "SEX"}).select("doc_id", "SEX", "source")
    issues = rules.row_issues(docs, DOCUMENT, [
        rules.controlled_rule("SEX", ["en"]), rules.controlled_rule("source", ["web"]),
    ])
    found = rules.with_mapping_ids(issues, joins.lineage_ids(lineage_rows(spark, example_tasks())))
    return found.select("rule_id", "domain", "variable", "record_key", "actual_value", "mapping_id")


NAMES = ["p_name", "p_brand", "p_type", "p_size", "red widget", "SMALL RING", "small_ring", "widget", "ring", "blue gear"]


def similar_names(spark, d):
    return joins.match_names(table(spark, d, "part"), "p_name", NAMES)


SIMILAR_SQL = """
  WITH names(place, name) AS (VALUES {values}),
  wanted AS (SELECT DISTINCT p_name, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS plain FROM part),
  scored AS (SELECT p_name, place, name, plain, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS other FROM wanted CROSS JOIN names),
  ranked AS (SELECT p_name, place, name, CASE WHEN p_name = name THEN 1.0 WHEN upper(p_name) = upper(name) THEN 0.99
      WHEN plain = other THEN 0.97
      ELSE greatest(0, 1 - levenshtein(plain, other)::DOUBLE / greatest(length(plain), length(other))) END AS score FROM scored),
  top AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, place) AS r FROM ranked)
  SELECT p_name, max(name) FILTER (WHERE r = 1) AS suggested, round(max(score) FILTER (WHERE r = 1), 3)::DOUBLE AS score,
    string_agg(name, ' | ' ORDER BY r) AS alternatives FROM top WHERE r <= 3 GROUP BY p_name"""

QUERIES = {
    "guarded_left_join": (customer_of_order, """
      SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "guarded_left_join_spread": (user_of_event, """
      SELECT event_id, user_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id"""),
    "map_terms": (priority_code, "SELECT o_orderkey, o_orderpriority, substr(o_orderpriority, 1, 1) AS code FROM orders"),
    "unmatched_terms": (unknown_priorities, """
      SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""),
    "visit_number": (role_number, """
      SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 0.0 WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 2.0 END::DOUBLE AS role_number
      FROM conversations"""),
    "code_by_name_then_code": (nation_number, """
      SELECT c_custkey, CASE WHEN c_nationkey < 13 THEN 'NATION_' || c_nationkey ELSE 'elsewhere' END AS name,
        CASE WHEN c_nationkey < 20 THEN 'N' || c_nationkey END AS code,
        CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey AS DOUBLE) END AS number FROM customer"""),
    "convert_units": (converted_units, f"""
      WITH {LONG_SQL}, scaled AS (SELECT *, CASE code WHEN 'QTY' THEN CAST(result AS DOUBLE) * 0.5 + 1.0
          WHEN 'PRICE' THEN CAST(result AS DOUBLE) * 0.9 + 0.0 WHEN 'DISC' THEN CAST(result AS DOUBLE) * 100.0 + 0.0
          ELSE CAST(result AS DOUBLE) * 1000.0 + 0.0 END AS x FROM long)
      SELECT l_orderkey, l_linenumber, l_partkey, code, unit,
        CASE WHEN code IN ('QTY', 'PRICE') THEN
          CASE WHEN x - floor(x * 10) / 10 < ceil(x * 10) / 10 - x
               OR (x - floor(x * 10) / 10 = ceil(x * 10) / 10 - x AND CAST(floor(x * 10) AS BIGINT) % 2 = 0)
             THEN floor(x * 10) / 10 ELSE ceil(x * 10) / 10 END
        ELSE round_even(x, 0) END AS std_result FROM scaled"""),
    "add_subject_vars": (order_with_subject, """
      SELECT o_orderkey, c_mktsegment AS arm, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "orphans": (unlabelled_documents, """
      SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "lineage_of_issues": (mapped_issues, """
      SELECT 'LOCAL006' AS rule_id, 'DM' AS domain, 'SEX' AS variable, CAST(doc_id AS VARCHAR) AS record_key, lang AS actual_value,
        'DM_SEX' AS mapping_id FROM documents WHERE lang <> 'en'
      UNION ALL SELECT 'LOCAL006', 'DM', 'source', CAST(doc_id AS VARCHAR), source, '' FROM documents WHERE source <> 'web'"""),
    "match_names": (similar_names, SIMILAR_SQL.format(values=", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)))),
}
