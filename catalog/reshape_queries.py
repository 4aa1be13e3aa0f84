"""Wide to long, stacking, comparing, display tables, flattening a nested plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SEGMENTS, table
from cohortloom.operators import reshape

# Fixed values of these queries: four measures, their invented units and linear conversions.
FINDINGS = [
    reshape.Finding("l_quantity", "QTY", "Quantity", "pieces"),
    reshape.Finding("l_extendedprice", "PRICE", "Extended price", "dollars"),
    reshape.Finding("l_discount", "DISC", "Discount", "share"),
    reshape.Finding("l_tax", "TAX", "Tax", unit_column="tax_unit"),
]
CONVERSIONS = [
    ("QTY", "pieces", "std", 0.5, 1.0, 1),
    ("PRICE", "USD", "std", 0.9, 0.0, 1),
    ("DISC", "share", "std", 100.0, 0.0, 0),
    ("TAX", "share", "std", 1000.0, 0.0, 0),
]


def wide_measures(spark, d):
    """Line items whose zero discounts are blank."""
    l = table(spark, d, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"), "l_tax", F.lit("share").alias("tax_unit"),
    )


def long_measures(spark, d):
    names = {"code": "code", "name": "name", "result": "result", "unit": "unit"}
    return reshape.transpose_findings(
        wide_measures(spark, d), FINDINGS, ["l_orderkey", "l_linenumber", "l_partkey"], names, {"dollars": "USD"}
    )


_LONG_PART = "SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS code, '{n}' AS name, CAST({x} AS VARCHAR) AS result, '{u}' AS unit FROM lineitem"
LONG_SQL = "long AS (" + " UNION ALL ".join([
    _LONG_PART.format(c="QTY", n="Quantity", x="l_quantity", u="pieces"),
    _LONG_PART.format(c="PRICE", n="Extended price", x="l_extendedprice", u="USD"),
    _LONG_PART.format(c="DISC", n="Discount", x="l_discount", u="share") + " WHERE l_discount <> 0",
    _LONG_PART.format(c="TAX", n="Tax", x="l_tax", u="share"),
]) + ")"


def transposed(spark, d):
    return long_measures(spark, d)


def stacked(spark, d):
    o = table(spark, d, "orders")
    done = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rest = o.filter(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return reshape.stack_blocks([done, rest])


def customers_without_order(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return reshape.set_diff(c, o.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey")))


def differences(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = c.withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 100 == 7, "CHANGED").when(F.col("c_custkey") % 100 == 8, F.lit(None)).otherwise(F.col("c_mktsegment"))
    )
    blank = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 == 8, "").otherwise(F.col("c_mktsegment")))
    return reshape.content_difference(blank, changed).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def segments_by_nation(spark, d):
    c = table(spark, d, "customer")
    counts = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    long = counts.withColumn("display", F.concat(F.lit("n="), "n"))
    wide = reshape.table_wide(long, ["c_nationkey"], "c_mktsegment", "display", SEGMENTS, ["c_nationkey"])
    return wide


def conversation_plans(spark, d):
    """Messages as nested plans: a line of the text is a step, its figures are the parameters."""
    c = table(spark, d, "conversations")
    steps = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.col("role").alias("transform_id"),
            F.array(F.col("role")).alias("target_variables"),
            F.array(F.lit("conversations.text")).alias("source_refs"),
            F.create_map(F.lit("n_chars"), F.length(line).cast("string"), F.lit("line"), i.cast("string")).alias("parameters"),
        ),
    )
    return c.select(
        F.concat_ws("-", F.lit("C"), "conv_id", "turn").alias("task_id"), F.concat(F.lit("G"), F.col("conv_id") % 10).alias("assembly_group_id"),
        F.lit("AE").alias("target_domain"), F.lit("variables").alias("output_kind"),
        F.array(F.lit("A"), F.lit("B")).alias("target_variables"), F.lit(None).cast("string").alias("status"), steps.alias("steps"),
    )


def plan_steps(spark, d):
    return reshape.step_rows(conversation_plans(spark, d)).withColumn("step_order", F.col("step_order").cast("bigint"))


def plan_parameters(spark, d):
    return reshape.parameter_rows(conversation_plans(spark, d)).withColumn("step_order", F.col("step_order").cast("bigint"))


def plan_heads(spark, d):
    return reshape.plan_rows(conversation_plans(spark, d)).drop("plan_json")


LINES_SQL = """lines AS (SELECT 'C-' || conv_id || '-' || turn AS task_id, 'G' || conv_id % 10 AS assembly_group_id, role,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS step_order, unnest(string_split(text, chr(10))) AS line FROM conversations)"""

QUERIES = {
    "transpose_findings": (transposed, f"WITH {LONG_SQL} SELECT * FROM long"),
    "stack_blocks": (stacked, """
      SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice,
        CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders"""),
    "set_difference": (customers_without_order, """
      SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""),
    "content_difference": (differences, """
      SELECT c_custkey, c_name, c_mktsegment, CAST(1 AS BIGINT) AS surplus FROM customer WHERE c_custkey % 100 = 7
      UNION ALL SELECT c_custkey, c_name, 'CHANGED', -1 FROM customer WHERE c_custkey % 100 = 7"""),
    "table_wide": (segments_by_nation, "SELECT c_nationkey, " + ", ".join(
        f"max('n=' || n) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS
    ) + " FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey"),
    "plan_rows": (plan_heads, """
      SELECT 'C-' || conv_id || '-' || turn AS task_id, 'G' || conv_id % 10 AS assembly_group_id, 'AE' AS target_domain,
        'variables' AS output_kind, '["A","B"]' AS target_variables, 'proposed' AS status FROM conversations"""),
    "plan_steps": (plan_steps, f"""
      WITH {LINES_SQL} SELECT task_id, assembly_group_id, step_order, role AS transform_id,
        '["conversations.text"]' AS source_refs, '["' || role || '"]' AS target_variables,
        '{{"n_chars":"' || length(line) || '","line":"' || step_order - 1 || '"}}' AS parameters FROM lines"""),
    "plan_parameters": (plan_parameters, f"""
      WITH {LINES_SQL} SELECT task_id, step_order, 'n_chars' AS parameter, CAST(length(line) AS VARCHAR) AS value FROM lines
      UNION ALL SELECT task_id, step_order, 'line', CAST(step_order - 1 AS VARCHAR) FROM lines"""),
}
