"""Source profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import masked, table
from cohortloom.operators import profile as profiling

CUSTOMER_LABELS = {"c_name": "Customer name", "c_acctbal": "Balance"}


def customer_profile(spark, d):
    p = profiling.profile(table(spark, d, "customer"), "customer", "c_custkey", CUSTOMER_LABELS, ["c_custkey"], "one_record_per_candidate_key")
    return p.select(
        "source_dataset", "source_variable", "label", "example_values", F.round("missing_rate", 6).alias("missing_rate"),
        "unique_count", "keys", "concept_roles", "format_candidates", "partial_tokens", "record_count",
    )


def _column_profile(table_name: str, columns: list[tuple[str, str, str]], order: str, extra: str) -> str:
    """SQL of one profile row per column: (name, label, text expression)."""
    rows = []
    for name, label, text in columns:
        rows.append(f"""
          SELECT '{name}' AS source_variable, '{label}' AS label,
            (SELECT string_agg(v, ' | ' ORDER BY o, v) FROM (SELECT v, min({order}) AS o FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY o, v LIMIT 5)) AS example_values,
            round(count(*) FILTER (WHERE v IS NULL) / count(*), 6)::DOUBLE AS missing_rate, count(DISTINCT v) AS unique_count, count(*) AS record_count
          FROM t""".replace("FROM t", f"FROM (SELECT {order}, {text} AS v FROM {table_name})"))
    return f"SELECT *, {extra} FROM (" + " UNION ALL ".join(rows) + ")"


def hidden_profile(spark, d):
    """Renamed so that roles apply: identifiers and keys show no example values."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ORDER_NO"), F.col("o_custkey").alias("PATNUM"), F.col("o_orderstatus").alias("STATUS"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ORDERDAT"),
    )
    p = profiling.hide_identifiers(profiling.profile(o, "orders", "ORDER_NO", None, ["ORDER_NO"]))
    return p.select("source_variable", "label", "example_values", "unique_count", "concept_roles", "format_candidates")


def document_profile(spark, d):
    """Whole texts: long examples are cut to 120 characters in the report only."""
    p = profiling.profile(table(spark, d, "documents"), "documents", "doc_id")
    return p.select("source_variable", "unique_count", "record_count", F.length("example_values").cast("bigint").alias("shown"))


def formats(spark, d):
    o = table(spark, d, "orders")
    early = F.date_format(F.date_trunc("month", "o_orderdate"), "MM/dd/yyyy")
    late_first = F.date_format("o_orderdate", "dd/MM/yyyy")
    late_second = F.date_format("o_orderdate", "MM/dd/yyyy")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, late_first).otherwise(late_second)
    variants = [
        ("ambiguous", early), ("day_first", late_first), ("month_first", late_second), ("mixed", mixed),
        ("iso", F.date_format("o_orderdate", "yyyy-MM-dd")), ("clock", F.date_format("o_orderdate", "H:mm")),
        ("seconds", F.date_format("o_orderdate", "HH:mm:ss")), ("status", F.col("o_orderstatus")),
    ]
    wide = o.select("o_orderkey", *[c.alias(n) for n, c in variants])
    p = profiling.profile(wide, "orders", "o_orderkey").select("source_variable", "format_candidates")
    named = profiling.profile(masked(spark, d).select("o_orderkey", "raw"), "masked", "o_orderkey")
    both = p.unionByName(named.select("source_variable", "format_candidates"))
    return both.filter(F.col("source_variable") != "o_orderkey")


def one_column_formats(spark, d):
    return profiling.infer_date_formats(masked(spark, d), "raw")


KEY_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]


def candidate_keys(spark, d):
    rows = []
    for name in KEY_TABLES:
        df = table(spark, d, name)
        if name == "lineitem":
            df = df.withColumnsRenamed({"l_orderkey": "order_id", "l_linenumber": "line_seq"})
        key = profiling.candidate_key(df)
        rows.append((name, " | ".join(key), profiling.grain(key)))
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("turn_seq"), "role")
    key = profiling.candidate_key(turns)
    rows.append(("conversations", " | ".join(key), profiling.grain(key)))
    return spark.createDataFrame(rows, "dataset string, keys string, grain string")


# The rule text: first complete and unique column, names that look like identifiers first; else a pair of such columns.
_FIRST_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name"], "customer": ["c_custkey", "c_name"],
    "supplier": ["s_suppkey", "s_name"], "part": ["p_partkey", "p_name"], "orders": ["o_orderkey", "o_custkey"],
    "events": ["event_id", "user_id", "ts"], "documents": ["doc_id", "text"], "labels": ["doc_id"],
}
KEYS_SQL = " UNION ALL ".join([
    *[f"""SELECT '{t}' AS dataset, CASE """ + " ".join(
        f"WHEN (SELECT count(DISTINCT {c}) = count(*) FROM {t}) THEN '{c}'" for c in columns
    ) + " ELSE '' END AS keys" for t, columns in _FIRST_COLUMNS.items()],
    """SELECT 'lineitem', CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) = (SELECT count(*) FROM lineitem)
       THEN 'order_id | line_seq' ELSE '' END""",
    """SELECT 'conversations', CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) = (SELECT count(*) FROM conversations)
       THEN 'conv_id | turn_seq' ELSE '' END""",
])


def relationships(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "cust_id").select("cust_id", "o_orderkey", "o_totalprice")
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "cust_id").select("cust_id", "c_name")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_tax")
    e = table(spark, d, "events").select(F.col("user_id").alias("order_id"), "value")
    rows = [
        profiling.relationship(o, c, ["o_orderkey"], ["cust_id"], ("orders", "customer")),
        profiling.relationship(c, o, ["cust_id"], ["o_orderkey"], ("customer", "orders")),
        profiling.relationship(docs, labels, ["doc_id"], ["doc_id"], ("documents", "labels")),
        profiling.relationship(l, e, [], [], ("lineitem", "events")),
        profiling.relationship(docs, o, ["doc_id"], ["o_orderkey"], ("documents", "orders")),
    ]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


def _kind(left: str, right: str) -> str:
    l, r = f"(SELECT count(DISTINCT {left}) = count(*) FROM {{l}})", f"(SELECT count(DISTINCT {right}) = count(*) FROM {{r}})"
    return f"CASE WHEN {l} AND {r} THEN 'one-to-one' WHEN {r} THEN 'many-to-one' WHEN {l} THEN 'one-to-many' ELSE 'many-to-many' END"


def _relation(a, b, common, key, left, right, confidence):
    kind = _kind(left, right).format(l=a, r=b)
    return (f"SELECT '{a}' AS left_dataset, '{b}' AS right_dataset, '{common}' AS common_fields, '{key}' AS candidate_keys, "
            f"{kind} AS relationship, '{confidence}' AS confidence")


QUERIES = {
    "profile": (customer_profile, _column_profile("customer", [
        ("c_custkey", "c custkey", "CAST(c_custkey AS VARCHAR)"), ("c_name", "Customer name", "c_name"),
        ("c_nationkey", "c nationkey", "CAST(c_nationkey AS VARCHAR)"), ("c_acctbal", "Balance", "CAST(c_acctbal AS VARCHAR)"),
        ("c_mktsegment", "c mktsegment", "c_mktsegment"),
    ], "c_custkey", "'customer' AS source_dataset, 'c_custkey' AS keys, '' AS concept_roles, '' AS format_candidates, '' AS partial_tokens")),
    "hide_identifiers": (hidden_profile, """
      SELECT 'ORDER_NO' AS source_variable, 'ORDER NO' AS label, NULL AS example_values, count(DISTINCT o_orderkey) AS unique_count,
        '' AS concept_roles, '' AS format_candidates FROM orders
      UNION ALL SELECT 'PATNUM', 'PATNUM', NULL, count(DISTINCT o_custkey), 'subject_identifier', '' FROM orders
      UNION ALL SELECT 'STATUS', 'STATUS', (SELECT string_agg(s, ' | ' ORDER BY k) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY 1)),
        count(DISTINCT o_orderstatus), '', '' FROM orders
      UNION ALL SELECT 'ORDERDAT', 'ORDERDAT', (SELECT string_agg(s, ' | ' ORDER BY k) FROM (
          SELECT strftime(o_orderdate, '%Y-%m-%d') AS s, min(o_orderkey) AS k FROM orders GROUP BY 1 ORDER BY k LIMIT 5)),
        count(DISTINCT o_orderdate), 'date', 'y-m-d' FROM orders"""),
    "profile_documents": (document_profile, " UNION ALL ".join(
        f"""SELECT '{c}' AS source_variable, count(DISTINCT {c}) AS unique_count, count(*) AS record_count,
          (SELECT least(120, length(string_agg(v, ' | ' ORDER BY k))) FROM (SELECT CAST({c} AS VARCHAR) AS v, min(doc_id) AS k FROM documents GROUP BY 1 ORDER BY k LIMIT 5)) AS shown
        FROM documents""" for c in ("doc_id", "text", "lang", "source", "n_chars"))),
    "date_formats": (formats, """
      SELECT * FROM (VALUES ('ambiguous', 'm/d/y_or_d/m/y'), ('day_first', 'd-m-y'), ('month_first', 'm/d/y'),
        ('mixed', 'mixed_m/d/y_and_d/m/y'), ('iso', 'y-m-d'), ('clock', 'H:M'), ('seconds', 'H:M:S'), ('status', ''), ('raw', 'dd-mmm-yyyy'))
      t(source_variable, format_candidates) WHERE (SELECT max(day(o_orderdate)) FROM orders) > 12"""),
    "date_formats_of_column": (one_column_formats, "SELECT 'dd-mmm-yyyy' AS formats FROM orders WHERE o_orderkey % 10 > 3 LIMIT 1"),
    "candidate_keys": (candidate_keys, f"""
      SELECT dataset, keys, CASE WHEN keys = '' THEN 'unknown' WHEN contains(keys, '|') THEN 'one_record_per_composite_candidate_key'
        ELSE 'one_record_per_candidate_key' END AS grain FROM ({KEYS_SQL})"""),
    "relationships": (relationships, " UNION ALL ".join([
        _relation("orders", "customer", "cust_id", "cust_id", "o_custkey", "c_custkey", "medium"),
        _relation("customer", "orders", "cust_id", "cust_id", "c_custkey", "o_custkey", "medium"),
        _relation("documents", "labels", "doc_id", "doc_id", "doc_id", "doc_id", "high"),
        _relation("lineitem", "events", "order_id", "order_id", "l_orderkey", "user_id", "medium"),
        "SELECT 'documents', 'orders', '', '', 'unknown', 'low'",
    ])),
}
