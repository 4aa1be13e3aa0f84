"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import MASKED_SQL, PARTIAL_SQL, adsl, ADSL_SQL, iso, masked, table
from cohortloom.functions import conditions, dates, numbers, text
from cohortloom.operators.checks import Check, violation_counts
from cohortloom.operators.schema import conform, drop_source
from cohortloom.plans.mapping import constant_from_codelist
from cohortloom.plans.tables import population
from cohortloom.specs import TableSpec, UNIT_ALIASES, Variable


def assign(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("subject_name"))


def constant(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lit("DM").alias("domain"))


def codelist_constant(spark, d):
    return table(spark, d, "orders").select("o_orderkey", constant_from_codelist("YEARS", "AGEU").alias("unit"))


def _status(name="o_orderstatus"):
    k = F.col("o_orderkey") % 10
    return F.when(k == 2, "  ").when(k == 3, F.lit(None).cast("string")).otherwise(F.col(name))


STATUS_SQL = "CASE o_orderkey % 10 WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE o_orderstatus END"


def five_conditions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _status().alias("s"))
    s = F.col("s")
    as_int = lambda c: F.when(c, 1).otherwise(0)
    return o.select(
        "o_orderkey",
        as_int(conditions.condition(s, "equals", "F")).alias("is_equal"),
        as_int(conditions.condition(s, "not_equals", "F")).alias("is_other"),
        as_int(conditions.condition(s, "in", ["O", "P"])).alias("is_in"),
        as_int(conditions.condition(s, "is_missing")).alias("is_missing"),
        as_int(conditions.condition(s, "not_missing")).alias("is_present"),
    )


def conditional_value(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _status().alias("s"))
    value = conditions.conditional_assign(conditions.condition(F.col("s"), "equals", "F"), "DONE", "OPEN")
    return o.select("o_orderkey", value.alias("state"))


def ongoing(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _status().alias("s"), "o_orderpriority")
    flag = conditions.ongoing_flag(F.col("s"), F.col("o_orderpriority"), ["1-URGENT"])
    return o.select("o_orderkey", flag.alias("flag"))


LINE = TableSpec("LINE", "Line items", (), (
    Variable("l_orderkey", "Order", "numeric", True),
    Variable("l_linenumber", "Line", "numeric", True),
    Variable("l_returnflag", "Return flag"),
    Variable("l_quantity", "Quantity", "numeric"),
    Variable("l_extendedprice", "Price", "numeric"),
    Variable("l_missing", "An optional column that is not there"),
    Variable("l_shipdate", "Ship date", "date"),
))


def conformed(spark, d):
    raw = table(spark, d, "lineitem")
    as_text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c != "l_shipdate"], "l_shipdate")
    fitted = conform(as_text, LINE)
    return fitted.withColumn("l_shipdate", iso("l_shipdate"))


def in_population(spark, d):
    return population(adsl(spark, d), "SAFFL").select("USUBJID", "SITEID", "SAFFL")


def without_source(spark, d):
    kept, row = drop_source(table(spark, d, "customer"), "c_acctbal", "balance is not part of the study")
    return kept.withColumn("dropped", F.lit(row["source"]))


def combined(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    fields = [F.col("c_name"), F.col("seg"), F.col("c_custkey")]
    return c.select(
        "c_custkey",
        text.combine(fields, "-").alias("strict"),
        text.combine(fields, "-", "skip_missing").alias("skipping"),
        text.subject_id([F.lit("S1"), F.col("seg")]).alias("subject_id"),
    )


def delimited_part(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        text.part(F.col("p_name"), " ", 1).alias("first"),
        text.part(F.col("p_name"), " ", 2).alias("second"),
        text.part(F.col("p_name"), " ", 3).alias("third"),
        text.part(F.col("p_brand"), "#", 2).alias("brand_no"),
    )


def letter_case(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.change_case(F.col("p_name"), "upper").alias("up"), text.change_case(F.col("p_type"), "lower").alias("low"))


def first_present(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _status().alias("s"), "o_orderpriority", "o_orderstatus")
    return o.select("o_orderkey", text.coalesce_fields([F.col("s"), F.col("o_orderpriority")]).alias("value"))


def disagreements(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _status().alias("s"), "o_orderstatus", F.upper("o_orderstatus").alias("u"))
    clash = text.fields_disagree([F.col("s"), F.lit("F")])
    return violation_counts(o, [
        Check("same_field", text.fields_disagree([F.col("s"), F.col("o_orderstatus")]), F.col("s")),
        Check("other_field", clash, F.col("s")),
    ])


def normalised_unit(spark, d):
    p = table(spark, d, "part")
    words = F.array(*[F.lit(u) for u in ("lbs", "inches", "cm", "degF", "furlong")])
    unit = words[(F.col("p_partkey") % 5).cast("int")]
    return p.select("p_partkey", unit.alias("raw_unit")).withColumn("unit", text.unit_alias(F.col("raw_unit"), UNIT_ALIASES))


def slugs(spark, d):
    p = table(spark, d, "part")
    name = F.concat_ws(" ", F.lit("#"), F.col("p_size"), F.col("p_name"), F.col("p_brand"), F.lit("--"))
    return p.select("p_partkey", text.slug(name).alias("slug"), text.norm_name(name).alias("norm"))


def secret_texts(spark, d):
    patterns = [text.SECRET_PATTERN, r"(?i)token\s*[:=]\s*['\"]?[A-Za-z0-9_-]{16,}"]
    docs = table(spark, d, "documents")
    return docs.filter(text.has_secret(F.col("text"), patterns)).select("doc_id", "source")


def redacted(spark, d):
    docs = table(spark, d, "documents")
    clean = text.redact(F.col("text"), ["token", "The", "the"])
    return docs.select("doc_id", F.length(clean).cast("bigint").alias("n_clean"), F.md5(clean).alias("digest"))


def shares(spark, d):
    l = table(spark, d, "lineitem")
    by = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("n"))
    empty = F.when(F.col("l_suppkey") % 9 == 0, 0).otherwise(F.col("d"))
    return by.select("l_suppkey", numbers.count_percent(F.col("n"), empty).alias("share"))


def fixed_text(spark, d):
    l = table(spark, d, "lineitem")
    x = F.col("l_extendedprice") * F.col("l_discount") - F.col("l_tax") * 1000
    return l.select("l_orderkey", "l_linenumber", "l_extendedprice", numbers.one_decimal(x).alias("shown"))


def us_dates(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 2, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise("31/31/2024")
    )
    o = o.select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.iso_date_text(F.col("raw"), ["m/d/y", "y-m-d", "dd-mmm-yyyy"]).alias("dtc"))


def day_first_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "d-M-yyyy").alias("raw"))
    return o.select("o_orderkey", dates.iso_date_text(F.col("raw"), ["d-m-y"]).alias("dtc"))


def unreadable_dates(spark, d):
    m = masked(spark, d)
    text_date = dates.iso_date_text(F.col("raw"), ["dd-mmm-yyyy"])
    return violation_counts(m, [Check("bad", dates.unreadable_date(F.col("raw"), text_date), F.col("raw"))])


def datetimes(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.date_format("ts", "MM/dd/yyyy").alias("day"),
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "H:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm")).alias("clock"),
    )
    return e.select("event_id", dates.iso_datetime_text(F.col("day"), ["m/d/y", "H:M"], F.col("clock")).alias("dtc"))


def one_column_datetimes(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw"))
    return e.select("event_id", dates.iso_datetime_text(F.col("raw"), ["y-m-d H:M:S"]).alias("dtc"))


def partial_dates(spark, d):
    return masked(spark, d).select("o_orderkey", dates.iso_partial_text(F.col("raw"), ["dd-mmm-yyyy"]).alias("dtc"))


def _partial(spark, d):
    return masked(spark, d).select("o_orderkey", "o_orderdate", dates.iso_partial_text(F.col("raw"), ["dd-mmm-yyyy"]).alias("dtc"))


def partial_to_date(spark, d):
    p = _partial(spark, d)
    return p.select(
        "o_orderkey",
        F.when(dates.is_complete_date(F.col("dtc")), 1).otherwise(0).alias("complete"),
        F.date_format(dates.iso_to_date(F.col("dtc")), "yyyy-MM-dd").alias("day"),
    )


def study_days(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    joined = l.join(o, l.l_orderkey == o.o_orderkey)
    day = dates.study_day(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", day.cast("bigint").alias("study_day"))


def durations(spark, d):
    return adsl(spark, d).select(
        "USUBJID", dates.duration_inclusive(F.col("TRTSDT"), F.col("TRTEDT")).cast("bigint").alias("days"), "ITTFL", "SAFFL"
    )


def valid_iso(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'08:00")).when(k == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
        .when(k == 4, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(" ")
    )
    return o.select("o_orderkey", F.when(dates.iso_valid(raw), 1).otherwise(0).alias("valid"))


def linear(spark, d):
    l = table(spark, d, "lineitem")
    x = numbers.linear_convert(F.col("l_extendedprice"), F.lit(0.45359237), F.lit(-17.5), F.lit(1))
    return l.select("l_orderkey", "l_linenumber", "l_extendedprice", x.alias("converted"))


def strict_numbers(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 5 == 1, " ").otherwise(F.col("o_totalprice").cast("string"))
    o = o.select("o_orderkey", raw.alias("raw"))
    bad = F.when(numbers.not_a_number(F.col("raw")), 1).otherwise(0)
    return o.select("o_orderkey", numbers.strict_number(F.col("raw")).alias("x"), bad.alias("bad"))


QUERIES = {
    "assign_column": (assign, "SELECT c_custkey, c_name AS subject_name FROM customer"),
    "constant_column": (constant, "SELECT c_custkey, 'DM' AS domain FROM customer"),
    "constant_from_codelist": (codelist_constant, "SELECT o_orderkey, 'YEARS' AS unit FROM orders"),
    "conditions": (five_conditions, f"""
      SELECT o_orderkey, CASE WHEN s = 'F' THEN 1 ELSE 0 END AS is_equal, CASE WHEN s <> 'F' THEN 1 ELSE 0 END AS is_other,
        CASE WHEN s IN ('O', 'P') THEN 1 ELSE 0 END AS is_in, CASE WHEN s IS NULL OR trim(s) = '' THEN 1 ELSE 0 END AS is_missing,
        CASE WHEN s IS NULL OR trim(s) = '' THEN 0 ELSE 1 END AS is_present
      FROM (SELECT o_orderkey, {STATUS_SQL} AS s FROM orders)"""),
    "conditional_assign": (conditional_value, f"""
      SELECT o_orderkey, CASE WHEN ({STATUS_SQL}) = 'F' THEN 'DONE' ELSE 'OPEN' END AS state FROM orders"""),
    "ongoing_flag": (ongoing, f"""
      SELECT o_orderkey, CASE WHEN s IS NULL OR trim(s) = '' OR o_orderpriority = '1-URGENT' THEN 'ONGOING' END AS flag
      FROM (SELECT o_orderkey, o_orderpriority, {STATUS_SQL} AS s FROM orders)"""),
    "conform": (conformed, """
      SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_returnflag,
        l_quantity, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem"""),
    "population_filter": (in_population, f"""
      WITH {ADSL_SQL} SELECT "USUBJID", "SITEID", "SAFFL" FROM adsl WHERE "SAFFL" = 'Y'"""),
    "drop_source": (without_source, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'c_acctbal' AS dropped FROM customer"),
    "combine_fields": (combined, """
      SELECT c_custkey, c_name || '-' || seg || '-' || c_custkey AS strict, concat_ws('-', c_name, seg, c_custkey) AS skipping,
        'S1' || '-' || seg AS subject_id
      FROM (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer)"""),
    "extract_part": (delimited_part, """
      SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS second,
        string_split(p_name, ' ')[3] AS third, string_split(p_brand, '#')[2] AS brand_no FROM part"""),
    "normalize_case": (letter_case, "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part"),
    "coalesce_fields": (first_present, f"""
      SELECT o_orderkey, CASE WHEN s IS NULL OR trim(s) = '' THEN o_orderpriority ELSE s END AS value
      FROM (SELECT o_orderkey, o_orderpriority, {STATUS_SQL} AS s FROM orders)"""),
    "coalesce_conflicts": (disagreements, f"""
      SELECT count(*) FILTER (WHERE s <> o_orderstatus) AS same_field, count(*) FILTER (WHERE s <> 'F') AS other_field
      FROM (SELECT o_orderstatus, {STATUS_SQL} AS s FROM orders)"""),
    "unit_alias": (normalised_unit, """
      SELECT p_partkey, raw_unit, CASE raw_unit WHEN 'lbs' THEN 'LB' WHEN 'inches' THEN 'in' WHEN 'degF' THEN 'F' ELSE raw_unit END AS unit
      FROM (SELECT p_partkey, ['lbs', 'inches', 'cm', 'degF', 'furlong'][p_partkey % 5 + 1] AS raw_unit FROM part)"""),
    "slug_and_norm_name": (slugs, """
      SELECT p_partkey, substr('d_' || trim(lower(regexp_replace(n, '[^A-Za-z0-9]+', '_', 'g')), '_'), 1, 48) AS slug,
        upper(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) AS norm
      FROM (SELECT p_partkey, '# ' || p_size || ' ' || p_name || ' ' || p_brand || ' --' AS n FROM part)"""),
    "secret_scan": (secret_texts, r"""
      SELECT doc_id, source FROM documents WHERE regexp_matches(text,
        '(sk-[A-Za-z0-9_-]{16,}|api[_-]?key\s*[:=]\s*[''"]?[A-Za-z0-9_-]{16,})', 'i')
        OR regexp_matches(text, 'token\s*[:=]\s*[''"]?[A-Za-z0-9_-]{16,}', 'i')"""),
    "redact": (redacted, """
      SELECT doc_id, length(t) AS n_clean, md5(t) AS digest FROM (SELECT doc_id,
        replace(replace(replace(text, 'token', '[REDACTED]'), 'The', '[REDACTED]'), 'the', '[REDACTED]') AS t FROM documents)"""),
    "count_percent": (shares, """
      SELECT l_suppkey, CASE WHEN d = 0 THEN printf('%d (NA)', n) ELSE printf('%d (%.1f%%)', n, 100.0::DOUBLE * n / d) END AS share
      FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE count(*) END AS d,
        count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY l_suppkey)"""),
    "one_decimal_text": (fixed_text, """
      SELECT l_orderkey, l_linenumber, l_extendedprice, printf('%.1f', l_extendedprice * l_discount - l_tax * 1000) AS shown FROM lineitem"""),
    "complete_dates": (us_dates, """
      SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dtc FROM orders"""),
    "day_first_dates": (day_first_dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dtc FROM orders"),
    "unreadable_dates": (unreadable_dates, f"""
      WITH {MASKED_SQL} SELECT count(*) FILTER (WHERE raw IS NOT NULL AND (raw LIKE '%UNK%' OR raw = '')) AS bad FROM masked"""),
    "datetimes": (datetimes, """
      SELECT event_id, CASE WHEN event_id % 3 = 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS dtc FROM events"""),
    "one_column_datetimes": (one_column_datetimes, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS dtc FROM events"),
    "partial_dates": (partial_dates, f"WITH {PARTIAL_SQL} SELECT o_orderkey, dtc FROM partial"),
    "partial_to_date": (partial_to_date, f"""
      WITH {PARTIAL_SQL} SELECT o_orderkey, CASE WHEN length(dtc) = 10 THEN 1 ELSE 0 END AS complete,
        CASE WHEN length(dtc) = 10 THEN dtc END AS day FROM partial"""),
    "study_day": (study_days, """
      SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate)
        + CASE WHEN l_shipdate >= o_orderdate THEN 1 ELSE 0 END AS study_day
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
    "duration_and_population_flags": (durations, f"""
      WITH {ADSL_SQL} SELECT "USUBJID", CAST("TRTDURD" AS BIGINT) AS days, "ITTFL", "SAFFL" FROM adsl"""),
    "iso_validity": (valid_iso, "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN 1 ELSE 0 END AS valid FROM orders"),
    "linear_conversion": (linear, """
      SELECT l_orderkey, l_linenumber, l_extendedprice,
        CASE WHEN x - floor(x * 10) / 10 < ceil(x * 10) / 10 - x
               OR (x - floor(x * 10) / 10 = ceil(x * 10) / 10 - x AND CAST(floor(x * 10) AS BIGINT) % 2 = 0)
             THEN floor(x * 10) / 10 ELSE ceil(x * 10) / 10 END AS converted
      FROM (SELECT *, l_extendedprice * 0.45359237::DOUBLE + (-17.5)::DOUBLE AS x FROM lineitem)"""),
    "strict_numbers": (strict_numbers, """
      SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END AS x, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS bad
      FROM orders"""),
}
