"""Checks and counts that ride on the one write of a table, held tables, and comparisons in order."""

import pytest
from pyspark.sql import functions as F

from cohortloom.errors import ContractError, DataViolation
from cohortloom.operators import joins, reshape, rules, schema
from cohortloom.operators.aggregates import denominators
from cohortloom.operators.checks import Check, Watch
from cohortloom.plans.example_mapping import DOMAIN_SOURCES, example_tasks
from cohortloom.plans.mapping import draft_domain
from cohortloom.session import ROW_ID, held, materialised
from cohortloom.specs import TableSpec, Variable
from cohortloom.sources.csv_files import check_csv, header_report, read_literal, refused_lines
from tests.study_fixture import write_raw


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    return n, out


def test_counts_and_examples_after_the_write(spark):
    df = spark.createDataFrame([(i, f"v{i % 40}") for i in range(1000)], "i int, v string").repartition(4)
    watch = Watch()
    n, watched = jobs_of(spark, "attach", lambda: watch.on(df, [
        Check("odd", F.col("i") % 2 == 1, F.col("v")), Check("none", F.col("i") < 0, F.col("v"))], {"all": None, "low": F.col("i") < 10}))
    assert n == 0
    with pytest.raises(DataViolation) as caught:
        materialised(watched, "watched", watch)
    assert caught.value.counts == {"odd": 500} and 1 <= len(caught.value.examples["odd"]) <= 5
    assert watch.counts == {"all": 1000, "low": 10}


def test_an_empty_table_settles(spark):
    df = spark.createDataFrame([], "k int, v string").repartition(3, "k")
    watch = Watch()
    watched = watch.on(df, [Check("any", F.lit(True), F.col("v"))], {"all": None})
    assert materialised(watched.groupBy("k").count(), "watched", watch).count() == 0
    assert watch.counts == {"all": 0}


def test_settling_needs_a_write():
    with pytest.raises(RuntimeError):
        Watch().settle()


def test_the_same_violations_with_and_without_a_watch(spark):
    df = spark.createDataFrame([("Female",), ("Woman",), ("Woman",), (None,)], "x string")
    with pytest.raises(DataViolation) as now:
        joins.map_terms(df, "x", "s", "SEX")
    watch = Watch()
    with pytest.raises(DataViolation) as later:
        materialised(joins.map_terms(df, "x", "s", "SEX", watch=watch), "t", watch)
    assert now.value.counts == later.value.counts == {"s": 2} and later.value.examples == {"s": ["Woman"]}
    spec = TableSpec("T", "T", ("a",), (Variable("a", "A", "numeric"),))
    text = spark.createDataFrame([("1",), ("x",), ("",)], "a string")
    watch = Watch()
    with pytest.raises(DataViolation) as later:
        materialised(schema.conform(text, spec, watch=watch), "t", watch)
    assert later.value.counts == {"T.a": 1}


@pytest.mark.parametrize(("relation", "left", "right", "fails"), [
    ("many-to-one", [(1,), (1,), (3,), (None,)], [(1, "a"), (2, "b")], False),
    ("many-to-one", [(1,)], [(2, "a"), (2, "b")], True),
    ("one-to-one", [(1,), (2,)], [(1, "a"), (2, "b")], False),
    ("one-to-one", [(1,), (1,)], [(1, "a")], True),
    ("many-to-many", [(1,), (1,)], [(1, "a"), (2, "b"), (2, "c")], False),
    ("many-to-many", [(2,)], [(2, "b"), (2, "c")], True),
    ("one-to-many", [(1,), (5,), (5,)], [(1, "a"), (2, "b"), (2, "c")], False),
    ("one-to-many", [(1,), (1,)], [(1, "a")], True),
    ("one-to-many", [(2,)], [(2, "a"), (2, "b")], True),
])
def test_watched_joins_refuse_what_the_others_refuse(spark, relation, left, right, fails):
    a = spark.createDataFrame([(k[0], i) for i, k in enumerate(left)], "k int, i int")
    b = spark.createDataFrame(right, "r int, `v.1` string")
    watch = Watch()
    joined = joins.guarded_left_join(a, b, {"k": "r"}, relation, ["v.1"], watch)
    if fails:
        with pytest.raises(ContractError):
            materialised(joined, "j", watch)
        with pytest.raises(ContractError):
            joins.guarded_left_join(a, b, {"k": "r"}, relation, ["v.1"])
    else:
        found = sorted(tuple(r) for r in materialised(joined, "j", watch).select("i", "`v.1`").collect())
        assert found == [(i, dict(right).get(k[0])) for i, k in enumerate(left)]


def test_unregistered_group_rides_along(spark):
    people = spark.createDataFrame([("a", "1"), ("z", "2")], "g string, s string")
    watch = Watch()
    with pytest.raises(ContractError, match="z"):
        materialised(denominators(people, "g", "s", ["a"], watch=watch), "d", watch)


def test_a_study_is_drafted_without_a_job_and_reads_each_source_once(spark, tmp_path):
    sources = {name: materialised(read_literal(spark, path), name) for name, path in write_raw(tmp_path).items()}

    def drafted():
        dm = draft_domain("DM", example_tasks(), sources, DOMAIN_SOURCES["DM"])
        vs = draft_domain("VS", example_tasks(), sources, DOMAIN_SOURCES["VS"], dm.finish(dm.rows))
        vs.watch.include(dm.watch)
        return vs

    n, draft = jobs_of(spark, "draft", drafted)
    assert n == 0
    plan = draft.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # one of each source
    table = draft.write()
    counts = draft.counted()
    assert counts["VS_HEIGHT/transpose_findings"] == 6 and counts["VS_TEMP/standardize_unit"] == 12
    assert counts["VS_VSSEQ/derive_sequence"] == 60 and counts["VS_STUDYID/assign_no_ct"] == 12 and table.count() == 60


def test_held_rows_keep_their_numbers(spark):
    rows = held(spark.range(1000).repartition(7))
    first = {r["id"]: r[ROW_ID] for r in rows.collect()}
    assert len(set(first.values())) == 1000 and {r["id"]: r[ROW_ID] for r in rows.repartition(3).collect()} == first
    assert held(rows) is rows


def test_rows_that_changed_places_differ(spark):
    a = spark.createDataFrame([(i, f"n{i % 7}") for i in range(500)], "i int, n string").repartition(5).orderBy("i")
    b = a.orderBy(F.when(F.col("i") == 3, 400).when(F.col("i") == 400, 3).otherwise(F.col("i")))
    assert reshape.same_content(a, b) and not reshape.same_content(a, b, ordered=True) and reshape.same_content(a, a, ordered=True)
    found = sorted((r["place"], r["i"], r["surplus"]) for r in reshape.ordered_difference(a, b).collect())
    assert found == [(4, "3", 1), (4, "400", -1), (401, "3", -1), (401, "400", 1)]
    assert rules.stored_table_issue(b, a, "T", ordered=True).count() == 1 and rules.stored_table_issue(b, a, "T").count() == 0


def test_gates_as_rows(spark):
    from cohortloom.errors import GateClosed

    issues = spark.createDataFrame([("ERROR",), ("WARNING",)], "severity string")
    assert tuple(rules.gate_outcome(issues, "s").first()) == ("s", 1, 1, "closed")
    assert tuple(rules.gate_outcome(issues.where("severity = 'WARNING'"), "s").first()) == ("s", 0, 1, "open")
    assert tuple(rules.gate_outcome(issues.limit(0), "s").first()) == ("s", 0, 0, "open")
    with pytest.raises(GateClosed):
        rules.gate(issues, "s")


def test_refused_lines_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,"B c"\n1,x\n2,"y, ""q"""\n\n')
    (tmp_path / "b.csv").write_text('A,"B c"\n1\n2,x,z\n3,"open\n4,fine\n')
    (tmp_path / "c.csv").write_text("﻿A,C\n5,x\n")
    (tmp_path / "d.csv").write_text("A\n")
    (tmp_path / "e.csv").write_text("")
    names = ["A", "B c"]
    found = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["text"], r["reason"]) for r in refused_lines(spark, str(tmp_path), names).collect())
    assert found == [("b.csv", 2, "1", "1 fields, the header names 2"), ("b.csv", 3, "2,x,z", "3 fields, the header names 2"), ("b.csv", 4, '3,"open', "a quote is not closed")]
    heads = {r["file"].rsplit("/", 1)[-1]: r["difference"] for r in header_report(spark, str(tmp_path), names).collect()}
    assert heads == {"a.csv": None, "b.csv": None, "c.csv": "column 2: C in place of B c", "d.csv": "column 2: B c is missing"}
    with pytest.raises(ContractError, match="b.csv line 2"):
        check_csv(spark, str(tmp_path / "b.csv"))


def test_a_codelist_of_any_length_leaves_the_plan_as_it_is(spark, monkeypatch):
    from cohortloom import specs
    from cohortloom.plans import mapping
    from cohortloom.specs import Task

    def plan(n):
        monkeypatch.setitem(specs.CODELISTS, "LONG", {f"raw {i}": f"term {i}" for i in range(n)})
        source = spark.createDataFrame([(f"raw {i}", i) for i in (0, n - 1)], "a string, _source_row int")
        task = Task("T", "DM", "assign_ct", ("SEX",), ("a",), {"codelist_id": "LONG"})
        found = mapping._with_lookups(source, [task])
        value, checks = mapping._term(task)
        assert sorted(r[0] for r in found.select(value).collect()) == sorted(f"term {i}" for i in (0, n - 1))
        return len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan(3) == plan(100_000)
