"""Joins, running totals and flags against brute force, with one key that owns a third of the rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import aggregates, joins, windows
from cohortloom.operators.checks import Watch
from cohortloom.operators.skew import flag_first, key_join, running_total
from cohortloom.session import held, materialised


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 31 == 0 else f"k{rng.randrange(200)}")
        out.append((i, key, None if i % 17 == 0 else rng.randrange(50), rng.randrange(1, 9)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, x int, w int").repartition(5)


@pytest.mark.parametrize("cuts", [1, 4, 60])
def test_row_numbers(spark, df, rows, cuts):
    groups = defaultdict(list)
    for i, key, x, _ in rows:
        groups[key].append((x is None, x or 0, i))
    expected = {i: n for g in groups.values() for n, (_, _, i) in enumerate(sorted(g), start=1)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cuts)
    found = running_total(df, ["key"], ["x", "id"], "n")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["id"]: r["n"] for r in found.collect()} == expected


def test_no_job_runs_while_a_plan_is_built(spark, df):
    rows = held(df)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plans only")
    running_total(rows, ["key"], ["x", "id"], "n")
    flag_first(rows, {"a": ["key"]}, F.col("x") > 10, ["x"], ["id"])
    windows.duplicate_rows(rows, ["key"])
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("other", "")


def test_what_comes_before_runs_once(spark, df):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    slow = df.withColumn("x", counted("x"))
    running_total(slow, ["key"], ["x", "id"], "n").count()
    assert seen.value == 3000
    flag_first(slow, {"a": ["key"], "b": ["key", "w"]}, F.col("x") > 10, ["x"], ["id"]).count()
    assert seen.value == 6000


def test_two_shuffles_of_flagged_rows_and_two_scans(spark, df):
    flagged = flag_first(held(df), {"a": ["key"], "b": ["key", "w"]}, F.col("x") > 10, ["x"], ["id"])
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("cuts", [2, 16])
def test_tied_keys_are_cut_too(spark, cuts):
    rows = [("hot", 1, i) for i in range(2000)] + [(f"k{i}", i % 3, i) for i in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cuts)
    own = held(spark.createDataFrame(rows, "k string, x int, i int").repartition(3))
    found = running_total(own, ["k"], ["x"], "n")
    pieces = found.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    got = found.collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r["n"] for r in got if r["k"] == "hot") == list(range(1, 2001))
    assert all(r["n"] == 1 for r in got if r["k"] != "hot") and (cuts == 2 or pieces > 1)


def test_one_flag_where_the_row_key_repeats(spark):
    rows = [("s", 1, 5, "x")] * 3 + [("s", 1, 5, "y"), ("t", 1, 2, "x"), ("t", 1, 2, "x")]
    found = flag_first(spark.createDataFrame(rows, "k string, id int, x int, v string"), {"a": ["k"], "b": ["k", "v"]}, F.lit(True), ["x"], ["id"])
    got = Counter((r.k, r.v) for r in found.collect() if r.b == "Y")
    assert got == {("s", "x"): 1, ("s", "y"): 1, ("t", "x"): 1}
    assert Counter(r.k for r in found.collect() if r.a == "Y") == {"s": 1, "t": 1} and found.count() == len(rows)


def test_running_sum(df, rows):
    groups = defaultdict(list)
    for i, key, _, w in rows:
        groups[key].append((i, w))
    expected = {}
    for g in groups.values():
        total = 0
        for i, w in sorted(g):
            total += w
            expected[i] = total
    found = running_total(df, ["key"], ["id"], "s", weight="w")
    assert {r["id"]: r["s"] for r in found.collect()} == expected


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_key_join(spark, df, rows, how, null_safe):
    right = [("hot", 1), (None, 2), *[(f"k{i}", i) for i in range(0, 200, 2)]]
    values = dict(right) if null_safe else {k: v for k, v in right if k is not None}
    r = spark.createDataFrame(right, "k string, v int")
    found = key_join(df.select("id", "key"), r, {"key": "k"}, how, null_safe)
    got = sorted(tuple(x) for x in found.collect())if how in ("left_semi", "left_anti") else {x["id"]: x["v"] for x in found.collect()}
    if how == "left":
        assert got == {i: values.get(k) for i, k, _, _ in rows}
    elif how == "inner":
        assert got == {i: values[k] for i, k, _, _ in rows if k in values}
    else:
        keep = how == "left_semi"
        assert {g[0] for g in got} == {i for i, k, _, _ in rows if (k in values) == keep} and len(got) == len({g[0] for g in got})


@pytest.mark.parametrize("last", [False, True])
def test_flags(df, rows, last):
    found = flag_first(
        df, {"a": ["key"], "b": ["key", "w"]}, F.col("x") > 10, ["x"], ["id"], last=last
    ).collect()
    assert len(found) == len(rows)
    for flag, group in (("a", lambda r: r[1]), ("b", lambda r: (r[1], r[3]))):
        best = {}
        for r in rows:
            if r[2] is not None and r[2] > 10:
                key = (r[2], r[0])
                g = group(r)
                if g not in best or (key > best[g] if last else key < best[g]):
                    best[g] = key
        assert {r["id"] for r in found if r[flag] == "Y"} == {i for _, i in best.values()}
        assert {r[flag] for r in found} == {"Y", None}


def test_duplicates_of_one_copied_row(spark):
    copies = spark.createDataFrame([("a", 1)] * 500 + [("b", i) for i in range(100)] + [(None, 2)] * 3, "k string, v int")
    found = windows.duplicate_rows(copies, ["k", "v"]).groupBy("k", "v").count().collect()
    assert {(r["k"], r["v"]): r["count"] for r in found} == {("a", 1): 500, (None, 2): 3}


def test_sequence_of_a_copied_row_stays_dense(spark):
    copies = spark.createDataFrame([("a", 1)] * 300, "k string, v int")
    found = running_total(copies, ["k"], ["v"], "n")
    assert sorted(r["n"] for r in found.collect()) == list(range(1, 301))


def test_exact_median(spark):
    rng = random.Random(3)
    values = {"a": [rng.randrange(1000) / 8 for _ in range(501)], "b": [rng.random() for _ in range(600)], "c": [2.5], "d": []}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("d", None)], "g string, v double")
    found = {r["g"]: r["median"] for r in aggregates.exact_median(df, "v", "g", ["a", "b", "c", "d"]).collect()}

    def median(vs):
        vs = sorted(vs)
        return (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2

    assert found == {g: median(vs) for g, vs in values.items() if vs}


def test_offenders_are_one_issue_and_all_keys(spark):
    from cohortloom.operators import rules

    keys = [f"{i:05d}" for i in range(2500)]
    df = spark.createDataFrame([(k,) for k in keys * 2], "k string")
    found = aggregates.offender_keys(df, "k").orderBy("ordinal").collect()
    assert [r["offender"] for r in found] == keys and [r["ordinal"] for r in found] == list(range(1, 2501))
    issues = rules.listed_issues(df, "k", "R1", "D", "V", "Broken.").collect()
    assert [r["actual_value"] for r in issues] == ["2500"]
    assert rules.listed_issues(df.limit(0), "k", "R1", "D", "V", "Broken.").collect() == []


def test_guarded_join(spark):
    from cohortloom.errors import ContractError

    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "w")], "k int, r string")
    unique = right.filter("k < 3")
    joined = joins.guarded_left_join(left, unique, {"k": "k"}, "many-to-one", ["r"])
    assert sorted(tuple(r) for r in joined.collect()) == [(1, "a", "x"), (2, "b", "y"), (2, "c", "y")]
    for relation, l, r in [("many-to-one", left, right), ("one-to-one", left, unique), ("sideways", left, unique)]:
        with pytest.raises(ContractError):
            joins.guarded_left_join(l, r, {"k": "k"}, relation, ["r"])
    # repeated right keys that no left row has do no harm here
    joined = joins.guarded_left_join(left, right, {"k": "k"}, "many-to-many", ["r"])
    assert joined.count() == 3
    with pytest.raises(ContractError):
        joins.guarded_left_join(left.withColumn("k", F.lit(3)), right, {"k": "k"}, "many-to-many", ["r"])
    with pytest.raises(ContractError):
        joins.guarded_left_join(left, unique, {"k": "k"}, "one-to-many", ["r"])


PER_UNIT = [("A", "kg", "g", 1000.0, 0.0, 0), ("B", "kg", "g", 10.0, 1.0, 0)]


def _measures(spark, n=600):
    code = F.when(F.col("id") % 3 == 0, "A").otherwise("B")
    return spark.range(0, n, 1, 3).select("id", code.alias("code"), F.lit("kilo").alias("unit"), F.col("id").cast("string").alias("value"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_are_converted_where_the_rows_are(spark):
    done = joins.convert_units(_measures(spark), "value", "unit", "code", "g", PER_UNIT, {"kilo": "kg"}, "x")
    assert "hashpartitioning" not in _plan(done)
    assert {r["id"]: r["x"] for r in done.collect()} == {i: float(i * 1000 if i % 3 == 0 else i * 10 + 1) for i in range(600)}


def test_watched_lookups_are_found_where_the_rows_are(spark):
    watch = Watch()
    done = joins.convert_units(_measures(spark), "value", "unit", "code", "g", PER_UNIT, {"kilo": "kg"}, "x", watch=watch)
    done = joins.map_terms(done, "code", "term", "SEXES", {"SEXES": {"A": "first", "B": "second"}}, watch=watch)
    assert "hashpartitioning" not in _plan(done)
    written = materialised(done, "watched-lookups", watch)
    assert {(r["code"], r["term"]) for r in written.collect()} == {("A", "first"), ("B", "second")}


def test_only_rows_of_groups_that_hold_a_cut_look_for_their_piece(spark):
    """500 groups of 3 rows and 4 cuts: at most 4 groups are joined to the rows as cut; the numbers are right all the same."""
    df = held(spark.range(0, 1500, 1, 3).selectExpr("id % 500 as key", "id", "if(id % 500 = 7, null, id % 2) as part"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    numbered = running_total(df, ["key", "part"], ["id"], "n")
    whole = running_total(df, [], ["id"], "n")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "__cut#" in numbered._jdf.queryExecution().optimizedPlan().toString()
    groups = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        groups[(r["key"], r["part"])].append(r["id"])
    assert {r["id"]: r["n"] for r in numbered.collect()} == {i: n for g in groups.values() for n, i in enumerate(g, start=1)}
    assert {r["id"]: r["n"] for r in whole.collect()} == {i: i + 1 for i in range(1500)}
