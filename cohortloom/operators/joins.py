"""Joins with guards, code lookups, orphan search, name matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import specs
from cohortloom.errors import ContractError
from cohortloom.functions.conditions import is_blank
from cohortloom.functions.numbers import linear_convert, not_a_number, strict_number
from cohortloom.functions.text import norm_name, unit_alias
from cohortloom.operators import lookups
from cohortloom.operators.checks import Check, Watch, enforce, require_columns
from cohortloom.operators.skew import distinct_keys, key_join

RELATIONSHIPS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row carries, with the number of rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    found = repeated_keys(df, keys).limit(5).collect()
    if found:
        shown = "; ".join(" | ".join(str(row[k]) for k in keys) for row in found)
        raise ContractError(f"{what} is not unique by {', '.join(keys)}: {shown}")


def guarded_left_join(
    left: DataFrame,
    right: DataFrame,
    by: Mapping[str, str],
    relationship: str,
    select: Sequence[str],
    watch: Watch | None = None,
) -> DataFrame:
    """Left join that refuses to change the number of left rows.

    ``many-to-one`` and ``one-to-one`` need a right side that is unique by its keys; ``one-to-one``
    needs a unique left side too. The other two allow repeated keys as long as they meet nothing:
    a repeated right key that a left row has would multiply rows and is refused. With that checked,
    each left row meets at most one right row.

    Without a ``watch`` the keys are looked at now. With one, nothing runs now: the right side is reduced to one row a key
    with its number of rows (the join shuffles it by the key anyway), and the numbers are judged when the table is written.
    """
    if relationship not in RELATIONSHIPS:
        raise ContractError(f"unknown relationship {relationship!r}")
    require_columns(left, by.keys(), "left side")
    require_columns(right, [*by.values(), *select], "right side")
    left_keys, right_keys = list(by.keys()), list(by.values())
    pruned = right.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*right_keys, *select])])
    if watch is not None:
        return _watched_left_join(left, pruned, by, relationship, [c for c in pruned.columns if c not in right_keys], watch)
    if relationship in ("many-to-one", "one-to-one"):
        assert_unique(right, right_keys, "right side")
        if relationship == "one-to-one":
            assert_unique(left, left_keys, "left side")
    else:
        repeated = repeated_keys(right, right_keys).select(*right_keys)
        hit = key_join(left.select(*left_keys), repeated, by, "left_semi")
        if not hit.isEmpty():
            raise ContractError("the join would change the number of left rows")
        if relationship == "one-to-many":
            several = repeated_keys(left, left_keys)
            if not several.join(pruned.withColumnsRenamed({v: k for k, v in by.items()}), left_keys, "left_semi").isEmpty():
                raise ContractError("a right row meets more than one left row")
        # repeated right keys meet no left row: without them the result is the same
        pruned = key_join(pruned, repeated, right_keys, "left_anti", null_safe=True)
    return key_join(left, pruned, by, "left")


def _shown_keys(names: Sequence[str]) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("None")) for n in names])


def _watched_left_join(
    left: DataFrame, right: DataFrame, by: Mapping[str, str], relationship: str, select: Sequence[str], watch: Watch
) -> DataFrame:
    left_keys, right_keys = list(by.keys()), list(by.values())
    n, picked, met = "__n_right", "__picked", "__n_left"

    def unique(side: str) -> str:
        return f"{side} is not unique by {', '.join(right_keys if side == 'right side' else left_keys)}"

    one = right.groupBy(*[f"`{k}`" for k in right_keys]).agg(
        F.count(F.lit(1)).alias(n), F.first(F.struct(F.lit(0).alias("__any"), *[F.col(f"`{c}`") for c in select])).alias(picked))
    if relationship in ("many-to-one", "one-to-one"):
        one = watch.on(one, [Check("right side", F.col(n) > 1, _shown_keys(right_keys), unique("right side"))])
    if relationship == "one-to-one":
        # a left side that is unique is the same after it was reduced to one row a key
        own = left.groupBy(*[f"`{k}`" for k in left_keys]).agg(
            F.count(F.lit(1)).alias(met), F.first(F.struct(*[F.col(f"`{c}`") for c in left.columns])).alias("__row"))
        own = watch.on(own, [Check("left side", F.col(met) > 1, _shown_keys(left_keys), unique("left side"))])
        left = own.select("__row.*")
    if relationship == "one-to-many":
        # how many left rows each right row meets, counted before the join
        several = left.groupBy(*[f"`{k}`" for k in left_keys]).agg(F.count(F.lit(1)).alias(met))
        one = key_join(one, several, dict(zip(right_keys, left_keys, strict=True)), "left")
        one = watch.on(one, [Check("right rows", F.col(met) > 1, _shown_keys(right_keys), "a right row meets more than one left row")]).drop(met)
    joined = key_join(left, one, by, "left")
    if relationship in ("one-to-many", "many-to-many"):
        joined = watch.on(joined, [Check("left rows", F.col(n) > 1, _shown_keys(left_keys), "the join would change the number of left rows")])
    return joined.withColumns({c: F.col(f"{picked}.`{c}`") for c in select}).drop(n, picked)


def unmatched_terms(df: DataFrame, column: str, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct non-blank values that the codelist does not hold."""
    values = df.select(F.col(column).alias("value")).filter(~is_blank(F.col("value"))).distinct()
    known = lookups.as_table(df.sparkSession, [(r[0],) for r in rows], "value string")
    return values.join(known, "value", "left_anti")


def map_terms(
    df: DataFrame, column: str, target: str, codelist: str, codelists=specs.CODELISTS, check: bool = True, watch: Watch | None = None
) -> DataFrame:
    """Exact-match code lookup; a non-blank value without an entry is an error."""
    rows = lookups.codelist_rows(codelist, codelists)
    mapped = lookups.attach(df.drop(target) if target != column else df, rows, "__c string, __t string", {column: "__c"})
    if check:
        mapped = enforce(mapped, [Check(target, ~is_blank(F.col(column)) & F.col("__t").isNull(), F.col(column))], watch)
    return mapped.withColumn(target, F.col("__t")).drop("__t")


def visit_number(
    df: DataFrame, column: str, target: str, visit_map: str, visit_maps=specs.VISIT_MAPS, check: bool = True, watch: Watch | None = None
) -> DataFrame:
    rows = lookups.visit_rows(visit_map, visit_maps)
    mapped = lookups.attach(df, rows, "__v string, __n double", {column: "__v"})
    if check:
        mapped = enforce(mapped, [Check(target, F.col(column).isNotNull() & F.col("__n").isNull(), F.col(column))], watch)
    return mapped.withColumn(target, F.col("__n")).drop("__n")


def code_by_name_then_code(df: DataFrame, name: str, code: str, target: str, rows: Sequence[tuple]) -> DataFrame:
    """A number found by name, or by code where the name is not known. Rows are (name, code, number)."""
    by_name = [(r[0], float(r[2])) for r in rows]
    by_code = [(r[1], float(r[2])) for r in rows]
    found = lookups.attach(df, by_name, "__n string, __by_name double", {name: "__n"})
    found = lookups.attach(found, by_code, "__c string, __by_code double", {code: "__c"})
    return found.withColumn(target, F.coalesce("__by_name", "__by_code")).drop("__by_name", "__by_code")


def convert_units(
    df: DataFrame,
    value: str,
    unit: str,
    test: str,
    target_unit: Column | str,
    conversions: Sequence[tuple],
    aliases: Mapping[str, str] = specs.UNIT_ALIASES,
    result: str = "converted",
    check: bool = True,
    watch: Watch | None = None,
) -> DataFrame:
    """Linear conversion looked up by (test, unit, target unit); rows are
    (test, from unit, to unit, multiplier, offset, digits) and exactly one must apply.

    With a ``watch`` values that are no number or have no conversion are reported when the table is written, without a
    pass of their own."""
    target = F.lit(target_unit) if isinstance(target_unit, str) else target_unit
    keys = [tuple(r[:3]) for r in conversions]
    if len(set(keys)) != len(keys):
        raise ContractError("a conversion is registered twice")
    rows = [(r[0], r[1], r[2], float(r[3]), float(r[4]), int(r[5])) for r in conversions]
    keyed = df.withColumns({"__unit": unit_alias(F.col(unit), aliases), "__to": target, "__x": strict_number(F.col(value))})
    found = lookups.attach(
        keyed,
        rows,
        "__t string, __f string, __g string, __m double, __o double, __d int",
        {test: "__t", "__unit": "__f", "__to": "__g"},
    )
    if check:
        shown = F.concat_ws("/", test, unit, "__to", value)
        found = enforce(found, [
            Check("not_numeric", not_a_number(F.col(value)), shown),
            Check("not_registered", F.col("__m").isNull(), shown),
        ], watch)
    converted = linear_convert(F.col("__x"), F.col("__m"), F.col("__o"), F.col("__d"))
    return found.withColumn(result, converted).drop("__unit", "__to", "__x", "__m", "__o", "__d")


def add_subject_vars(
    events: DataFrame,
    subjects: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Copy subject-level columns onto events, under new names where given.

    ``subjects`` has one row per key (a rule checks that); a subject with very many events is spread.
    """
    pruned = subjects.select(*keys, *variables)
    return key_join(events, pruned, keys, "left").withColumnsRenamed(dict(renames or {}))


def orphans(
    child: DataFrame, parent: DataFrame, on: Mapping[str, str]
) -> DataFrame:
    """Child rows whose key the parent does not have."""
    return key_join(child, distinct_keys(parent, list(on.values())), on, "left_anti")


def missing_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child keys that the parent does not have; one row per key."""
    return orphans(distinct_keys(child, [key]), parent, {key: key})


def lineage_ids(lineage: DataFrame) -> DataFrame:
    """Mapping ids per (domain, variable) from rows with a list of targets."""
    exploded = lineage.select("target_domain", F.explode("target_variables").alias("variable"), "mapping_id")
    ids = F.array_join(F.array_sort(F.collect_set("mapping_id")), " | ")
    return exploded.groupBy("target_domain", "variable").agg(ids.alias("mapping_id"))


def name_similarity(wanted: Column, label: Column | None, candidate: Column) -> Column:
    """1, 0.99 or 0.97 for an exact, case-insensitive or normalised match, else edit similarity."""
    plain, other = norm_name(wanted), norm_name(candidate)
    scores = []
    for mine in [plain] if label is None else [plain, norm_name(label)]:
        longest = F.greatest(F.length(mine), F.length(other), F.lit(1))
        close = F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(mine, other) / longest)
        scores.append(F.when((mine != "") & (other != ""), close).otherwise(F.lit(0.0)))
    best = scores[0] if len(scores) == 1 else F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in scores])
    return (
        F.when(wanted == candidate, F.lit(1.0))
        .when(F.upper(wanted) == F.upper(candidate), F.lit(0.99))
        .when((plain != "") & (plain == other), F.lit(0.97))
        .otherwise(best)
    )


def match_names(df: DataFrame, wanted: str, available: Sequence[str], label: str | None = None, top: int = 3) -> DataFrame:
    """Best match and the ``top`` alternatives of each wanted name among the columns of a table.

    ``available`` is the column list of a schema, so it does not grow with the rows. It travels as a
    literal and each distinct wanted name is scored where it is: there is no join.
    """
    names = df.select(wanted, *([label] if label else [])).distinct()
    options = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(available)])
    scored = F.transform(
        options,
        lambda o: F.struct(
            (-name_similarity(F.col(wanted), F.col(label) if label else None, o["name"])).alias("minus"),
            o["place"].alias("place"),
            o["name"].alias("name"),
        ),
    )
    ranked = names.withColumn("__ranked", F.slice(F.array_sort(scored), 1, top))
    return ranked.select(
        wanted,
        F.col("__ranked")[0]["name"].alias("suggested"),
        F.round(-F.col("__ranked")[0]["minus"], 3).alias("score"),
        F.array_join(F.col("__ranked.name"), " | ").alias("alternatives"),
    )
