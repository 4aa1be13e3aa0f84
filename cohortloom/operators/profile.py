"""Source profiling: column statistics, date formats, candidate keys, table relationships."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.conditions import is_blank
from cohortloom.functions.dates import PARTIAL_TOKEN
from cohortloom.functions.text import IDENTIFIER_ROLES, compact, field_label, field_role

ROW = "_source_row"  # row number of read sources, not a column of the data
IDENTIFIER_LIKE = re.compile(
    r"(^|_)(study|studyid|subject|subjid|usubjid|patnum|patient|site|siteid|id|seq)(_|$)"
)
SUBJECT_LIKE = re.compile("PATNUM|SUBJID|USUBJID|SUBJECT|PATIENT", re.IGNORECASE)
PAIR_FIELDS = 8  # identifier-like columns that are tried in pairs
JOIN_FIELDS = 4
EXAMPLES = 5
SHOWN = 121  # one more than a report shows, so that a cut is seen
SKETCH_BITS = 12  # registers of a sketch, as a power of two: a standard error of 1.6 percent
EARLY = 32  # hash classes of which a sketch keeps the first value, by two parts of the hash, to choose examples from
PROOF_ROWS = 4096  # rows of a partition among which a repeat is looked for first


def identifier_like(name: str) -> bool:
    return IDENTIFIER_LIKE.search(name.lower()) is not None


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _unfolded(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """All columns as (column number, text), in one scan."""
    cells = [F.struct(F.lit(i).alias("place"), _text(c).alias("value")) for i, c in enumerate(columns)]
    return df.select(*extra, F.inline(F.array(*cells)))


def _shuffled(value: Column) -> tuple[Column, Column]:
    """What stands for a value in a shuffle: the text itself, or its start and a digest of the whole.

    Reports show no more than ``SHOWN`` characters, so long texts need not travel.
    """
    return F.substring(value, 1, SHOWN), F.when(F.length(value) > SHOWN, F.sha2(value, 256))


# What a date or time of each format looks like.
FORMAT_SHAPES = {
    "slash": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "named_month": r"(?i)^(UNK|UN|\d{1,2})-[A-Z]{3}-(UNK|UN|\d{4})$",
    "iso": r"^\d{4}-\d{2}-\d{2}",
    "to_second": r"^\d{1,2}:\d{2}:\d{2}$",
    "to_minute": r"^\d{1,2}:\d{2}$",
}
FLAGS = [*FORMAT_SHAPES, "late_first", "late_second"]


def _flags(value: Column) -> dict[str, Column]:
    """Which shapes a whole text has; of a slash date also whether its first or second part passes 12."""
    out = {name: F.coalesce(value.rlike(shape), F.lit(False)) for name, shape in FORMAT_SHAPES.items()}
    pieces = F.split(value, "/")
    for i, name in enumerate(("late_first", "late_second")):
        out[name] = out["slash"] & F.coalesce(F.get(pieces, F.lit(i)).try_cast("int") > 12, F.lit(False))
    return out


def _format_list(seen: Mapping[str, Column]) -> Column:
    """Date and time formats of a column, from what its values were seen to have (see ``_flags``)."""
    slash_format = F.when(
        seen["slash"],
        F.when(seen["late_first"] & seen["late_second"], "mixed_m/d/y_and_d/m/y")
        .when(seen["late_first"], "d-m-y")
        .when(seen["late_second"], "m/d/y")
        .otherwise("m/d/y_or_d/m/y"),
    )
    return F.array_join(F.array_compact(F.array(
        slash_format,
        F.when(seen["named_month"], F.lit("dd-mmm-yyyy")),
        F.when(seen["iso"], F.lit("y-m-d")),
        F.when(seen["to_second"], F.lit("H:M:S")).when(seen["to_minute"], F.lit("H:M")),
    )), " | ")


def _any(name: str) -> Column:
    return F.coalesce(F.bool_or(name), F.lit(False))


def infer_date_formats(df: DataFrame, column: str) -> DataFrame:
    """One row with the formats found in a text column."""
    flagged = df.select(*[c.alias(n) for n, c in _flags(_text(column)).items()])
    return flagged.agg(_format_list({n: _any(n) for n in FLAGS}).alias("formats"))


def _tokens(value: Column) -> Column:
    """Spellings of the unknown-part tokens in a whole text."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(PARTIAL_TOKEN), F.lit(0)))


def _joined_tokens(sets: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets)))), " | ")


def profile(
    df: DataFrame,
    dataset: str,
    order_by: str | None = None,
    labels: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
    grain: str = "unknown",
) -> DataFrame:
    """One row per column: type, label, missing rate, distinct count, first examples, formats, role. All figures are exact.

    The table is unfolded and reduced to one row per (column, value); formats and tokens are looked for in whole texts
    before that. The first five distinct values per column are picked in ``order_by`` order (read order by
    default); the limit applies in every task before the shuffle. ``sketches`` give estimated distinct counts for
    tables whose distinct values are too many to shuffle, or that grow file by file.
    """
    columns = [c for c in df.columns if c != ROW]
    position = (F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id()).alias("position")
    long = _unfolded(df, columns, [position])
    shown, digest = _shuffled(F.col("value"))
    found = _flags(F.col("value"))
    # the tokens are spellings of two words, so their set has a fixed size
    marked = long.withColumns({**found, "tokens": F.when(F.col("value").rlike(PARTIAL_TOKEN), _tokens(F.col("value")))})
    values = marked.groupBy("place", shown.alias("value"), digest.alias("digest")).agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("n"),
        *[_any(n).alias(n) for n in FLAGS], F.flatten(F.collect_set("tokens")).alias("tokens"),
    )
    known = F.col("value").isNotNull()
    stats = values.groupBy("place").agg(
        F.sum("n").alias("record_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("unique_count"),
        _format_list({n: _any(n) for n in FLAGS}).alias("format_candidates"),
        _joined_tokens(F.when(F.size("tokens") > 0, F.col("tokens"))).alias("partial_tokens"),
    )
    order = Window.partitionBy("place").orderBy("position", "value")
    first = values.filter(known).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= EXAMPLES)
    picked = [F.max(F.when(F.col("rank") == r, F.col("value"))) for r in range(1, EXAMPLES + 1)]
    examples = first.groupBy("place").agg(compact(F.array_compact(F.array(*picked))).alias("example_values"))

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = F.array(*[F.lit(c) for c in columns])
    kinds = F.array(*[F.lit(types[c]) for c in columns])
    # one row per column of the table on each side
    both = stats.join(F.broadcast(examples), "place", "left")
    return _report(both.withColumns({"variable": names[F.col("place")], "data_type": kinds[F.col("place")]}), dataset, labels, keys, grain)


def _report(figures: DataFrame, dataset: str, labels: Mapping[str, str] | None, keys: Sequence[str], grain: str) -> DataFrame:
    variable = F.col("variable")
    role = field_role(variable)
    return figures.select(
        F.lit(dataset).alias("source_dataset"),
        variable.alias("source_variable"),
        field_label(variable, labels).alias("label"),
        "data_type",
        F.coalesce("example_values", F.lit("")).alias("example_values"),
        (role.isin(IDENTIFIER_ROLES) | variable.isin(list(keys))).alias("is_identifier"),
        (F.col("n_missing") / F.col("record_count")).alias("missing_rate"),
        "unique_count",
        F.lit(grain).alias("grain"),
        F.lit(" | ".join(keys)).alias("keys"),
        role.alias("concept_roles"),
        "format_candidates",
        F.coalesce("partial_tokens", F.lit("")).alias("partial_tokens"),
        "record_count",
    )


def sketches(df: DataFrame, file: Column | None = None, order_by: str | None = None) -> DataFrame:
    """One row per column and file (one file by default) that can be merged with those of other files: counts, formats, tokens,
    a sketch of the distinct values, and early values to choose examples from.

    Every figure is a partial aggregate of fixed size, so only one row per column and task is shuffled, however many distinct
    values there are. Store the rows as a table; rows of new files are appended, and ``profile_of`` reads them all.
    """
    columns = [c for c in df.columns if c != ROW]
    position = (F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id()).alias("position")
    long = _unfolded(df, columns, [position, (F.lit("") if file is None else file).alias("file")])
    value = F.col("value")
    shown, _ = _shuffled(value)
    parts = {"low": F.pmod(F.xxhash64(value), F.lit(EARLY)), "high": F.pmod(F.shiftright(F.xxhash64(value), 32), F.lit(EARLY))}
    early = F.struct("position", shown.alias("value"))
    marked = long.withColumns({**_flags(value), "tokens": F.when(value.rlike(PARTIAL_TOKEN), _tokens(value)), **parts})
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    grouped = marked.groupBy("file", "place").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(value.isNull()).alias("n_missing"),
        F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("distinct_sketch"),
        *[_any(n).alias(n) for n in FLAGS],
        F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"),
        # the first value of each hash class, of fixed number; a value is missed where earlier ones share both its classes
        F.array_distinct(F.array_compact(F.array(*[
            F.min(F.when(value.isNotNull() & (F.col(p) == k), early)) for p in parts for k in range(EARLY)]))).alias("early"),
    )
    return grouped.select(
        "file", F.array(*[F.lit(c) for c in columns])[F.col("place")].alias("variable"), F.col("place").alias("place"),
        F.array(*[F.lit(types[c]) for c in columns])[F.col("place")].alias("data_type"),
        "record_count", "n_missing", "distinct_sketch", *FLAGS, "tokens", F.transform(F.array_sort("early"), lambda e: e["value"]).alias("early"),
    )


def merge_sketches(rows: DataFrame) -> DataFrame:
    """Sketch rows of several files as one row per column. Merging is free of order: halves give what the whole gives."""
    values = F.array_sort(F.collect_list(F.struct("file", "early")))
    return rows.groupBy("variable").agg(
        F.min("place").alias("place"),
        F.max("data_type").alias("data_type"),
        F.sum("record_count").alias("record_count"),
        F.sum("n_missing").alias("n_missing"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        *[_any(n).alias(n) for n in FLAGS],
        F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"),
        F.array_distinct(F.flatten(F.transform(values, lambda v: v["early"]))).alias("early"),
    )


def profile_of(
    rows: DataFrame, dataset: str, labels: Mapping[str, str] | None = None, keys: Sequence[str] = (), grain: str = "unknown"
) -> DataFrame:
    """The profile that stored ``sketches`` add up to: as ``profile``, but ``unique_count`` is an estimate (standard error 1.6
    percent) and the examples are early values, not always the five first."""
    merged = merge_sketches(rows)
    figures = merged.select(
        "variable", "data_type", "record_count", "n_missing",
        F.hll_sketch_estimate("distinct_sketch").alias("unique_count"),
        _format_list({n: F.col(n) for n in FLAGS}).alias("format_candidates"),
        F.array_join(F.array_sort("tokens"), " | ").alias("partial_tokens"),
        compact(F.slice("early", 1, EXAMPLES)).alias("example_values"),
    )
    return _report(figures, dataset, labels, keys, grain)


def hide_identifiers(profiled: DataFrame) -> DataFrame:
    """Blank the example values of identifier columns and keys."""
    return profiled.withColumn("example_values", F.when(~F.col("is_identifier"), F.col("example_values")))


def candidate_key(df: DataFrame) -> list[str]:
    """The first complete and unique column, identifier-like names first; else the first such pair.

    A value that occurs twice anywhere proves that its columns are no key. A first pass looks for such proofs among the
    first rows of every partition, which refutes nearly every column that is no key without shuffling the table. What
    no proof was found against, single columns and pairs alike, is then counted exactly over all rows in one job.
    """
    columns = [c for c in df.columns if c != ROW]
    fields = [c for c in columns if identifier_like(c)][:PAIR_FIELDS]
    sets = [[c] for c in columns] + [list(p) for p in combinations(fields, 2)]
    refuted = _refuted(df, sets)
    unique = _unique_sets(df, [s for i, s in enumerate(sets) if i not in refuted])
    singles = [s[0] for s in unique if len(s) == 1]
    preferred = [c for c in singles if identifier_like(c)] or singles
    if preferred:
        return preferred[:1]
    pairs = [s for s in unique if len(s) == 2]
    return pairs[0] if pairs else []


def _set_values(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(place, blank, value): each row's value of each column set."""
    cells = []
    for i, s in enumerate(sets):
        blank = F.lit(False)
        for c in s:
            blank = blank | is_blank(_text(c))
        cells.append(F.struct(
            F.lit(i).alias("place"), blank.alias("blank"), F.array(*[F.struct(*_shuffled(F.trim(_text(c)))) for c in s]).alias("value")))
    return df.select(F.inline(F.array(*cells)))


def _refuted(df: DataFrame, sets: Sequence[Sequence[str]]) -> set[int]:
    """Numbers of the sets with a blank or repeated value among the first ``PROOF_ROWS`` rows of the partitions."""
    if not sets:
        return set()
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = df.where(row < PROOF_ROWS)
    seen = _set_values(first, sets).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"))
    return {r["place"] for r in seen.where("n > 1 or blank").select("place").distinct().collect()}


def _unique_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> list[Sequence[str]]:
    """Those column sets that are complete and have no value twice, all counted over all rows in one job."""
    if not sets:
        return []
    values = _set_values(df, sets).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"))
    bad = {r["place"] for r in values.groupBy("place").agg(F.max("n").alias("n"), F.bool_or("blank").alias("blank")).where("n > 1 or blank").collect()}
    return [s for i, s in enumerate(sets) if i not in bad]


def grain(keys: Sequence[str], one_row_per_subject: bool = False) -> str:
    if not keys:
        return "unknown"
    if one_row_per_subject and any(SUBJECT_LIKE.search(k) for k in keys):
        return "one_record_per_subject_description_supported"
    return "one_record_per_candidate_key" if len(keys) == 1 else "one_record_per_composite_candidate_key"


def join_fields(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> tuple[list[str], list[str]]:
    """Shared columns, and the ones to join by: shared keys, else shared identifier-like columns."""
    common = [c for c in left.columns if c in right.columns and c != ROW]
    shared_keys = [c for c in left_keys if c in right_keys and c in common]
    return common, (shared_keys or [c for c in common if identifier_like(c)])[:JOIN_FIELDS]


def relationship(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    names: tuple[str, str] = ("left", "right"),
    described: bool = False,
) -> DataFrame:
    """How two tables relate on their shared keys: cardinality and confidence, as one row."""
    common, join = join_fields(left, right, left_keys, right_keys)
    head = [F.lit(names[0]).alias("left_dataset"), F.lit(names[1]).alias("right_dataset"),
            F.lit(" | ".join(common)).alias("common_fields"), F.lit(" | ".join(join)).alias("candidate_keys")]
    if not join:
        confidence = "medium" if described else "low"
        one = left.sparkSession.range(1)
        return one.select(*head, F.lit("unknown").alias("relationship"), F.lit(confidence).alias("confidence"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        keyed = df.select(*[_text(c).alias(c) for c in join])
        grouped = keyed.groupBy(*[f"`{c}`" for c in join]).agg(F.count(F.lit(1)).alias("n"))
        blank = F.lit(False)
        for c in join:
            blank = blank | is_blank(F.col(f"`{c}`"))
        complete = F.coalesce(~F.bool_or(blank), F.lit(True))
        unique = complete & F.coalesce(F.max("n") <= 1, F.lit(True))
        return grouped.agg(F.lit(tag).alias("side"), complete.alias("complete"), unique.alias("is_unique"))

    both = side(left, "l").unionByName(side(right, "r"))

    def of(tag: str, column: str) -> Column:
        return F.bool_or((F.col("side") == tag) & F.col(column))

    left_unique, right_unique = of("l", "is_unique"), of("r", "is_unique")
    kind = (
        F.when(left_unique & right_unique, "one-to-one")
        .when(right_unique, "many-to-one")
        .when(left_unique, "one-to-many")
        .otherwise("many-to-many")
    )
    keyed = any(c in right_keys for c in left_keys)
    confidence = F.when(F.lit(keyed) & of("l", "complete") & of("r", "complete"), "high").otherwise("medium")
    return both.agg(kind.alias("relationship"), confidence.alias("confidence")).select(*head, "relationship", "confidence")
