"""Joins, running totals and first-row flags with one plan, whatever the sizes of table and groups.

No plan depends on how many rows a key has. Joins are plain equi-joins: where one key owns a large share of the left
rows, Spark splits its partition (adaptive execution with ``spark.sql.adaptive.skewJoin.enabled``, both on by default).
Running totals and flags work on a held table (``session.held``): what comes before runs once, in the one write that
gives each row its number, and the passes after it read only the columns they need. A frame that has no row number yet
is held first. Running totals cut the space of all groups and order keys into pieces, so that a group may own any share
of the rows. Flags take the first row of each group by one aggregate, which is combined before the shuffle, and join
it back on the row number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.session import ROW_ID, held

_KEY, _CUTS, _CUT, _PIECE, _TOTAL, _BEFORE, _LEVEL = "__order", "__cuts", "__cut", "__piece", "__total", "__before", "__level"


def matches(left_keys: Sequence[str], right_keys: Sequence[str], null_safe: bool) -> Column:
    pairs = zip(left_keys, right_keys, strict=True)
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in pairs])


def key_join(
    left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi-join with a right side of one row per key.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. The result has the left columns and, for left and
    inner, the right columns that are no keys.
    """
    on = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    right_keys = [f"__right{i}" for i in range(len(on))]  # left names may stand in back-ticks
    renamed = right.withColumnsRenamed(dict(zip(on.values(), right_keys, strict=True)))
    return left.join(renamed, matches(list(on), right_keys, null_safe), how).drop(*right_keys)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def order_key(order: Sequence[str]) -> Column:
    """Columns as one comparable value, ascending with nulls last."""
    fields = []
    for i, name in enumerate(order):
        fields += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*fields)


def _cuts(keyed: DataFrame, pieces: int) -> Column:
    """The cut points, as a scalar: the ``pieces`` keys with the smallest hashes, sorted, in blocks of about the square root.

    Keys end with the row number, so rows that tie are cut like others. The choice depends on the held values only, so
    a lost task that runs again finds the same points.
    """
    chosen = keyed.select(_KEY).orderBy(F.xxhash64(_KEY), _KEY).limit(pieces)
    points = chosen.agg(F.array_sort(F.collect_set(_KEY)).alias("cuts"))
    points = points.withColumn("width", F.greatest(F.ceil(F.sqrt(F.size("cuts"))), F.lit(1)).cast("int"))
    heads = F.filter("cuts", lambda _, i: i % F.col("width") == 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("cuts")), lambda i: (i % F.col("width") == 0) & (i < F.size("cuts")))
    blocks = F.transform(starts, lambda i: F.slice("cuts", i + 1, F.col("width")))
    return points.select(F.struct(heads.alias("heads"), blocks.alias("blocks"), "width").alias("cuts")).scalar()


def _place(cuts: Column, key: Column) -> Column:
    """How many sorted cut points are at or below ``key``: first among the block heads, then inside one block."""
    block = F.size(F.filter(cuts["heads"], lambda cut: cut <= key))
    inside = F.size(F.filter(F.get(cuts["blocks"], block - 1), lambda cut: cut <= key))
    place = (F.greatest(block, F.lit(1)) - 1) * cuts["width"] + F.greatest(inside, F.lit(0))
    return F.coalesce(place, F.lit(0))


def _cut_groups(spark: SparkSession, cuts: Column, partition: Sequence[str]) -> DataFrame:
    """The groups that hold a cut point, under ``__group0``, ... with a mark; at most one for each cut."""
    points = spark.range(0, 1, 1, 1).select(cuts.alias(_CUTS)).select(F.inline(F.flatten(F.col(f"{_CUTS}.blocks"))))
    groups = points.select(*[F.col(f"v{i}").alias(f"__group{i}") for i in range(len(partition))])
    return groups.distinct().withColumn(_CUT, F.lit(True))


def running_total(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    target: str,
    weight: str | None = None,
    start_at: int = 1,
) -> DataFrame:
    """Exact row number, or running sum of ``weight``, per group in ``order`` (nulls last, ties by row number).

    The rows of all groups, in the order of group and ``order``, are cut at as many keys as there are shuffle partitions.
    Each piece of a group is numbered on its own, and shifted by the total of the group's pieces before it. Only groups that
    cross a cut have such a total, so those are no more than two rows for each cut. A group without a cut point is one piece
    as it is, so only the rows of groups that hold one look for their piece. How many cuts there are changes how
    the work is split, never the numbers. The rows are shuffled once; cuts and totals read the keys of the held table.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held(df, "numbered")
    order = [*order, ROW_ID]
    key = order_key([*partition, *order])
    cuts = _cuts(rows.withColumn(_KEY, key), pieces)
    if partition:
        groups = _cut_groups(rows.sparkSession, cuts, partition)
        held_by = [f"__group{i}" for i in range(len(partition))]
        marked = rows.join(F.broadcast(groups), matches(partition, held_by, True), "left").drop(*held_by)
    else:
        marked = rows.withColumn(_CUT, F.lit(True))
    placed = marked.withColumn(_CUTS, F.when(F.col(_CUT), cuts)).withColumn(_KEY, F.when(F.col(_CUT), key))
    placed = placed.withColumn(_PIECE, F.when(F.col(_CUT), _place(F.col(_CUTS), F.col(_KEY))).otherwise(0)).drop(_KEY, _CUTS)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    totals = placed.where(_CUT).groupBy(*partition, _PIECE).agg(amount.alias(_TOTAL))
    placed = placed.drop(_CUT)
    earlier = Window.partitionBy(*partition).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn(_BEFORE, F.sum(_TOTAL).over(earlier)).where(F.col(_BEFORE).isNotNull()).drop(_TOTAL)
    names = {c: f"__group{i}" for i, c in enumerate([*partition, _PIECE])}
    before = F.broadcast(before.withColumnsRenamed(names))  # at most one row for each cut
    shifted = placed.join(before, matches(list(names), list(names.values()), True), "left").drop(*names.values())
    window = Window.partitionBy(*partition, _PIECE).orderBy(*[F.asc_nulls_last(c) for c in order])
    if weight:
        own = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        own = F.row_number().over(window).cast("bigint") + (start_at - 1)
    numbered = shifted.withColumn(target, own + F.coalesce(F.col(_BEFORE), F.lit(0))).drop(_PIECE, _BEFORE)
    return numbered if ROW_ID in df.columns else numbered.drop(ROW_ID)


def flag_first(
    df: DataFrame,
    flags: Mapping[str, Sequence[str]],
    eligible: Column,
    order: Sequence[str],
    row_key: Sequence[str],
    last: bool = False,
    value: str = "Y",
) -> DataFrame:
    """Set each flag on the first (or last) eligible row of its group; other rows stay null.

    ``flags`` names the grouping columns per flag. Rows rank by ``order``, then ``row_key``, then their row number, so
    exactly one row of a group is flagged, also where rows repeat. An eligible row stands for its group of every flag in one
    aggregate, which is combined before it is shuffled, so a group may own any share of the rows. The winners, one row for
    each flagged row, are joined back on the row number: the rows themselves are shuffled once.
    """
    names = list(flags)
    rows = held(df.drop(*names), "flagged")
    ordering = [*order, *[k for k in row_key if k not in order], ROW_ID]
    pick = F.max if last else F.min
    rank = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(ordering)]) if last else order_key(ordering)
    columns = list(dict.fromkeys(c for group in flags.values() for c in group))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    groups = F.inline(F.array(*[
        F.struct(F.lit(i).alias(_LEVEL), *[(F.col(c) if c in flags[name] else F.lit(None).cast(kinds[c])).alias(f"g{k}") for k, c in enumerate(columns)])
        for i, name in enumerate(names)
    ]))
    best = rows.where(eligible).select(rank.alias(_KEY), groups).groupBy(_LEVEL, *[f"g{k}" for k in range(len(columns))]).agg(pick(_KEY).alias(_KEY))
    winner = F.col(f"{_KEY}.v{len(ordering) - 1}").alias(ROW_ID)
    marks = [F.max(F.when(F.col(_LEVEL) == i, F.lit(value))).alias(name) for i, name in enumerate(names)]
    winners = best.select(winner, _LEVEL).groupBy(ROW_ID).agg(*marks)
    flagged = key_join(rows, winners, [ROW_ID])
    return flagged if ROW_ID in df.columns else flagged.drop(ROW_ID)
