"""Lines that an earlier line repeats, exactly or within one edit, by a join of deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialised

LEAST_CHARS_NEAR = 20  # shorter lines go only as exact repeats: one edit makes another word of them
NOT_BLANK = r"[^\x20\x09-\x0D]"
BLOCK = 32
BLOCKS = 64


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line (without spaces at its ends), line_key for every line that is not blank."""
    lines = docs.select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.trim("raw").alias("line")).where(F.col("line").rlike(NOT_BLANK))
    return lines.withColumn("line_key", F.xxhash64("line"))


def _width(length: Column, half: bool) -> Column:
    """Characters in a block: half the line, or 32, and more for lines that would have more than 64 blocks."""
    return F.ceil(length / 2).cast("int") if half else F.greatest(F.lit(BLOCK), F.ceil(length / BLOCKS).cast("int"))


def _spots(half: bool) -> Column:
    """Where in the line an edit can be: an array of (begin, rest), one for each block of the line.

    A line with one edit in a block equals the other line in all before the block, and in the ``rest``
    characters after it. ``rest`` is counted from the end, once as the longer of the two lines (or of the same
    length) and once as the shorter one, whose block is a character narrower.
    """
    def spots(length: Column) -> Column:
        width = _width(length, half)
        last = F.ceil(length / width).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
            (b * width).alias("begin"), F.greatest(length - (b + 1) * width, F.lit(0)).alias("rest")))

    length = F.length("line")
    return F.array_distinct(F.concat(spots(length), spots(length + 1)))


def _around(spot: Column) -> Column:
    """Key of what stands around a block."""
    return F.xxhash64(spot["begin"], spot["rest"], F.substr("line", F.lit(1), spot["begin"]),
                      F.when(spot["rest"] > 0, F.substr("line", F.length("line") - spot["rest"] + 1)).otherwise(""))


def _met(rows: DataFrame) -> DataFrame:
    """The rows (spot_key, line_key, n, ...) whose spot_key another line has too; uneven: one of another length."""
    several = rows.groupBy("spot_key").agg(
        F.min("line_key").alias("low"), F.max("line_key").alias("high"), (F.min("n") < F.max("n")).alias("uneven"))
    return rows.join(several.where("low <> high").select("spot_key", "uneven"), "spot_key")


def _variants() -> Column:
    """Keys of the variants of ``line`` that lack one character of the block at ``spot``, or none (if ``uneven``).

    kind 0: all but one character, its place and the length: lines that share it differ in that character.
    kind 1: the line without one character; kind 2: the whole line. A line of kind 2 and one of kind 1 with the
    same key differ by one insertion.
    """
    before = F.substr("line", F.lit(1), F.col("spot.begin"))
    inner = F.length("line") - F.col("spot.begin") - F.col("spot.rest")
    block = F.substr("line", F.col("spot.begin") + 1, inner)
    after = F.when(F.col("spot.rest") > 0, F.substr("line", F.length("line") - F.col("spot.rest") + 1)).otherwise("")

    def lacking(i: Column) -> Column:
        return F.xxhash64(before, F.concat(F.substr(block, F.lit(1), i - 1), F.substr(block, i + 1)), after, "spot.begin", "spot.rest")

    places = F.when(inner > 0, F.sequence(F.lit(1), inner)).otherwise(F.array().cast("array<int>"))
    keyed = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    same = F.transform(places, lambda i: keyed(0, F.xxhash64(lacking(i), i, F.length("line"))))
    return F.when(~F.col("uneven"), same).otherwise(F.concat(
        same,
        F.array_distinct(F.transform(places, lambda i: keyed(1, lacking(i)))),
        F.array(keyed(2, F.xxhash64(before, block, after, "spot.begin", "spot.rest"))),
    ))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of every line that has an earlier line within one edit; earlier is by doc_id, then line.

    Exact repeats are one class from the start. For the rest, deletion variants are emitted only where another line
    agrees with all that surrounds a block: first around halves of the line, then around blocks of 32 characters
    (no pair within one edit is lost by it). Lines that share a variant are never paired with each other: those of
    kind 0 are all within one edit of each other, so the earliest of the key decides, and those of kinds 1 and 2
    form a star. The distance to the earlier line found is then verified on both texts.
    """
    at = F.struct("doc_id", "line_no")
    lines = lines_of(docs)
    distinct = lines.withColumn("n", F.length("line")).withColumn(
        "halves", F.when(F.col("n") >= LEAST_CHARS_NEAR, F.transform(_spots(half=True), _around)))
    distinct = materialised(
        distinct.groupBy("line_key", "n").agg(F.min(at).alias("first_at"), F.first("halves").alias("halves")), "line-classes")
    halves = distinct.select("line_key", "n", F.explode("halves").alias("spot_key"))
    close = _met(halves).select("line_key").distinct()
    texts = distinct.join(close, "line_key").select("line_key", "first_at")
    texts = lines.withColumnRenamed("line_key", "key").join(
        texts, (F.col("key") == F.col("line_key")) & (at == F.col("first_at"))).select("line_key", "first_at", "line")
    texts = materialised(texts, "line-texts")
    spots = texts.select("line_key", F.length("line").alias("n"), F.explode(_spots(half=False)).alias("spot"), "line")
    spots = _met(spots.select("line_key", "n", "spot", _around(F.col("spot")).alias("spot_key")))
    spots = spots.groupBy("line_key", "spot").agg(F.max("uneven").alias("uneven"))
    variants = texts.join(spots, "line_key").select(
        "line_key", "first_at", F.explode(_variants()).alias("v")).select("line_key", "first_at", "v.kind", "v.key")
    variants = materialised(variants, "line-variants")
    own = F.struct(F.col("first_at"), F.col("line_key"))
    # the key's earliest line of each kind; a line of kind 1 looks at kind 2 and the other way round
    earliest = variants.groupBy("kind", "key").agg(F.min(own).alias("other"))
    earliest = earliest.withColumn("kind", F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.col("kind") + 1))
    pairs = variants.join(earliest, ["kind", "key"]).where(F.col("other.first_at") < F.col("first_at"))
    pairs = pairs.groupBy("line_key").agg(F.min("other").alias("other")).select(
        "line_key", F.col("other.line_key").alias("other_key"))
    mine = texts.select("line_key", F.col("line").alias("mine"))
    theirs = texts.select(F.col("line_key").alias("other_key"), F.col("line").alias("theirs"))
    near = pairs.join(mine, "line_key").join(theirs, "other_key").where(F.levenshtein("mine", "theirs", 1) >= 0).select("line_key").distinct().withColumn("near", F.lit(True))
    # written, so that both sides of the join below are plain shuffles and a line that many documents hold can be split
    known = materialised(distinct.select("line_key", "first_at").join(near, "line_key", "left"), "line-known")
    return lines.select("doc_id", "line_no", "line_key").join(known, "line_key").where(
        F.col("near") | ~F.col("first_at").eqNullSafe(at)).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines taken out that an earlier line repeats, and two more columns, named by ``counts`` (they replace
    columns of those names): how many lines there were, and how many are gone.

    Lines are what newlines part; spaces at a line's ends don't count. Blank lines stay, lines under
    20 characters go only as exact repeats, longer ones also if one character is inserted, deleted or replaced.
    Earlier means a smaller doc_id (null first), then a smaller line number. n_chars, where there is such a
    column, is set to the new length; all other columns stay. A null text stays null and has no lines. Rows that
    repeat a doc_id count as one document: equal lines at the same place of such rows share their fate.
    """
    gone = repeated_lines(docs).groupBy(F.col("doc_id").alias("line_dedup_id")).agg(F.collect_set("line_no").alias("line_dedup_gone"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("line_dedup_id")), "left")
    rest = F.transform(F.array(F.split("text", "\n")), lambda parts: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("line_dedup_gone")), lambda i: parts[i]), "\n"))[0]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    new = {counts[0]: n_lines.cast("bigint"), counts[1]: F.coalesce(F.size("line_dedup_gone"), F.lit(0)).cast("bigint"),
           "text": F.when(F.col("line_dedup_gone").isNull(), F.col("text")).otherwise(rest)}
    out = out.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
    out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")) if "n_chars" in docs.columns else out
    return out.select(*docs.columns, *[c for c in counts if c not in docs.columns])
