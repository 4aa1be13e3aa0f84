"""CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.errors import ContractError

# Spellings of a missing value in source files.
NULL_TOKENS = ["", "NA", "N/A"]
ROW = "_source_row"
_BAD = "__corrupt"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names as written in the first line; only that line is read."""
    first = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise ContractError("the CSV file is empty")
    names = ["" if v is None else v for v in first[0]]
    return [names[0].removeprefix("\ufeff"), *names[1:]]


def _null_tokens(c: str):
    return F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c)


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_literal(
    spark: SparkSession, path: str, names: list[str] | None = None, trim: bool = True, multi_line: bool = False
) -> DataFrame:
    """All columns as text, null tokens as null, plus a row key that grows in read order.

    The key holds the file, where the split begins in it, and a number within the split: its order is that of the
    lines, whatever the sizes of the files. Every file must have the same header as the first one (or ``names``, where
    they are known and no header is looked up); a file whose columns stand in another order is refused.
    ``multi_line`` reads fields that hold line breaks; such a file is read by one task, so it is off by default.
    """
    names = names or header(spark, path)
    df = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .schema(_text_schema(names))
        .csv(path)
    )
    line = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select(*[_null_tokens(c) for c in names], line.alias(ROW))


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types are inferred after the null tokens are gone; used for profiling only."""
    literal = read_literal(spark, path).drop(ROW)
    names = literal.columns
    # one pass decides the narrowest type that reads every value of a column
    checks = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        known = col.isNotNull()
        checks += [
            F.count_if(known).alias(f"n{i}"),
            F.count_if(known & col.try_cast("double").isNull()).alias(f"x{i}"),
            F.count_if(known & ~col.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias(f"d{i}"),
            F.count_if(known & ~col.isin("TRUE", "FALSE", "T", "F", "true", "false")).alias(f"b{i}"),
        ]
    found = literal.agg(*checks).first()
    typed = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        if found[f"n{i}"] == 0 or found[f"b{i}"] == 0:
            typed.append(F.upper(col).isin("T", "TRUE").alias(c))
        elif found[f"x{i}"] == 0:
            typed.append(col.try_cast("double").alias(c))
        elif found[f"d{i}"] == 0:
            typed.append(F.try_to_date(col, "yyyy-MM-dd").alias(c))
        else:
            typed.append(col)
    return literal.select(*typed)


def check_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Refuse blank or repeated header names and lines that do not fit the header; else return the table."""
    names = header(spark, path)
    if not names or names == [""]:
        raise ContractError("the CSV file has no columns")
    if any(not n.strip() for n in names):
        raise ContractError("the CSV file has a blank column name")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ContractError(f"the CSV file repeats column names: {', '.join(twice)}")
    schema = _text_schema(names).add(_BAD, T.StringType())
    rows = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
        # all fields of a line are parsed, else a line with too many of them would pass
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _BAD).schema(schema).csv(path)
    )
    first = F.count(f"`{names[0]}`")
    count = rows.agg(F.count(_BAD).alias("n"), first.alias("c")).first()["n"]
    if count:
        shown = [] if multi_line else refused_lines(spark, path, names).orderBy("file", "split", "line").limit(5).collect()
        places = "; ".join(f"{r['file'].rsplit('/', 1)[-1]} line {r['line']}: {r['reason']}" for r in shown)
        raise ContractError(f"{count} lines do not fit the header" + (f" ({places})" if places else ""))
    return read_literal(spark, path, names, False, multi_line).drop(ROW)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), id (grows in the order of the lines) and value of every line of the files."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("id"), "value")


def _fields(value: Column) -> Column:
    """The fields of a line as they are written; commas inside quotes do not part them."""
    return F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))


def _unquoted(field: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(field, r'^"((?:[^"]|"")*)"$', 1), '""', '"')
    return F.when(field.startswith('"'), inner).otherwise(F.trim(field))


def header_report(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """file, header and first difference of every file of a folder, compared in one job; null where a header fits.

    ``names`` are the expected columns, by default those of the first file by path. An empty file has no header and no row.
    """
    first = _lines(spark, path).where("split = 0").groupBy("file").agg(F.min_by("value", "id").alias("header"))
    first = first.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))
    found = F.transform(_fields(F.col("header")), _unquoted)
    expected = F.array(*[F.lit(n) for n in names or header(spark, path)])
    place = F.sequence(F.lit(0), F.greatest(F.size("found"), F.size("expected")) - 1)
    other = F.filter(place, lambda i: ~F.get("found", i).eqNullSafe(F.get("expected", i)))
    at = F.get(other, F.lit(0))
    mine, theirs = F.get("found", at), F.get("expected", at)
    text = (
        F.when(at.isNull(), None)
        .when(mine.isNull(), F.concat(F.lit("column "), at + 1, F.lit(": "), theirs, F.lit(" is missing")))
        .when(theirs.isNull(), F.concat(F.lit("column "), at + 1, F.lit(": "), mine, F.lit(" is not expected")))
        .otherwise(F.concat(F.lit("column "), at + 1, F.lit(": "), mine, F.lit(" in place of "), theirs))
    )
    return first.withColumns({"found": found, "expected": expected}).select("file", "header", text.alias("difference"))


def refused_lines(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The lines that do not fit the header: file, split, line (from 1 within the split), text, reason.

    For files whose fields hold no line breaks. Blank lines and the first line of each file are not judged (``header_report``
    does that). Only refused lines are shuffled; a split's first line is found by an aggregate.
    """
    n = len(names or header(spark, path))
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    fields = F.size(_fields(F.col("value")))
    reason = (
        F.when(quotes % 2 == 1, "a quote is not closed")
        .when(fields > n, F.concat(fields.cast("string"), F.lit(f" fields, the header names {n}")))
        .when(fields < n, F.concat(fields.cast("string"), F.lit(f" fields, the header names {n}")))
    )
    bad = lines.where(F.trim("value") != "").withColumn("reason", reason).where("reason is not null")
    begin = lines.groupBy("file", "split").agg(F.min("id").alias("begin"))
    placed = bad.join(begin, ["file", "split"]).withColumn("line", F.col("id") - F.col("begin") + 1)
    return placed.where("not (split = 0 and line = 1)").select("file", "split", "line", F.col("value").alias("text"), "reason")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Null becomes an empty field; dates are ISO text."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
