"""Text functions: combining, splitting, naming, secret scanning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.errors import ContractError
from cohortloom.functions.conditions import blank_to_null


def text_literal_map(entries: Mapping[str, str]) -> Column:
    """A registered small mapping as a map literal (specification data, never table data)."""
    return F.create_map(*[F.lit(v) for pair in entries.items() for v in pair])


def combine(columns: Iterable[Column], separator: str, missing: str = "return_missing") -> Column:
    """Join fields with a separator.

    ``return_missing`` gives null as soon as one field is null; ``skip_missing`` leaves nulls out.
    """
    parts = [c.cast("string") for c in columns]
    if missing == "skip_missing":
        return F.concat_ws(separator, *parts)
    if missing != "return_missing":
        raise ContractError(f"unknown missing policy {missing!r}")
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit(separator), part]
    return F.concat(*pieces)


def subject_id(columns: Iterable[Column], separator: str = "-") -> Column:
    return combine(columns, separator, "return_missing")


def part(c: Column, separator: str, position: int) -> Column:
    """The ``position``-th piece (from 1) of text split at a literal separator, null if there is none."""
    return F.try_element_at(F.split(c, re.escape(separator)), F.lit(position))


def change_case(c: Column, case: str) -> Column:
    if case not in ("upper", "lower"):
        raise ContractError(f"unknown case {case!r}")
    return F.upper(c) if case == "upper" else F.lower(c)


def coalesce_fields(columns: Iterable[Column]) -> Column:
    """First non-blank value in the listed order; the last field is taken as it is."""
    columns = list(columns)
    return F.coalesce(*[blank_to_null(c) for c in columns[:-1]], columns[-1])


def fields_disagree(columns: Iterable[Column]) -> Column:
    """True where the running first non-blank value meets a different later value."""
    columns = list(columns)
    running, conflict = columns[0], F.lit(False)
    for following in columns[1:]:
        differs = running.cast("string") != following.cast("string")
        conflict = conflict | F.coalesce(differs, F.lit(False))
        running = F.coalesce(blank_to_null(running), following)
    return conflict


def unit_alias(unit: Column, aliases: Mapping[str, str]) -> Column:
    return F.coalesce(text_literal_map(aliases)[unit], unit)


def slug(name: Column) -> Column:
    """A table id from a file stem: ``[a-z0-9_]``, not starting with a digit, 48 characters at most."""
    clean = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"))
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    clean = F.when(clean == "", F.concat(F.lit("dataset_"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(clean)
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("d_"), clean)).otherwise(clean)
    return F.substring(clean, 1, 48)


def _accented() -> tuple[str, str]:
    """Latin letters with an accent, and the letters without it."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    folded = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in folded), "".join(b for _, b in folded)


_ACCENTS = _accented()


def norm_name(name: Column) -> Column:
    """Upper-case letters and digits only, accents folded, for comparing names."""
    return F.upper(F.regexp_replace(F.translate(name, *_ACCENTS), "[^A-Za-z0-9]", ""))


# Field names that carry an identifier role.
STUDY_FIELDS = ["STUDY", "STUDYID"]
SUBJECT_FIELDS = ["PATNUM", "SUBJID", "USUBJID", "SUBJECT", "PATIENT"]
SITE_FIELDS = ["SITE", "SITEID", "CENTER", "CENTRE"]
IDENTIFIER_ROLES = ["study_identifier", "subject_identifier", "site_identifier"]


def field_role(name: Column) -> Column:
    upper = F.upper(name)
    return (
        F.when(upper.isin(STUDY_FIELDS), "study_identifier")
        .when(upper.isin(SUBJECT_FIELDS), "subject_identifier")
        .when(upper.isin(SITE_FIELDS), "site_identifier")
        .when(upper.rlike("DATE|DAT$|DTC$"), "date")
        .when(upper.rlike("TIME|TIM$"), "time")
        .otherwise("")
    )


def field_label(name: Column, labels: Mapping[str, str] | None = None) -> Column:
    spoken = F.regexp_replace(name, "[._]", " ")
    return F.coalesce(text_literal_map(labels)[name], spoken) if labels else spoken


# What a leaked key looks like.
SECRET_PATTERN = r"(?i)(sk-[A-Za-z0-9_-]{16,}|api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_-]{16,})"


def has_secret(text: Column, patterns: Iterable[str] = (SECRET_PATTERN,), literals: Iterable[str] = ()) -> Column:
    """True where the whole text holds a key-like pattern or one of the listed secrets."""
    hits = [text.rlike(p) for p in patterns] + [text.contains(s) for s in literals if s]
    found = F.lit(False)
    for hit in hits:
        found = found | hit
    return F.coalesce(found, F.lit(False))


def redact(text: Column, literals: Iterable[str], mask: str = "[REDACTED]") -> Column:
    for secret in dict.fromkeys(s for s in literals if s):
        text = F.replace(text, F.lit(secret), F.lit(mask))
    return text


def compact(values: Column, limit: int = 120) -> Column:
    """Join an array with `` | `` and cut it to ``limit`` characters."""
    joined = F.array_join(values, " | ")
    return F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit - 3), F.lit("..."))).otherwise(joined)
