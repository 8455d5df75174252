"""Phone numbers: one standard form or nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.text import bind, blank_to_null, split_cell

_DATE = "(?U)" + vocab.DATE_LIKE
#: Leading pluses, then at most two trunk or country prefixes, each only while
#: ten or more characters follow it.
_PREFIXES = r"^\+*(?:(?:0|91)(?=.{10})){0,2}"
#: Ten characters starting 2-9 with more than two different ones among them.
_DIALABLE = r"^(?=[2-9].{9}$)(?!(.)\1*(?:(.)(?:\1|\2)*)?$)(.{10})$"


def _bare_digits(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)[^\d+]", ""), _PREFIXES, "")


def normalize_phone(raw: Column) -> Column:
    """``+91-##########``, or NULL where the text is no dialable number."""
    core = F.regexp_extract(_bare_digits(raw), _DIALABLE, 3)
    return F.when(
        ~raw.rlike(_DATE), blank_to_null(F.regexp_replace(core, r"^(.{10})$", r"+91-$1"))
    )


def phone_reject_reason(raw: Column) -> Column:
    """Why a text is not a phone number; NULL where it is one."""

    def why(digits: Column) -> Column:
        length = F.length(digits)
        return (
            F.when(raw.isNull() | (F.trim(raw) == ""), F.lit("empty"))
            .when(raw.rlike(_DATE), F.lit("date"))
            .when((length < 8) | (length > 12), F.lit("length"))
            .when(F.size(F.array_distinct(F.split(digits, ""))) <= 2, F.lit("repeated digits"))
            .when(length > 10, F.lit("run together"))
            .when(length < 10, F.lit("no area code"))
            .when(~digits.rlike("^[2-9]"), F.lit("first digit"))
        )

    return bind(_bare_digits(raw), why)


def _standard(parts: Column) -> Column:
    return F.filter(F.transform(parts, normalize_phone), lambda p: p.isNotNull())


def phones_in_cell(c: Column) -> Column:
    """Distinct numbers of a multi-value cell in order."""
    return F.array_distinct(_standard(split_cell(c)))


def phones_in_roster_cell(c: Column) -> Column:
    """Distinct numbers of a roster cell.

    A part is read as one number first; only where that fails are its
    whitespace-separated pieces tried.
    """

    def read(part: Column) -> Column:
        return bind(
            normalize_phone(part),
            lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(
                _standard(F.split(part, r"(?U)\s+"))
            ),
        )

    return F.array_distinct(F.flatten(F.transform(split_cell(c), read)))


def phones_in_text(c: Column) -> Column:
    """Distinct numbers found in running text, first seen first."""
    found = F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit("(?U)" + vocab.PHONE_IN_TEXT), F.lit(0)
    )
    # Every match holds two runs of digits side by side; a search for them settles most texts.
    some = c.rlike(r"(?U)\d{3}[\s\-]?\d{3}")
    return F.when(some, F.array_distinct(_standard(found))).otherwise(F.array().cast("array<string>"))
