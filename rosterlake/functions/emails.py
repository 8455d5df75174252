"""Email addresses in cells, in running text and in obfuscated markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.text import bind, split_cell


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def email_domain(email: Column) -> Column:
    """Everything after the first @, lowered; '' where there is none."""
    return F.lower(F.regexp_extract(email, r"(?s)^[^@]*@(.*)$", 1))


def emails_in_cell(c: Column) -> Column:
    """Distinct lowered addresses of a multi-value cell in order."""
    found = F.flatten(
        F.transform(
            split_cell(c),
            lambda p: F.regexp_extract_all(p, F.lit(vocab.EMAIL_IN_CELL), F.lit(0)),
        )
    )
    return F.array_distinct(F.transform(found, F.lower))


def _salvage(address: Column) -> Column:
    """Cut a run-together number of six or more digits off the local part.

    Only where at least three characters, not starting with a digit, remain.
    """
    return F.regexp_replace(address, r"^[^@]*?\d{6,}(?=[a-z])(?=[^@\d][^@]{2,}@)", "")


def emails_in_text(c: Column) -> Column:
    """Distinct plausible addresses in running text, first seen first."""
    found = F.transform(
        F.regexp_extract_all(c, F.lit(vocab.EMAIL_IN_TEXT), F.lit(0)),
        lambda a: F.regexp_replace(F.lower(a), r"[.,;:)\]}>'\"]+$", ""),
    )
    useful = F.filter(found, lambda a: ~a.rlike("(?i)" + vocab.JUNK_EMAIL))
    repaired = F.filter(F.transform(useful, _salvage), lambda a: ~a.rlike(r"(?U)^\d"))
    # Most texts hold no address at all; one search settles those.
    return F.when(c.contains("@"), F.array_distinct(repaired)).otherwise(_no_strings())


def decode_obfuscated(payload: Column) -> Column:
    """Address behind one hex payload: the first byte is the XOR key."""

    def letters(key: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(3), F.length(payload), F.lit(2)),
            lambda i: F.char(
                F.conv(F.substring(payload, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key).cast("bigint")
            ),
        )

    first = F.conv(F.substring(payload, 1, 2), 16, 10).cast("int")
    sound = (F.length(payload) >= 4) & (F.length(payload) % 2 == 0)
    text = F.when(sound, F.array_join(bind(first, letters), ""))
    return bind(text, lambda t: F.when(t.rlike(r"(?s)@(?:.*@)?[^@]*\.[^@]*$"), t))


def emails_obfuscated(html: Column) -> Column:
    """Distinct obfuscated addresses of a page in document order."""
    payloads = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(vocab.OBFUSCATED_EMAIL), F.lit(1)
    )
    decoded = F.filter(F.transform(payloads, decode_obfuscated), lambda a: a.isNotNull())
    return F.array_distinct(decoded)
