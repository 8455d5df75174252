"""Names and cells: cleaning, key normalisation, acronyms, listing names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, functions as F

from rosterlake import vocab

#: Whitespace as Unicode sees it, plus the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Whatever is neither a letter, a digit nor an underscore.
NOT_WORDS = r"[^\p{L}\p{N}_]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Naming the value keeps the expression tree linear where a step needs its
    input more than once; nesting the input instead would double the tree at
    every step.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(words) -> str:
    """Regex alternation over literal words."""
    return "|".join(re.sub(r"([^A-Za-z0-9 _@])", r"\\\1", w) for w in words)


def fold_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """True where a text holds something; never NULL."""
    return F.coalesce(c != "", F.lit(False))


# --- accents -----------------------------------------------------------------

@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, tuple[tuple[str, str], ...], str]:
    """Compatibility folding derived from the Unicode database.

    Returns (from, to) for characters that fold to one character, a class of
    characters that fold to several with their replacements (Latin letters,
    ligatures, letter-like signs and fractions), and a class of combining marks.
    """
    ones_from, ones_to, several, marks = [], [], [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(code)
            continue
        folded = "".join(
            d for d in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(d)
        )
        if folded == ch:
            continue
        if len(folded) == 1:
            ones_from.append(ch)
            ones_to.append(folded)
        elif code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x2000 <= code < 0x2190 or (
            0xFB00 <= code <= 0xFB06
        ):
            several.append((ch, folded))
    spans, start, prev = [], None, None
    for code in marks + [None]:
        if prev is not None and code == prev + 1:
            prev = code
            continue
        if start is not None:
            spans.append(f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        start = prev = code
    several_class = "[" + "".join(f"\\x{{{ord(c):x}}}" for c, _ in several) + "]"
    return "".join(ones_from), "".join(ones_to), several_class, tuple(several), "[" + "".join(spans) + "]"


def fold_accents(c: Column) -> Column:
    """Compatibility-decompose and drop combining marks; ASCII passes untouched.

    The folding is bound, not inlined: it is a long expression for rare rows, and
    inlined it would swell the generated code of every row.
    """
    source, target, several_class, several, marks = _accent_tables()
    groups: dict[str, list[str]] = {}
    for ch, folded in several:
        groups.setdefault(folded, []).append(ch)

    def fold(text: Column) -> Column:
        spread = reduce(
            lambda acc, item: F.regexp_replace(acc, f"[{''.join(item[1])}]", item[0]),
            groups.items(),
            text,
        )
        widened = F.when(text.rlike(several_class), spread).otherwise(text)
        return F.regexp_replace(F.translate(widened, source, target), marks, "")

    return F.when(c.rlike(r"[^\x00-\x7f]"), bind(c, fold)).otherwise(c)


# --- keys --------------------------------------------------------------------

_STOP = "|".join(vocab.NOISE_WORDS + vocab.PLACE_WORDS)
#: A word of four or more characters that is neither noise nor a place.
_DISTINCTIVE = rf"(?!(?:{_STOP})(?!\S))\S{{4}}"
#: Two to six single letters in a row, one group each.
_INITIALS = (
    r"(?U)\b([a-z]) ([a-z])(?: ([a-z]))?(?: ([a-z]))?(?: ([a-z]))?(?: ([a-z]))?\b"
)
_NOISE = "|".join(vocab.NOISE_WORDS)
#: A noise word with the text before it, in a name that holds some other word.
_NOISE_BESIDE_WORDS = (
    rf"(?Us)(?:^(?=.*?(?<!\S)(?!(?:{_NOISE})(?!\S))\S)|(?!^)\G)(.*?)(?<!\S)(?:{_NOISE})(?!\S)"
)


def _words(c: Column) -> Column:
    """Lowered head of a name as single-spaced words."""
    head = F.substring_index(F.lower(fold_accents(c)), ",", 1)
    return F.trim(F.regexp_replace(F.replace(head, F.lit("&"), F.lit(" and ")), NOT_WORDS, " "))


def _where(found: Callable[[Column], Column], change: Callable[[Column], Column]):
    """A step that changes a text only where a cheap test finds something."""
    return lambda text: F.when(found(text), change(text)).otherwise(text)


def _abbreviation_steps():
    by_word: dict[str, list[str]] = {}
    for short, full in vocab.ABBREVIATIONS.items():
        by_word.setdefault(full, []).append(short)
    for full, shorts in by_word.items():
        pattern = rf"(?<!\S)(?:{'|'.join(shorts)})(?!\S)"
        yield _where(
            lambda t, shorts=shorts: reduce(or_, [t.contains(s) for s in shorts]),
            lambda t, pattern=pattern, full=full: F.regexp_replace(t, pattern, full),
        )


def _suffix_pattern(phrase: str) -> str:
    """Matches a suffix phrase with the text before it, from the start of a name on.

    It matches only if a distinctive word stands outside every occurrence of the
    phrase, so removing what it finds never empties a name.
    """
    words = phrase.split(" ")
    inside = "".join(
        rf"(?!(?<=\b{' '.join(words[:k])} ){' '.join(words[k:])}\b)" for k in range(1, len(words))
    )
    outside = rf"(?<!\S)(?!{phrase}\b){inside}{_DISTINCTIVE}"
    return rf"(?Us)(?:^(?=.*?{outside})|(?!^)\G)(.*?)\b{phrase}\b"


def _suffix_steps():
    for phrase in vocab.NAME_SUFFIXES:
        pattern = _suffix_pattern(phrase)
        yield _where(
            lambda t, phrase=phrase: t.contains(phrase),
            lambda t, pattern=pattern: F.regexp_replace(t, pattern, "$1 "),
        )


def _drop_noise(text: Column) -> Column:
    return fold_space(F.regexp_replace(text, _NOISE_BESIDE_WORDS, "$1"))


def _drop_connectives(text: Column) -> Column:
    inner = F.trim(F.regexp_replace(text, r"^and\s+|\s+and$", ""))
    return F.trim(F.regexp_replace(inner, r"\s+and\s+", " "))


def normalize_name(c: Column) -> Column:
    """Reduce an organisation name to its match key; '' if nothing is left."""
    steps = [
        *_abbreviation_steps(),
        lambda t: F.regexp_replace(t, _INITIALS, "$1$2$3$4$5$6"),
        *_suffix_steps(),
        _drop_noise,
        _where(lambda t: t.contains("and"), _drop_connectives),
    ]
    return reduce(bind, steps, _words(F.coalesce(c, F.lit(""))))


def normalize_district(c: Column) -> Column:
    """District part of the match key; missing becomes ''."""
    lowered = F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(lowered, NOT_WORDS, " "))


def acronym(c: Column, skip=vocab.ACRONYM_SKIP) -> Column:
    """Initials of the words of a name, leaving out the skipped words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    kept = F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*skip))
    return F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), "")


def repair_name(c: Column) -> Column:
    """Put back the "nan" a spreadsheet tool cut out of a name."""
    return F.replace(c, F.lit("[]"), F.lit("nan"))


# --- cells -------------------------------------------------------------------

def clean_cell(c: Column) -> Column:
    """Fold whitespace and turn placeholder text into NULL."""
    text = fold_space(c)
    return F.when(
        ~F.lower(text).isin(*vocab.PLACEHOLDERS) & ~c.isin(*vocab.READER_NULLS), text
    )


def split_cell(c: Column) -> Column:
    """The values of a multi-value cell, in order."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[,;/|\n]+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def classify_stream(c: Column, default: str) -> Column:
    """Stream named by a course cell."""
    fallback = default if default in vocab.STREAMS else vocab.STREAMS[0]
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(lowered.contains("bca") | lowered.contains("computer application"), F.lit("BCA"))
        .when(lowered != "", F.lit("Engineering"))
        .otherwise(F.lit(fallback))
    )


def with_scheme(c: Column) -> Column:
    """Prepend https:// where a website has no scheme."""
    return F.when(
        present(c) & ~c.startswith("http://") & ~c.startswith("https://"),
        F.concat(F.lit("https://"), c),
    ).otherwise(c)


# --- listing names -----------------------------------------------------------

_CATEGORY = "(?iU)" + "|".join(f"(?:{p})" for p in vocab.CATEGORY_PATTERNS)
_INSTITUTION = "(?iU)" + vocab.INSTITUTION_WORDS


def _drop_alias(name: Column) -> Column:
    alias = F.regexp_extract(name, vocab.ALIAS_PREFIX, 1)
    rest = F.trim(F.regexp_extract(name, vocab.ALIAS_PREFIX, 2))
    fuller = (
        (alias != "")
        & ~alias.rlike(_INSTITUTION)
        & (F.length(rest) >= 12)
        & rest.rlike(_INSTITUTION)
        & (F.length(rest) > F.length(alias))
    )
    return F.when(fuller, rest).otherwise(name)


def clean_listing_name(c: Column) -> Column:
    """Strip listing decoration; NULL where no specific organisation is named."""
    name = F.regexp_replace(fold_space(F.coalesce(c, F.lit(""))), r"^[|\-–—:,]+|[|\-–—:,]+$", "")
    name = F.trim(F.regexp_replace(name, "(?iU)" + vocab.BADGE_PREFIX, ""))
    name = F.trim(F.regexp_replace(name, "(?iU)" + vocab.LISTING_NOISE, ""))
    name = bind(name, _drop_alias)
    name = F.regexp_replace(name, r"^\d+[.)]\s*", "")
    name = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))

    def judge(text: Column) -> Column:
        tokens = F.transform(
            F.regexp_extract_all(text, F.lit(r"[A-Za-z.]+"), F.lit(0)),
            lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""),
        )
        specific = F.exists(
            tokens, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*vocab.GENERIC_TOKENS)
        )
        keep = (
            (F.length(text) >= 8)
            & text.rlike(_INSTITUTION)
            & ~text.rlike(_CATEGORY)
            & specific
            & (normalize_name(text) != "")
        )
        return F.when(keep, text)

    return bind(name, judge)
