"""Line-first cleaning with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import BLANKS, free_prefix

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: The end of a sentence, closing quotes and brackets included; a line without one is no prose.
SENTENCE_END = "[.!?:;…。！？][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
#: Page furniture that is no text of the document.
BOILERPLATE = (
    "(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved"
    "|enable javascript|javascript is (disabled|required)|skip to (main )?content"
    "|subscribe to our newsletter|click here to)"
)
#: Separators between the entries of a menu.
NAVIGATION = " [|»›•·] | [|»›•·]$"
#: Words ending in runs that prose doesn't have.
NOISY_WORD = "([#*$%&]{2,}|!{2,}|[?]{3,})"
#: A line fails where more than this share of its words is noisy or a menu entry.
NOISY_PERCENT = 25
#: A document is rejected when its failed lines hold more than this share of its text.
LOST_PERCENT = 50
WINDOW = 5
#: What a text must hold, besides symbols and runs, for a pattern above to match.
_BOILERPLATE_STEMS = ("policy", "terms of", "rights reserved", "javascript", "content", "newsletter", "click here")
_SEPARATORS = "|»›•·"
_WORD_CHAR = r"[^\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """One 64-bit hash per five-word window, in order; none below two windows."""
    count = F.size(words) - (WINDOW - 1)
    return F.when(
        count >= 2,
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Sorted by hash, a repeated window stands beside its like. The places of all
    repeated windows, in order, cover min(5, gap to the next) words each.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<int>")

    def twins(sorted_rows: Column) -> Column:
        near = F.zip_with(
            sorted_rows,
            F.slice(sorted_rows, 2, F.size(sorted_rows)),
            lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(empty),
        )
        return F.sort_array(F.array_distinct(F.flatten(near)))

    def cover(places: Column) -> Column:
        gaps = F.zip_with(
            places, F.slice(places, 2, F.size(places)),
            lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))),
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

    return cover(twins(placed))


def _any_of(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def _line_fails(line: Column, inner: str) -> Column:
    """Whether a line with a word fails one of the three rules.

    What the whole text lacks needn't be looked for in its lines. ``inner`` begins the
    names of the columns that say so.
    """
    words = F.size(_words(line))
    noisy = F.regexp_count(line, F.lit(NOISY_WORD)) * 100 > words * NOISY_PERCENT
    entries = F.regexp_count(line, F.lit(NAVIGATION)) * 100 > words * NOISY_PERCENT
    return (
        ~line.rlike(SENTENCE_END)
        | ((F.col(f"{inner}symbols") | F.col(f"{inner}runs")) & noisy)
        | (F.col(f"{inner}menu") & entries)
        | (F.col(f"{inner}furniture") & line.rlike(BOILERPLATE))
    )


def judge_lines(docs: DataFrame, text_col: str = "text", verdict: str = "rules") -> DataFrame:
    """Add the counts, both verdicts and the cleaned text to every row of ``docs``.

    New columns, all in a struct named ``verdict`` that takes the place of a column
    of that name: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed,
    kept, cleaned. A null text is empty: no words, so it fails the base rules.
    Lines are parts between \\n; a line without a word is neither judged nor lost.
    Row-local: no shuffle, one long text is one row of work.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Each step stands on columns that the step before has computed once.
    inner = free_prefix(docs, "rules_")
    got = lambda name: F.col(f"{inner}{name}")
    flags = _once(docs, inner, text=text, low=F.lower(text))
    flags = _once(
        flags, inner,
        symbols=_any_of(got("text"), SYMBOLS),
        runs=_any_of(got("text"), ("!!", "??")),
        menu=_any_of(got("text"), _SEPARATORS),
        furniture=_any_of(got("low"), _BOILERPLATE_STEMS),
    )
    split = _once(
        flags, inner,
        words=_words(got("text")),
        lines=F.filter(F.split(got("text"), "\n"), lambda x: x.rlike(_WORD_CHAR)),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    # The gate spares texts without any symbol the slower count.
    symbols = F.length(got("text")) - F.length(F.translate(got("text"), SYMBOLS, ""))
    counted = _once(
        split, inner,
        n_words=F.size(got("words")).cast("bigint"),
        word_chars=F.length(F.array_join(got("words"), "")).cast("bigint"),
        n_symbols=F.when(got("symbols"), symbols).otherwise(F.lit(0)).cast("bigint"),
        n_dup_lines=(F.size(got("lines")) - F.size(F.array_distinct(got("lines")))).cast("bigint"),
        all_chars=total(got("lines")),
        hashes=_window_hashes(got("words")),
        good=F.filter(got("lines"), lambda x: ~_line_fails(x, inner)),
    )
    repeats = F.when(
        F.size(F.array_distinct(got("hashes"))) < F.size(got("hashes")), _covered(got("hashes"))
    ).otherwise(F.lit(0).cast("bigint"))
    counted = _once(
        counted, inner,
        n_repeat_words=repeats,
        good_chars=total(got("good")),
        cleaned=F.array_join(got("good"), "\n"),
    )
    base_failed = (got("n_words") < 10) | (got("n_repeat_words") * 100 > got("n_words") * 20)
    lost = got("all_chars") - got("good_chars")
    return counted.select(
        *[counted[f"`{c}`"] for c in docs.columns if c != verdict],
        F.struct(
            *[got(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            lost.alias("lost_chars"),
            base_failed.alias("base_failed"),
            (~base_failed & (lost * 100 <= got("all_chars") * LOST_PERCENT)).alias("kept"),
            got("cleaned").alias("cleaned"),
        ).alias(verdict),
    )


def _once(df: DataFrame, inner: str, **columns: Column) -> DataFrame:
    """Add columns, their names after ``inner``, through a one-row generator.

    The optimizer copies the expressions of a plain projection into every place
    that uses them, which here would split a text anew for each count and filter.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(f"{inner}{n}") for n, c in columns.items()]))))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their failed lines removed; same columns.

    ``n_chars``, where there is one, counts the cleaned text.
    """
    verdict = free_prefix(docs, "verdict")
    judged = judge_lines(docs, text_col, verdict).where(f"{verdict}.kept")
    new = {text_col: F.col(f"{verdict}.cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(f"{verdict}.cleaned").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
