"""Page text and name candidates in markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.text import fold_space, present

#: Entity -> character.
_ENTITIES = (("&amp;", "&"), ("&nbsp;", " "), ("&#039;", "'"), ("&quot;", '"'))


def page_text(markdown: Column, html: Column) -> Column:
    """Everything worth searching on a page."""
    return F.when(
        present(markdown), F.concat(markdown, F.lit("\n"), F.coalesce(html, F.lit("")))
    ).otherwise(html)


def candidate_names(html: Column) -> Column:
    """Texts of 8 to 120 characters in headings and links, in order."""
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(vocab.NAME_MARKUP), F.lit(1))

    def read(fragment: Column) -> Column:
        bare = F.regexp_replace(fragment, "<[^>]+>", " ")
        plain = reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), _ENTITIES, bare)
        return fold_space(plain)

    return F.filter(
        F.transform(inner, read), lambda t: (F.length(t) >= 8) & (F.length(t) <= 120)
    )
