"""Text expressions: whitespace tokens, stripping, capitalising, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import fixed

# Under (?U) Java's \s is the Unicode White_Space property, which its matcher tests far faster (about ten times
# on chat text) than a class that lists the characters one by one. U+001C..U+001F are added by hand.
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.trim(text, F.lit(fixed.WHITESPACE))


def has_text(text: Column) -> Column:
    """True if anything but whitespace occurs; null stays null."""
    return text.rlike(_NON_SPACE)


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens; an empty array for blank text."""
    return F.regexp_extract_all(text, F.lit(_NON_SPACE + "+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def tail_tokens(text: Column, n: int, found: Column | None = None) -> Column:
    """The last ``n`` tokens joined by one space, or the text itself if it has no more than ``n``.

    ``found`` is a column that already holds the tokens of ``text``; finding them is the costly part."""
    if n < 1:
        raise ValueError(f"a tail needs at least one token, got {n}")
    found = tokens(text) if found is None else found
    return F.when(F.size(found) <= n, text).otherwise(F.array_join(F.slice(found, -n, n), " "))


def last_tokens(found: Column, n: Column) -> Column:
    """Up to ``n`` last tokens joined by one space, however many there are."""
    n = F.least(n, F.size(found))
    return F.array_join(F.slice(found, -n, n), " ")


def capitalize(text: Column) -> Column:
    """First character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers, an apostrophe suffix included."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD), F.lit(0))


def has_words(text: Column) -> Column:
    return F.lower(text).rlike(fixed.WORD)


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters, for messages and reports."""
    return F.substring(text, 1, n)
