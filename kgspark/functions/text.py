"""Column functions on plain text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kgspark.vocab import BLANK, BLANK_CHARACTERS


def strip(c: Column) -> Column:
    """Remove blanks (Unicode ones too) from both ends."""
    return F.trim(c, F.lit(BLANK_CHARACTERS))


def normalize_text(c: Column) -> Column:
    """Lower case, keep only a-z, 0-9 and blanks, and collapse runs of blanks."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9" + BLANK[1:], "")
    return strip(F.regexp_replace(kept, f"{BLANK}+", " "))


def split_words(c: Column) -> Column:
    """Words between runs of blanks, never empty ones."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any of the words occurs anywhere in the text."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def first_position(low: Column, needle: Column) -> Column:
    """0-based position of the first occurrence in a lower-case text ignoring case, or null."""
    at = F.position(F.lower(needle), low)
    return F.when(at > 0, at - 1)


def window_of(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The text around [start, end) with "..." where it was cut."""
    n = F.length(text)
    lo = F.greatest(F.lit(0), start - margin)
    hi = F.least(n, end + margin)
    return F.concat(
        F.when(lo > 0, F.lit("...")).otherwise(F.lit("")),
        F.substring(text, lo + 1, hi - lo),
        F.when(hi < n, F.lit("...")).otherwise(F.lit("")),
    )
