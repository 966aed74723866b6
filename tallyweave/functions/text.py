"""Column functions on descriptions: normal forms and the three scores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import RULES


def normalize_basic(c: Column) -> Column:
    """White space to single spaces, trimmed, in upper case; null stays null."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_enhanced(c: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The basic letters in upper case, then every rule in order, each everywhere and whatever the case.

    The rules stay native expressions, one `regexp_replace` each; those that are no valid pattern are left out. The text
    is in upper case before the first rule and patterns and replacements are too, so none needs to ignore the case.
    """
    def apply(text: Column, rule: tuple[str, str, str]) -> Column:
        _, pattern, with_ = rule
        try:
            re.compile(pattern)
        except re.error:
            return text
        return F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", with_))

    return F.trim(F.regexp_replace(reduce(apply, RULES if rules is None else rules, F.upper(c)), r"\s+", " "))


def edit_score(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of trimmed upper-case texts; 0 if either is null or blank."""
    return edit_of(plain(a), plain(b))


def plain(c: Column) -> Column:
    """The form in which texts are compared letter by letter; null for a blank text."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def edit_of(x: Column, y: Column) -> Column:
    """The edit score of two texts in plain form."""
    return F.coalesce(F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)), F.lit(0.0))


def tokens(c: Column) -> Column:
    """The distinct upper-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Za-z0-9 ]", " "), " +"), lambda w: w != ""))


def jaccard_of(x: Column, y: Column) -> Column:
    """Shared tokens over all tokens of two token arrays; 0 if either is null or both are empty."""
    union = F.size(F.array_union(x, y))
    return F.coalesce(F.when(union > 0, F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1))), F.lit(0.0))


def jaccard_score(a: Column, b: Column) -> Column:
    return jaccard_of(tokens(a), tokens(b))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two vectors in double precision; null if either is null or zero."""
    dot = lambda a, b: F.reduce(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
