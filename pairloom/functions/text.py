"""Text normalisation and tokens, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there, also within functions of elements."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """White space runs become one space; ends are trimmed; case stays."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Squeezed, lower case, with the Cyrillic io written as ie."""
    return F.translate(F.lower(squeeze(text)), "ё", "е")


def words_only(text: Column) -> Column:
    """Lower case with every run of characters that aren't word characters (in Unicode) turned into one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), r"(?U)[^\w]+", " "))


def alnum_only(text: Column) -> Column:
    """Lower case with runs of anything but Latin or Cyrillic letters and digits turned into one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), "[^0-9a-zа-я]+", " "))


def split_boundaries(text: Column) -> Column:
    """Folded text with letters and digits apart and punctuation dropped."""
    apart = F.regexp_replace(F.regexp_replace(fold(text), r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " "), r"[^\p{L}\p{N}]+", " ")
    return F.trim(apart)


def decimal_tokens(text: Column) -> Column:
    """Alphanumeric runs of the lower-cased text, with decimal commas as points, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ",", "."), F.lit(r"([0-9a-zа-я.]+)"), 1), " ")


def snake_case(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(text: Column) -> Column:
    """Distinct alphanumeric runs, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9a-zа-я]+)"), 1))


def long_tokens(text: Column) -> Column:
    """Tokens of three characters or more, and those with a digit."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))


def numbers(text: Column) -> Column:
    """Distinct numbers as written, decimal commas as points."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), ",", "."), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1))


def codes(text: Column) -> Column:
    """Tokens, hyphens removed, that hold letters and digits."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "-", ""), F.lit("([0-9a-zа-я]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: t.rlike("[0-9]") & t.rlike("[a-zа-я]")))


def slash_specs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+/[0-9]+)"), 1))


def _runs(length: Column, low: int, high: int, cut) -> Column:
    """``cut(start, n)`` for every start (from 1) and size of the runs within ``length``."""
    none = F.array().cast("array<string>")

    def of_size(n: int) -> Column:
        return F.when(length >= n, F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: cut(i, n))).otherwise(none)

    return F.concat(*(of_size(n) for n in range(low, high + 1)))


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by spaces."""
    return _runs(F.size(words), low, high, lambda i, n: F.array_join(F.slice(words, i, n), " "))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` characters of the text without its spaces."""
    bare = F.regexp_replace(text, " ", "")
    return _runs(F.length(bare), low, high, lambda i, n: F.substr(bare, i, F.lit(n)))


def padded_char_ngrams(text: Column, low: int, high: int) -> Column:
    """Runs of characters within each word padded by one space on either side, never across words."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return _runs(F.length(padded), low, high, lambda i, n: F.substr(padded, i, F.lit(n)))

    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), of_word))
