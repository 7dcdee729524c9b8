"""The term pipeline as Spark expressions, so that it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate terms, and the white space of Unicode's White_Space property.
DIGITS = "0123456789"
SEPARATORS = "',.()\\/_-!:;#@%^&*{}[]+=~?\"№"
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LEAST_LETTERS = 3


def blank_to_null(column: Column | str) -> Column:
    """Trims blanks; an empty id is no id."""
    return F.nullif(F.trim(F.col(column) if isinstance(column, str) else column), F.lit(""))


def pieces(text: Column | str) -> Column:
    """What is left of a text between separators and white space, in lower case and without digits; some pieces are empty.

    One pass over the characters; the split is at single blanks. A null text gives null.
    """
    text = F.col(text) if isinstance(text, str) else text
    blanks = SEPARATORS + WHITE_SPACE
    return F.split(F.lower(F.translate(text, blanks + DIGITS, " " * len(blanks))), " ")


def is_term(word: Column | str, stopwords: list[str] | None = None) -> Column:
    """Whether a piece has three letters or more and is no stop word."""
    word = F.col(word) if isinstance(word, str) else word
    long_enough = F.char_length(word) >= LEAST_LETTERS
    return long_enough & ~word.isin(sorted(set(stopwords))) if stopwords else long_enough


def all_terms(text: Column | str) -> Column:
    """Terms with repeats: digits deleted, lower case, split at separators and white space, three letters or more.

    A null text has no terms, as an empty one.
    """
    return content_terms(text, [])


def content_terms(text: Column | str, stopwords: list[str]) -> Column:
    """`all_terms` without the stop words. Where terms become rows anyway, filter `pieces` by `is_term` after exploding."""
    return F.coalesce(F.filter(pieces(text), lambda w: is_term(w, stopwords)), F.array().cast("array<string>"))
