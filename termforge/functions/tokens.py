"""Terms of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates terms (anything but letters and decimal digits of the basic plane), the longest term.
TOKEN_SEP = r"[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}]"
#: The same as one class of characters, which a run of any length matches without recursion.
TOKEN_SEPS = r"[[^\p{L}\p{Nd}]\x{10000}-\x{10FFFF}]+"
MAX_TERM = 127


def spaced(text: Column) -> Column:
    """The tokens in lower case, in text order, one blank between each two; null gives an empty string."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), TOKEN_SEPS, " ")))


def raw_tokens(text: Column) -> Column:
    """All tokens in lower case, in text order; null gives an empty array."""
    tokens = spaced(text)
    return F.when(tokens == "", F.array().cast("array<string>")).otherwise(F.split(tokens, " "))


def sorted_tokens(text: Column) -> Column:
    return F.array_sort(raw_tokens(text))


def terms(text: Column) -> Column:
    """Tokens that are kept: at most MAX_TERM characters."""
    return F.filter(raw_tokens(text), lambda x: F.length(x) <= MAX_TERM)


def raw_length(text: Column) -> Column:
    """Number of all tokens."""
    tokens = spaced(text)
    every = F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit(""))) + 1
    return F.when(tokens == "", 0).otherwise(every).cast("bigint")


def text_length(text: Column) -> Column:
    """Number of kept tokens."""
    tokens = spaced(text)
    too_long = F.when(F.length(tokens) > MAX_TERM, F.regexp_count(tokens, F.lit(f"[^ ]{{{MAX_TERM + 1},}}"))).otherwise(0)
    return (raw_length(text) - too_long).cast("bigint")
