"""The canonical form of a text: what is left of it if formatting doesn't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What cuts sections, what isn't a letter or digit, how a labelled section begins, a word.
SECTION_END = r"[|;\n\r]+"
NO_LETTER = r"[^\p{L}\p{N}]+"
LABEL = r"^[^\p{L}\p{N}:]*[\p{L}\p{N}]+[^\p{L}\p{N}:]*:"
WORD = r"[\p{L}\p{N}]+"
NOT_BLANK = r"[^\s\p{Z}\x{85}\x0b]"


def canonical_text(text: Column, runs: Column | None = None) -> Column:
    """Letters and digits of the text in lower case; labelled sections, if it has nothing else, in sorted order.

    A label is one word and a colon; marks around the word don't count. Null stays null; a text without letters and
    digits gives an empty string. runs: ``word_runs`` of the text, where they are there already.
    """
    lower = F.lower(text)
    bare = lambda x: F.regexp_replace(x, NO_LETTER, "")
    sections = F.filter(F.split(lower, SECTION_END), lambda x: x.rlike(NOT_BLANK))
    # most texts have no colon, and are not cut at all
    labelled = lower.contains(":") & (F.size(sections) > 1) & F.forall(sections, lambda x: x.rlike(LABEL))
    return F.when(labelled, F.array_join(F.array_sort(F.transform(sections, bare)), "")).otherwise(bare(lower) if runs is None else F.array_join(runs, ""))


def word_runs(text: Column) -> Column:
    """Runs of letters and digits of the text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Distinct runs of letters and digits of the text in lower case."""
    return F.array_distinct(word_runs(text))
