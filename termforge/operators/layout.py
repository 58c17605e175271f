"""Where the flushes of a logarithmically merged index end up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators.numbering import running


def flush_numbers(postings: DataFrame, capacity: int, first: int = 0) -> DataFrame:
    """postings with ``flush``: the number of the flush that each goes to, in order of (rid, term), capacity rows each."""
    numbered = running(postings, ["rid", "term"], number="_at")
    return numbered.withColumn("flush", F.expr(f"_at div {capacity}") + F.lit(first)).drop("_at")


def level(flush: Column, flushes: Column) -> Column:
    """Level of a flush after so many flushes: the highest bit in which the two numbers differ."""
    return (F.length(F.bin(flush.bitwiseXOR(flushes))) - 1).cast("bigint")


def live_levels(flushes: int) -> list[tuple[int, int]]:
    """(level, first flush) of each segment after so many flushes, largest first: one for each bit set."""
    out, start = [], 0
    for k in range(flushes.bit_length() - 1, -1, -1):
        if flushes >> k & 1:
            out.append((k, start))
            start += 1 << k
    return out


def clears(before: int, after: int) -> bool:
    """Whether all segments were merged into one on the way: a power of two from 2 on was passed."""
    return after >= 2 and after.bit_length() > max(before, 1).bit_length()
