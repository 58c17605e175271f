"""The live index: flushed posting rows without replays, bad rows and deleted reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.session import sized

#: Characters that count as blanks around a word.
BLANKS = " \t\n\r\f\x0b"


def clean_word(column: str = "word"):
    """The word in lower case without blanks around."""
    return F.lower(F.trim(F.col(column), F.lit(BLANKS)))


def valid_postings(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows that may count: (word, rid, freq, flush_id) with a word, a rid, a positive freq and a review that isn't deleted.

    A row with a null word, rid or freq, or freq <= 0, is left out; other columns of the input are ignored. The
    deleted rids are broadcast only after they were counted.
    """
    dead = tombstones.select("rid").where(F.col("rid").isNotNull()).distinct()
    return (
        postings.where(F.col("word").isNotNull() & F.col("rid").isNotNull() & (F.col("freq") > 0))
        .select(clean_word().alias("word"), F.col("rid").cast("bigint").alias("rid"), F.col("freq").cast("bigint").alias("freq"), F.col("flush_id").cast("bigint").alias("flush_id"))
        .join(sized(dead), "rid", "left_anti")
    )


def collapse(valid: DataFrame, *more: str) -> DataFrame:
    """(word, rid, freq): one of the rows alike in word, rid and flush_id (the largest freq), then the sum per word and rid.

    ``more`` are columns that follow from word and rid. If the input is partitioned by some of these, word and rid,
    neither aggregation shuffles.
    """
    once = valid.groupBy("word", "rid", *more, "flush_id").agg(F.max("freq").alias("freq"))
    return once.groupBy("word", "rid", *more).agg(F.sum("freq").alias("freq"))
