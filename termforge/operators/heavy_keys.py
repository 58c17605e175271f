"""Per-key results where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch over all rows. A broadcast join with that bounded list marks
their rows, which are spread over all tasks by their second key and aggregated in two steps; all other rows go by their
key. Both kinds travel in one exchange, so the input is read once for the sketch and once for the result, which is
complete: no row is dropped, sampled or capped.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.operators.live_index import clean_word, collapse, valid_postings

#: Counters of a sketch: at least, and the most that the function takes.
SKETCH_ITEMS, SKETCH_MOST = 8192, 1_000_000


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys that hold at least ``share`` of the rows: (key, estimate), at most 1.5 / share rows.

    Estimates are upper bounds, so no heavy key is missed; null keys are never heavy. An empty input gives no rows. The
    sketch has at least 4 / share counters, so that its error is below a third of share; a share for which it would
    need more than SKETCH_MOST is an error.
    """
    items = max(SKETCH_ITEMS, 1 << math.ceil(math.log2(4 / share)))
    if items > SKETCH_MOST:
        raise ValueError(f"share must be at least {4 / (1 << 19)}")
    col = f"`{key}`"
    got = df.where(F.col(col).isNotNull()).agg(F.expr(f"approx_top_k({col}, {min(int(2 / share) + 1, items)}, {items})").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = got.select(F.explode("top").alias("t"), "n").select(F.col("t.item").alias(key), F.col("t.count").alias("estimate"), "n").where(F.col("estimate") >= F.greatest(F.col("n") * F.lit(share), F.lit(2))).collect()
    schema = df.select(key).schema.add("estimate", T.LongType())
    return df.sparkSession.createDataFrame([(r[0], r[1]) for r in rows], schema)


def split_by_weight(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows, those with a null key among them); heavy has at most some hundred rows."""
    keys = F.broadcast(heavy.select(key))
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def word_stats(postings: DataFrame, tombstones: DataFrame, share: float | None = None) -> DataFrame:
    """For every word of the live index: (word, reviews, mentions), its live reviews and mentions.

    A word is heavy from a quarter of what a task gets on the average, unless ``share`` says otherwise. Null words, null
    rids and freq below 1 don't count; replays count once; words of deleted reviews only vanish. Ties can't arise; empty
    tables give an empty result; extra columns are ignored.
    """
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(postings.where(F.col("freq") > 0).select(clean_word().alias("word")), "word", share or max(1 / (4 * tasks), 4 / (1 << 19)))
    marked = valid_postings(postings, tombstones).join(F.broadcast(heavy.select("word", F.lit(True).alias("hot"))), "word", "left")
    # a heavy word fills all tasks, any other word is in one of them
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rid"), F.lit(tasks))).otherwise(0)
    pairs = collapse(marked.withColumn("salt", salt).repartition("word", "salt"), "salt")
    # what is left to shuffle is one row for each word and task
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("reviews"), F.sum("freq").alias("mentions"))


def frequent_words(stats: DataFrame, share: float) -> DataFrame:
    """Words whose reviews are at least ``share`` of all (word, rid) pairs."""
    pairs = stats.agg(F.sum("reviews")).first()[0] or 0
    least = math.ceil(Fraction(str(share)) * pairs)  # exact, as 0.028 isn't in binary
    return stats.where(F.col("reviews") >= least).select("word")
