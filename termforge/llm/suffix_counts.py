"""Occurrences and record counts of all n-grams from a distributed suffix array.

Every position of a record gives a suffix, cut off after the longest n. Suffixes are sorted over the whole collection
by range partitions of (suffix, record), so that a frequent term spreads over many tasks. In the sorted array an
n-gram is an interval of neighbours whose common prefix has at least n terms: its width (by weight) is the number of
occurrences, and its rows less the neighbours that come from the same record are the number of records. Intervals that
reach a border of a batch are put together afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators.live_index import valid_postings


def _same(a: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; two nulls don't."""
    return np.asarray(pc.equal(a.slice(1), a.slice(0, len(a) - 1)).fill_null(False))


def _intervals(n_max: int):
    words = [f"w{k}" for k in range(1, n_max + 1)]
    out = pa.schema([("n", pa.int32()), *((w, pa.string()) for w in words), ("record", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            columns = [rows.column(c).combine_chunks() for c in rows.column_names]
            last = batch.slice(batch.num_rows - 1)
            ahead = rows.num_rows - batch.num_rows  # the row before this batch, seen already
            # common prefix with the row before: prefix[k] says that it has more than k words
            prefix, equal = [], np.ones(max(rows.num_rows - 1, 0), bool)
            for column in columns[:n_max]:
                equal = equal & _same(column)
                prefix.append(np.concatenate([[False], equal]))
            record, part, weight = (np.asarray(columns[n_max + k]).astype(np.int64) for k in range(3))
            there = [np.asarray(pc.is_valid(c)) for c in columns[:n_max]]
            whole = np.concatenate([[False], np.ones(max(rows.num_rows - 1, 0), bool)])
            for k in range(n_max):  # the same suffix again, also where both end early
                both_end = np.concatenate([[False], ~there[k][1:] & ~there[k][:-1]])
                whole &= prefix[k] | both_end
            one_record = np.concatenate([[False], record[1:] == record[:-1]])
            replay = whole & one_record & np.concatenate([[False], part[1:] == part[:-1]])
            weight = np.where(replay, 0, weight)
            for n in range(1, n_max + 1):
                run_of = np.cumsum(~prefix[n - 1])
                keep = there[n - 1].copy()
                keep[:ahead] = False
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                runs = run_of[at]
                if n == n_max:  # records are in order within an interval: neighbours tell
                    fresh = ~(prefix[n - 1] & one_record)[at]
                    first = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1))
                    records, occurrences = np.add.reduceat(fresh.astype(np.int64), first), np.add.reduceat(weight[at], first)
                    detail = np.full(len(first), False)
                    firsts = at[first]
                else:  # put the records of each interval in order, then neighbours tell
                    order = np.lexsort((record[at], runs))
                    r, d, w, where = runs[order], record[at][order], weight[at][order], at[order]
                    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])])
                    # intervals at the borders of the batch come out by record, to be joined with their other parts
                    open_ = (r == run_of[at[0]]) | (r == run_of[-1]) | (r == run_of[0])
                    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1])]) | (open_ & fresh))
                    records, occurrences = np.add.reduceat(fresh.astype(np.int64), first), np.add.reduceat(w, first)
                    detail, firsts = open_[first], where[first]
                take = pa.array(firsts)
                shown = [columns[k].take(take) if k < n else pa.nulls(len(firsts), pa.string()) for k in range(n_max)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(firsts), n, np.int32)), *shown, pa.array(record[firsts], mask=~detail), pa.array(occurrences), pa.array(records)], schema=out)

    schema = "n int, " + ", ".join(f"{w} string" for w in words) + ", record bigint, occurrences bigint, records bigint"
    return run, schema, words


def count_suffixes(suffixes: DataFrame, n_max: int) -> DataFrame:
    """(n, w1..w{n_max}, occurrences, records) of suffix rows (w1..w{n_max}, record, part, weight).

    Rows alike in suffix, record and part are replays; the heaviest counts. Words after the end of a record are null.
    """
    run, schema, words = _intervals(n_max)
    order = [*words, "record"]
    rows = suffixes.select(*order, F.col("part").cast("bigint").alias("part"), F.col("weight").cast("bigint").alias("weight"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "part", F.col("weight").desc())
    found = sorted_rows.mapInArrow(run, schema)
    key = ["n", *words]
    if n_max > 1:
        whole = found.where("record IS NULL").groupBy(*key).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        parts = found.where("record IS NOT NULL").groupBy(*key, "record").agg(F.sum("occurrences").alias("occurrences"))
        found = whole.unionByName(parts.groupBy(*key).agg(F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("records")))
    return found.groupBy(*key).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def ngram_counts(records: DataFrame, id_col: str, words_col: str, n_max: int) -> DataFrame:
    """(n, w1..w{n_max}, occurrences, records) of all n-grams, up to n_max words, of an array column of words.

    Rows of one id are one record; null or empty arrays, null ids and null words have no n-grams of their own (a null
    word ends the suffix). Extra columns are ignored; an empty table gives an empty result.
    """
    seen = records.select(F.col(id_col).cast("bigint").alias("record"), F.posexplode(words_col).alias("at", "w1"), F.col(words_col).alias("all"), F.monotonically_increasing_id().alias("row")).where("record IS NOT NULL AND w1 IS NOT NULL")
    later = [F.get("all", F.col("at") + k).alias(f"w{k + 1}") for k in range(1, n_max)]
    rows = seen.select("record", "w1", *later, F.xxhash64("row", "at").alias("part"), F.lit(1).alias("weight"))
    for k in range(3, n_max + 1):  # nothing comes after the end
        rows = rows.withColumn(f"w{k}", F.when(F.col(f"w{k - 1}").isNotNull(), F.col(f"w{k}")))
    return count_suffixes(rows, n_max)


def word_counts(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(word, mentions, reviews) of every word of the live index; the index's rows are suffixes of one word.

    Null words and rids, freq below 1 and deleted reviews don't count, replays count once; empty tables give an empty
    result; extra columns are ignored.
    """
    valid = valid_postings(postings, tombstones)
    suffixes = valid.select(F.col("word").alias("w1"), F.col("rid").alias("record"), F.coalesce("flush_id", F.lit(-1)).alias("part"), F.col("freq").alias("weight"))
    return count_suffixes(suffixes, 1).select(F.col("w1").alias("word"), F.col("occurrences").alias("mentions"), F.col("records").alias("reviews"))


def live_reviews(postings: DataFrame, tombstones: DataFrame) -> int:
    """The number of reviews with a valid row."""
    return valid_postings(postings, tombstones).select("rid").distinct().count()


def marked_words(counts: DataFrame, reviews: int, rare: int = 2, common: float = 0.2) -> DataFrame:
    """counts with a column mark: ``rare`` up to that many reviews, else ``common`` from that share of the reviews on, else null."""
    least = math.ceil(Fraction(str(common)) * reviews)  # exact, as 0.2 isn't in binary
    mark = F.when(F.col("reviews") <= rare, "rare").when(F.col("reviews") >= least, "common")
    return counts.withColumn("mark", mark)
