"""Running numbers, running sums and gaps over a whole table without a window that one key or one task could fill.

The rows are range-partitioned and sorted once. What depends on the rows before is computed within each partition, in
the same pass, and kept with the rows; what a partition needs from those before it follows from one small row of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from termforge.session import stored

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition; those above number the partitions.
ROW_BITS = 33


def ordered(df: DataFrame, order: list[str], run=None, added: dict[str, T.DataType] | None = None) -> DataFrame:
    """df in order over its partitions, kept, with ``_part`` and ``_row``; run sees each sorted partition and adds columns."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if run:
        rows = rows.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))
    kept = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    row = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return kept.withColumn("_part", F.shiftright("_id", ROW_BITS)).withColumn("_row", row).drop("_id")


def _with(batch: pa.RecordBatch, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns.values())], names=[*batch.schema.names, *columns])


def _sums(new: dict[str, str]):
    """Sums of the rows before, within the partition, and each row's own value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(new, 0)
        for batch in batches:
            out = {}
            for name, old in new.items():
                own = batch.column(old).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(own) + total[name]
                out[f"_s_{name}"], total[name] = upto - own, int(upto[-1]) if len(own) else total[name]
            yield _with(batch, out)

    return run


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """df with, for each new: old of ``sums``, the sum of old over all rows before; and ``number``, from 0, the row's place.

    The order must be total for a defined result; rows that tie are numbered in any order. Nulls in old count as 0.
    One shuffle, and one table in the work folder.
    """
    sums = sums or {}
    placed = ordered(df, order, _sums(sums) if sums else None, {f"_s_{n}": T.LongType() for n in sums})
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), *(F.coalesce(F.sum(old), F.lit(0)).cast("bigint").alias(f"_t_{new}") for new, old in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_oc"), *(F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_o_{new}") for new in sums))
    both = placed.join(F.broadcast(offsets), "_part")
    out = {new: (F.col(f"_s_{new}") + F.col(f"_o_{new}")).cast("bigint") for new in sums}
    if number:
        out[number] = (F.col("_row") + F.col("_oc")).cast("bigint")
    return both.select(*df.columns, *(c.alias(k) for k, c in out.items()))


def _neighbours(batch: pa.RecordBatch, last: str | None) -> np.ndarray:
    """Whether each row has the term of the row before; last: the term before the batch."""
    term = batch.column("term")
    same = np.zeros(batch.num_rows, bool)
    same[1:] = np.asarray(pc.equal(term.slice(1), term.slice(0, batch.num_rows - 1)))
    same[0] = last is not None and term[0].as_py() == last
    return same


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, before = None, 0
    for batch in batches:
        if batch.num_rows:
            rid = batch.column("rid").to_numpy()
            gap = rid - np.where(_neighbours(batch, last), np.concatenate([[before], rid[:-1]]), 0)
            last, before = batch.column("term")[-1].as_py(), int(rid[-1])
            yield _with(batch, {"_gap": gap})


def gap_encode(postings: DataFrame) -> DataFrame:
    """(term, rid, freq, gap, at) of postings: each rid less the one before it in its term's list, the first whole; at: the row's place.

    Lists are in order of rid, whatever their length: a list that reaches over partitions goes on from the last row of
    the partition before. Terms and rids are not null.
    """
    rows = postings.select("term", F.col("rid").cast("bigint").alias("rid"), F.col("freq").cast("bigint").alias("freq"))
    placed = ordered(rows, ["term", "rid"], _gaps, {"_gap": T.LongType()})
    borders = placed.groupBy("_part").agg(F.max(F.struct("term", "rid")).alias("k"), F.count(F.lit(1)).alias("n"))
    parts = Window.orderBy("_part")  # one row for each partition
    borders = borders.select("_part", F.lag("k").over(parts).alias("k"), F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    goes_on = (F.col("_row") == 0) & F.col("k.term").eqNullSafe(F.col("term"))
    gap = F.when(goes_on, F.col("rid") - F.col("k.rid")).otherwise(F.col("_gap"))
    return placed.join(F.broadcast(borders), "_part").select("term", "rid", "freq", gap.alias("gap"), (F.col("n") + F.col("_row")).alias("at"))


def _ungaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, before = None, 0
    for batch in batches:
        if batch.num_rows:
            same = _neighbours(batch, last)
            upto = np.cumsum(batch.column("gap").to_numpy())
            first = np.flatnonzero(~same)
            start = np.concatenate([[0], upto])[first]  # the sum before each list that begins here
            which = np.cumsum(~same) - 1
            rid = upto - np.where(which < 0, -before, start[np.maximum(which, 0)] if len(start) else 0)
            last, before = batch.column("term")[-1].as_py(), int(rid[-1])
            yield _with(batch, {"_rid": rid})


def gap_decode(coded: DataFrame) -> DataFrame:
    """(term, rid, freq) of what ``gap_encode`` gave: sums of the gaps of each term in order of ``at``."""
    placed = ordered(coded.select("term", F.col("gap").cast("bigint").alias("gap"), "freq", "at"), ["at"], _ungaps, {"_rid": T.LongType()})
    ends = placed.groupBy("_part").agg(F.min_by("term", "at").alias("first"), F.max_by(F.struct("term", "_rid"), "at").alias("end"))
    # a partition's first list goes on with the sum that the partitions before it, in whose last list it is, add up to
    events = ends.select("_part", F.col("first").alias("t"), F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("kind")).unionByName(ends.select("_part", F.col("end.term").alias("t"), F.col("end._rid").alias("v"), F.lit(1).alias("kind")))
    carried = events.withColumn("carry", F.sum("v").over(Window.partitionBy("t").orderBy("_part", "kind"))).where("kind = 0").select("_part", F.col("t").alias("first"), "carry")
    rid = F.col("_rid") + F.when(F.col("term") == F.col("first"), F.col("carry")).otherwise(0)
    return placed.join(F.broadcast(carried), "_part").select("term", rid.alias("rid"), "freq")
