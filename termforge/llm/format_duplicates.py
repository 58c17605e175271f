"""Texts that differ in formatting only, collapsed into one with the number of copies.

Every text gives a hash of its canonical form. Each task keeps one pair of Bloom filters over its hashes, of the bits hit
once and of those hit again; pairs are merged over tasks block by block: a bit is repeated if a task has it so or if two
tasks have it, so that no repeated text is missed. Bits travel as sorted places, about two bytes each. Only texts all
of whose bits are repeated can have copies, and only they are shuffled for exact grouping; all others come out as
singletons. Hashes are treated in ranges, one after the other, such that the filter of a range has a stated size: it is
broadcast at any number of texts, and neither the other texts nor their hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.canonical import canonical_text
from termforge.session import join_groups, stored, work_path

#: Bits of the filter for each text; bits of a block; bytes of the filter that is broadcast at a time.
TEXT_BITS, BLOCK_BITS, FILTER_BYTES = 16, 1 << 21, 32 << 20
#: Bits that a hash sets in its block, by where in the hash they begin.
SHIFTS = (22, 43)
#: Places kept by a task before those that are alike are put together; steps between places that take two bytes.
HELD, STEP = 1 << 22, 65535


def block_number(texts: int) -> int:
    return max(1, -(-texts * TEXT_BITS // BLOCK_BITS))


def pack_places(at: np.ndarray) -> bytes:
    """Ascending numbers below BLOCK_BITS as steps of two bytes; a step of STEP leads to no number."""
    gap = np.diff(at, prepend=0)
    ends = np.cumsum(gap // STEP + 1) - 1
    out = np.full(ends[-1] + 1 if len(at) else 0, STEP, np.uint16)
    out[ends] = gap % STEP
    return out.tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step.astype(np.int64))[step != STEP]


PARTIAL = pa.schema([("block", pa.int64()), ("bit", pa.binary()), ("again", pa.binary())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, hash) of a task: for each block the bits that were hit, and which of them again."""
    bit, again = np.zeros(0, np.int64), np.zeros(0, bool)
    new: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([bit, *new])
        order = np.argsort(every, kind="stable")
        places = every[order]
        first = np.flatnonzero(np.diff(places, prepend=-1))
        more = np.concatenate([again, np.zeros(len(every) - len(again), bool)])[order]
        hits = np.diff(np.append(first, len(every)))
        new.clear()
        return places[first], np.logical_or.reduceat(more, first) | (hits > 1) if len(first) else again

    for batch in batches:
        block, u = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        new += [block * BLOCK_BITS + ((u >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in SHIFTS]
        if sum(map(len, new)) > HELD:
            bit, again = merged()
    if new:
        bit, again = merged()
    owner = bit // BLOCK_BITS
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(first, np.append(first, len(bit))[1:], strict=True):
        row = [owner[a], pack_places(bit[a:b] % BLOCK_BITS), np.packbits(again[a:b]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PARTIAL, strict=True)], schema=PARTIAL)


FILTER = pa.schema([("block", pa.int64()), ("bits", pa.list_(pa.int64()))])


def _merge(table: pa.Table) -> pa.Table:
    once, again = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for bit, more in zip(table.column("bit"), table.column("again"), strict=True):  # one row for each task
        at = unpack_places(bit.as_py())
        again[at] |= once[at] | np.unpackbits(np.frombuffer(more.as_py(), np.uint8), count=len(at)).astype(bool)
        once[at] = True
    if not again.any():
        return FILTER.empty_table()
    longs = np.packbits(again, bitorder="little").view(np.int64)
    return pa.table([table.column("block").slice(0, 1), pa.array([longs], pa.list_(pa.int64()))], schema=FILTER)


def repeat_filter(hashes: DataFrame) -> DataFrame:
    """(block, bits): of rows (block, hash), the bits hit at least twice, as longs; blocks without any are left out."""
    partial = hashes.select("block", "hash").mapInArrow(_pairs, "block bigint, bit binary, again binary")
    return partial.groupBy("block").applyInArrow(_merge, "block bigint, bits array<bigint>")


def with_block(hashes: DataFrame, number: int) -> DataFrame:
    return hashes.withColumn("block", F.pmod("hash", F.lit(block_number(number))))


def possible_repeats(hashes: DataFrame, number: int) -> DataFrame:
    """hashes (hash, ...) with a column ``maybe``: false if the row's hash is surely the only one of its kind.

    hashes is read twice for each range of blocks whose filter has FILTER_BYTES; number: its rows. With several ranges,
    hashes should be in order of ``with_block`` within its files, so that each range reads its own part.
    """
    blocks, at_once = block_number(number), max(1, FILTER_BYTES * 8 // BLOCK_BITS)

    def hit(shift: int):
        bit = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        return F.getbit(F.element_at("bits", F.shiftright(bit, 6) + 1), bit.bitwiseAND(F.lit(63))) == 1

    rows = hashes if "block" in hashes.columns else with_block(hashes, number)

    def marked(own: DataFrame) -> DataFrame:
        known = own.join(F.broadcast(repeat_filter(own)), "block", "left")
        return known.withColumn("maybe", F.col("bits").isNotNull() & reduce(lambda a, b: a & b, map(hit, SHIFTS))).drop("bits", "block")

    if blocks <= at_once:
        return marked(rows)
    path = work_path(hashes.sparkSession, "maybe")
    schema = None
    for first in range(0, blocks, at_once):  # one filter at a time
        part = marked(rows.where(F.col("block").between(first, first + at_once - 1)))
        schema = part.schema
        part.write.option("compression", "zstd").parquet(f"{path}/{first}")
    return hashes.sparkSession.read.schema(schema).parquet(*(f"{path}/{first}" for first in range(0, blocks, at_once)))


def _split(reviews: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, exact) of texts with possible copies, ids of sure singletons, ids of texts without letters; exact: SHA-256 of the canonical text"""
    text = canonical_text(F.col(text_col))
    rows = reviews.select(F.col(id_col).cast("bigint").alias("id"), F.when(text != "", text).alias("text")).where("id IS NOT NULL")
    rows = stored(rows.select("id", F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("exact")), "hashes")
    full = rows.where("exact IS NOT NULL")
    number = full.count()
    if block_number(number) * BLOCK_BITS > FILTER_BYTES * 8:
        full = stored(with_block(full, number).sortWithinPartitions("block"), "blocks")
    marked = possible_repeats(full, number)
    return marked.where("maybe").select("id", "exact").distinct(), marked.where("NOT maybe").select("id"), rows.where("exact IS NULL").select("id").distinct()


def collapse(reviews: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(id, copies): the smallest id of each text and the number of distinct ids that have it.

    Rows of one id with one text are one delivery. Texts that are null or have no letter or digit are nobody's copy:
    each of their ids comes out with 1. Rows with a null id are left out. An empty table gives an empty result; extra
    columns are ignored. Texts are the same if the SHA-256 hashes of their canonical forms are.
    """
    maybe, single, bare = _split(reviews, id_col, text_col)
    grouped = maybe.groupBy("exact").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies")
    alone = single.unionByName(bare).select("id", F.lit(1).cast("bigint").alias("copies"))
    return grouped.unionByName(alone).withColumnRenamed("id", id_col)


def copies(reviews: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b): each further id of a text, with the smallest; input cases as in ``collapse``."""
    maybe = stored(_split(reviews, id_col, text_col)[0], "maybe")
    groups = stored(maybe.groupBy("exact").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    both = join_groups(maybe, groups, "exact")
    return both.where(F.col("id") != F.col("a")).select(F.col("a").alias(f"{id_col}_a"), F.col("id").alias(f"{id_col}_b"))
