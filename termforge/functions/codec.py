"""Codes of the inverted index as column expressions: length-tagged integers, front coding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest number a code of 1, 2, 3 or 4 bytes can hold, and the tag in its two upper bits.
LIMITS = (63, 16383, 4194303, 1073741823)
TAGS = (0, 16384, 8388608, 3221225472)
#: Fixed value: terms of a dictionary block.
BLOCK_TERMS = 8


def varint_length(value: Column) -> Column:
    """Bytes of the code of a number from 0 to LIMITS[-1]; null outside."""
    size = F.when(value < 0, None)
    for n, limit in enumerate(LIMITS, 1):
        size = size.when(value <= limit, n)
    return size.cast("bigint")


def varint_encode(value: Column) -> Column:
    """Big-endian bytes with the number of bytes, less one, in the two upper bits; null outside the range."""
    code = F.when(value < 0, None)
    for n, (limit, tag) in enumerate(zip(LIMITS, TAGS, strict=True), 1):
        code = code.when(value <= limit, F.unhex(F.lpad(F.hex(value.cast("bigint").bitwiseOR(F.lit(tag).cast("bigint"))), 2 * n, "0")))
    return code


def _decoded(streams: Iterator[pd.Series], sums: bool) -> Iterator[pd.Series]:
    for series in streams:
        blobs = [bytes(x) if x is not None else None for x in series]
        data = np.frombuffer(b"".join(x or b"" for x in blobs), np.uint8)
        size = np.array([len(x or b"") for x in blobs], np.int64)
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(data))
        length = (data >> 6).astype(np.int64) + 1
        # a code begins where a chain of codes from the start of its stream leads: the chains are followed in doubling steps
        hop = np.append(np.where(at + length < end, at + length, len(data)), len(data))
        begins = np.zeros(len(data) + 1, bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        while True:
            reached = hop[np.flatnonzero(begins)]
            if begins[reached].all():
                break
            begins[reached] = True
            hop = hop[hop]
        begin = np.flatnonzero(begins[:-1])
        if (begin + length[begin] > end[begin]).any():
            raise ValueError("truncated code")
        value = (data[begin] & 63).astype(np.int64)
        for k in range(1, len(LIMITS)):
            more = np.flatnonzero(length[begin] > k)
            value[more] = value[more] * 256 + data[begin[more] + k]
        cuts = np.searchsorted(begin, np.cumsum(size) - size), np.searchsorted(begin, np.cumsum(size))
        lists = (value[a:b] for a, b in zip(*cuts, strict=True))
        yield pd.Series([None if x is None else np.cumsum(v) if sums else v for x, v in zip(blobs, lists, strict=True)], dtype=object)


def _values(streams: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _decoded(streams, False)


def _running(streams: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _decoded(streams, True)


def varint_decode(stream: Column) -> Column:
    """The numbers of a stream of codes as an array, null for null; a stream that ends inside a code raises an error."""
    return F.pandas_udf(_values, T.ArrayType(T.LongType()))(stream)


def varint_decode_sums(stream: Column | str) -> Column:
    """The running sums of the numbers of a stream: the rids of a coded list of gaps."""
    return F.pandas_udf(_running, T.ArrayType(T.LongType()))(stream)


def int_bytes(value: Column) -> Column:
    """Four big-endian bytes of a number from 0 to 2^32 - 1; null outside."""
    return F.when(value.between(0, (1 << 32) - 1), F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0")))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that a and b have in common at their start."""
    both = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), both), lambda i: (i > 0) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(same).cast("bigint")


def front_suffix(term: Column, prefix: Column) -> Column:
    """What is left of a term after the prefix that it shares with the first of its block."""
    return F.substring(term, (prefix + 1).cast("int"), F.length(term))
