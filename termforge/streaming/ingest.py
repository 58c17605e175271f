"""Inserting a stream of reviews: every micro-batch is one insert, committed once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termforge.index.writer import _Writer


def insert_stream(stream: DataFrame, writer: _Writer, checkpoint: str) -> StreamingQuery:
    """Start a query that inserts each micro-batch of reviews (seq, product_id, ..., text) and ends when all is read.

    A batch that comes again after a failure is recognised by its number, which is part of the commit.
    """
    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            writer.insert_once(batch, stream_id, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
