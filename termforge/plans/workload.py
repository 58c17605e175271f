"""The maintenance workload: build, insert file after file, delete and query in between, then merge; timed."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.index.reader import IndexReader
from termforge.index.writer import LogMergeWriter, SimpleMergeWriter
from termforge.session import durable, table, work_path
from termforge.sources import reviews as source

#: Reviews deleted after each insert, and words asked for.
DELETES, WORDS = 10, 50
#: Rows of the memtable, one run of the log-merge strategy each.
MEMTABLES = (1024, 8192, 65536, 524288, 4194304, 33554432)

Row = tuple[str, int, int, str, float]


def prepare(spark: SparkSession, sf_dir: str, inserts: int) -> tuple[str, list[str]]:
    """(first build, files to insert in order): dumps of the documents table, 40 % of it and equal parts of the rest."""
    dealt = durable(source.batches(source.from_documents(table(spark, sf_dir, "documents")), inserts))
    folder = work_path(spark, "workload")
    source.write_dump(dealt.where("batch = 0"), f"{folder}/first_build")
    for k in range(1, inserts + 1):
        source.write_dump(dealt.where(F.col("batch") == k), f"{folder}/insertions/{k}_part")
    return f"{folder}/first_build", source.insert_files(spark, f"{folder}/insertions")


def run(spark: SparkSession, first_build: str, insertions: Sequence[str], words: Sequence[str], memtables: Sequence[int] = MEMTABLES) -> list[Row]:
    """(strategy, memtable, step, metric, value) of both strategies on the same files; step 0 is the first build, the last one of ``simple`` the merge."""
    out: list[Row] = []
    for name, capacity in [("simple", 0), *(("log", c) for c in memtables)]:
        root = work_path(spark, f"workload-{name}")
        writer = SimpleMergeWriter(spark, root) if name == "simple" else LogMergeWriter(spark, root, capacity)

        def timed(step: int, metric: str, what, own=(name, capacity)) -> None:
            began = time.time()
            what()
            out.append((*own, step, metric, round((time.time() - began) * 1000, 1)))

        def measured(step: int, own=(name, capacity), root=root) -> IndexReader:
            reader = IndexReader(spark, root)
            if words:
                began = time.time()
                for word in words:
                    reader.term(word).write.format("noop").mode("overwrite").save()
                out.append((*own, step, "query_ms", round((time.time() - began) * 1000 / len(words), 1)))
            found = {"bytes": reader.disk_bytes(), "segments": reader.segment_count(), "reviews": reader.reviews_indexed()}
            out.extend((*own, step, metric, float(value)) for metric, value in found.items())
            return reader

        timed(0, "construct_ms", lambda w=writer: w.construct(first_build))
        measured(0)
        for k, path in enumerate(insertions, 1):
            timed(k, "insert_ms", lambda w=writer, p=path: w.insert(p))
            live = IndexReader(spark, root).meta().select("rid")
            writer.remove(live.orderBy(F.xxhash64("rid", F.lit(k)), "rid").limit(DELETES))
            measured(k)
        if name == "simple":
            timed(len(insertions) + 1, "merge_ms", writer.compact)
            measured(len(insertions) + 1)
        writer.catalog.drop()
    return out


def results(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """The measurements as a table."""
    return spark.createDataFrame(rows, "strategy string, memtable int, step int, metric string, value double")


def averages(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """(strategy, memtable, metric, total, average): of the times over all steps, and of what was measured after each."""
    return results(spark, rows).groupBy("strategy", "memtable", "metric").agg(F.sum("value").alias("total"), F.avg("value").alias("average"))
