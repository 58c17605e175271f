"""Session helpers: shared work folder, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; with the narrow keys used here about 32 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a new local folder serves, if driver and executors are one process (tests); on a cluster that is
    an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="termforge-")
        sc.setCheckpointDir(found)
    return found


def work_folder(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/termforge-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A path in the application's folder that nobody used yet."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; for the caller, when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a new table in the shared folder and read again: a cut of the lineage that takes little disk."""
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most max_rows rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to be small, else with a shuffle-join hint."""
    return F.broadcast(df) if is_small(df, max_rows) else df.hint("shuffle_hash")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """rows joined with groups (key, n, ...), one row for each key, n rows of which rows may have.

    Groups that were counted to be few are broadcast. Else only those are that hold ``share`` of the rows, at most
    1 / share, so that no task gets a hot one; the others are joined by shuffle.
    """
    if is_small(groups):
        return rows.join(F.broadcast(groups), key)
    hot = F.col("n") >= max(2, int(rows.count() * share))
    keys = F.broadcast(groups.where(hot))
    return rows.join(keys, key).unionByName(rows.join(keys, key, "left_anti").join(groups.where(~hot).hint("shuffle_hash"), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if its files give far fewer, for work that is heavy on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context; Spark's file server hands it out."""
    sc = spark.sparkContext
    if getattr(sc, "_termforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="termforge-package-")) / "termforge.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._termforge_shipped = True
