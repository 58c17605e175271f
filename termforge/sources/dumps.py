"""Plain-text dumps of index data, for looking at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, sep: str = " ") -> None:
    """One line for each row, its columns in order with ``sep`` between; nulls are empty. An existing path is an error."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *columns).alias("value")).write.mode("error").text(path)


def write_pairs(df: DataFrame, key: str, value: str, path: str) -> None:
    """``key value;`` lines, as ``read_words`` reads them."""
    df.select(F.concat(F.col(key).cast("string"), F.lit(" "), F.col(value).cast("string"), F.lit(";")).alias("value")).write.mode("error").text(path)


def elapsed(what: str, ms: float) -> str:
    """How long something took, in whole minutes, whole seconds and milliseconds."""
    return f"Elapsed time for {what}: {int(ms // 60_000)} in mins, {int(ms // 1000)} in secs, {int(ms)} in ms"


def write_log(results: DataFrame, path: str, title: str) -> None:
    """Measurements as lines of text under a title and the time; each file of ``path`` begins so."""
    head = F.concat(F.lit(f"{title} "), F.date_format(F.current_timestamp(), "yyyy/MM/dd HH:mm:ss"))
    lines = F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in results.columns))
    results.sparkSession.range(1).select(head.alias("value")).unionByName(results.select(lines.alias("value"))).coalesce(1).write.mode("error").text(path)
