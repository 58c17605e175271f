"""Sources of reviews: the documents table, text dumps, word lists, insert files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termforge.operators.numbering import running
from termforge.operators.raw_records import FIELDS
from termforge.session import sized, stored


def from_documents(docs: DataFrame) -> DataFrame:
    """Reviews (rid, product_id, helpfulness_num, helpfulness_den, score, text) made from the documents table."""
    d, n = F.col("doc_id"), F.coalesce(F.col("n_chars"), F.lit(0))
    pid = F.concat(F.lit("P"), F.lpad((d % 997).cast("string"), 9, "0"))
    return docs.select((d + 1).alias("rid"), pid.alias("product_id"), (d % (n % 20 + 1)).alias("helpfulness_num"), (n % 20).alias("helpfulness_den"), (n % 5 + 1).alias("score"), F.coalesce("text", F.lit("")).alias("text"))


def batches(reviews: DataFrame, inserts: int) -> DataFrame:
    """reviews with ``batch``: 0 for the first 40 % of the rids, then 1 .. inserts in equal ranges."""
    total = reviews.agg(F.max("rid")).first()[0] or 0
    first = total * 2 // 5
    later = F.expr(f"(rid - {first} - 1) * {inserts} div {max(1, total - first)}") + 1
    return reviews.withColumn("batch", F.when(F.col("rid") <= first, F.lit(0).cast("bigint")).otherwise(later))


_RECORD = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("edge", pa.int32()), ("record", pa.string())])
#: A record lies whole in its split; it began in an earlier one; it may go on in the next; both.
WHOLE, HEAD, TAIL, BOTH = range(4)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block) to records; block: where in the file the split begins."""
    key: tuple[str, int] | None = None
    pending: list[pa.Array] = []
    n, closed = 0, True

    def row(number: int, edge: int) -> pa.RecordBatch:
        text = "\n".join(x for part in pending for x in part.to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, number, edge, text], _RECORD, strict=True)], schema=_RECORD)

    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, block = (batch.column(k) for k in range(3))
        change = np.asarray(pc.or_(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(file) - 1))))
        cuts = [0, *(np.flatnonzero(change) + 1), len(file)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = file[a].as_py(), block[a].as_py()
            if now != key:
                if key is not None:
                    yield row(n + 1, TAIL if closed else BOTH)
                key, pending, n, closed = now, [], 0, now[1] == 0
            lines = value.slice(a, b - a)
            blank = np.asarray(pc.equal(pc.utf8_trim(lines, " \t\r"), ""))
            where = np.flatnonzero(blank)
            if not len(where):
                pending.append(lines)
                continue
            pending.append(lines.slice(0, where[0]))
            if any(map(len, pending)):
                n += closed
                yield row(n if closed else 0, WHOLE if closed else HEAD)
            closed = True
            inner = np.flatnonzero(~blank[: where[-1]])
            inner = inner[inner > where[0]]
            if len(inner):
                owner = np.cumsum(blank)[inner]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(inner)), pa.int32()), lines.take(pa.array(inner)))
                m = len(first)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * m), pa.array(np.full(m, now[1])), pa.array(n + 1 + np.arange(m)), pa.array(np.full(m, WHOLE, np.int32)), pc.binary_join(lists, "\n")], schema=_RECORD)
                n += m
            pending = [lines.slice(where[-1] + 1)]
    if key is not None:
        yield row(n + 1, TAIL if closed else BOTH)


def dump_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, record) of text files whose records end at blank lines; seq: from 0, in order of file name and place.

    Lines end in LF or CRLF, and blank lines may hold blanks and tabs. Splits are read side by side; a record that lies
    across splits is put together from its pieces, and the running number needs one count of each split: no record is
    sorted or shuffled for it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    seen = stored(lines.mapInArrow(_records, "file string, block bigint, n bigint, edge int, record string"), "dump")
    chain = F.sum((F.col("edge") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "n"))  # at most two short rows for each split
    pieces = seen.where(F.col("edge") != WHOLE).withColumn("chain", chain).groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
    text = F.array_join(F.filter("p.record", lambda x: x != ""), "\n")
    merged = pieces.select("file", F.get("p.block", F.lit(0)).alias("block"), F.get("p.n", F.lit(0)).alias("n"), text.alias("record")).where("record <> ''")
    every = seen.where(F.col("edge") == WHOLE).drop("edge").unionByName(merged)
    before = F.sum("c").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # one row for each split
    offsets = every.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return every.join(sized(offsets), ["file", "block"]).select((F.col("before") + F.col("n") - 1).alias("seq"), "record")


#: White space around values.
_BLANKS = " \t\r\n"


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, record, product_id, helpfulness_num, helpfulness_den, score, text, problem) of files of ``field: value`` records.

    Only the four known fields are read, each cut at the first colon. ``problem`` is null for a good record; a repeated
    or missing field, a line without a colon or a number that can't be read is named there, and its values are null.
    Records and their numbers are those of ``dump_records``.
    """
    records = dump_records(spark, path)
    lines = F.split("record", "\n")

    def value(name: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(f"{name}:"))
        return F.when(F.size(own) == 1, F.trim(F.substring(F.get(own, 0), F.lit(len(name) + 2), F.length(F.get(own, 0))), F.lit(_BLANKS)))

    def number(text: str, sep: str, k: int) -> Column:
        part = F.trim(F.expr(f"split_part({text}, '{sep}', {k})"), F.lit(_BLANKS))
        return F.when(part.rlike(r"^-?[0-9]{1,9}$"), part.cast("int"))

    pid, help_, score, text = map(value, FIELDS)
    rows = records.select("seq", "record", pid.alias("product_id"), help_.alias("h"), score.alias("s"), text.alias("text"), F.exists(lines, lambda x: ~x.contains(":")).alias("bare"))
    rows = rows.select("seq", "record", "product_id", number("h", "/", 1).alias("helpfulness_num"), number("h", "/", 2).alias("helpfulness_den"), number("s", ".", 1).alias("score"), "text", "bare")
    problem = F.when(F.col("bare"), "line").when(F.col("product_id").isNull(), FIELDS[0]).when(F.col("helpfulness_num").isNull() | F.col("helpfulness_den").isNull(), FIELDS[1]).when(F.col("score").isNull(), FIELDS[2]).when(F.col("text").isNull(), FIELDS[3])
    return rows.withColumn("problem", problem).drop("bare")


def write_dump(reviews: DataFrame, path: str, end: str = "\n") -> None:
    """Reviews (rid, product_id, helpfulness_num, helpfulness_den, score, text) as a dump, in order of rid over its files; line ends in texts become blanks."""
    pid, help_, score, text = (F.lit(f"{f}: ") for f in FIELDS)
    lines = [F.concat(pid, "product_id"), F.lit("review/userId: U1"), F.concat(help_, F.col("helpfulness_num").cast("string"), F.lit("/"), F.col("helpfulness_den").cast("string")), F.concat(score, F.col("score").cast("string"), F.lit(".0")), F.concat(text, F.regexp_replace("text", "[\r\n]", " "))]
    ordered = reviews.repartitionByRange("rid").sortWithinPartitions("rid")
    ordered.select(F.concat_ws(end, *lines).alias("value")).write.option("lineSep", end * 2).text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, id) from lines ``word id;``; other lines are left out."""
    got = spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)\s+(\d+);", 1).alias("word"), F.regexp_extract("value", r"^(\S+)\s+(\d+);", 2).alias("n"))
    return got.where("n <> ''").select("word", F.col("n").cast("int").alias("id"))


def insert_files(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder in order of the number that their names begin with; others aren't insert files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [str(s.getPath()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    numbered = [(int(m[0]), n) for n in names if (m := re.match(r"\d+", n.rsplit("/", 1)[-1]))]
    return [n for _, n in sorted(numbered)]


def sample_words(words: DataFrame, number: int, seed: int = 0) -> DataFrame:
    """A fixed pseudo-random choice of words, the same on every run."""
    return words.orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(number)


def number_words(words: DataFrame) -> DataFrame:
    """(word, id): distinct words with numbers from 1, in order."""
    return running(words.select("word").distinct(), ["word"], number="n").select("word", (F.col("n") + 1).cast("int").alias("id"))


def word_number(numbered: DataFrame, word: str) -> int:
    """The number of a word, -1 if it has none."""
    found = numbered.where(F.col("word") == F.lit(word)).select("id").first()
    return -1 if found is None else found[0]
