"""Building and changing an index: construct, insert, remove, compact.

Two strategies: ``SimpleMergeWriter`` adds one segment for each insert and merges all on demand; ``LogMergeWriter``
collects rows in a tail, cuts off flushes of ``capacity`` rows and keeps one segment for each bit set in the number of
flushes. Both give the same answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.tokens import raw_length
from termforge.index.catalog import Catalog, Manifest, Segment
from termforge.index.reader import META as META_SCHEMA
from termforge.index.reader import IndexReader
from termforge.operators import layout
from termforge.operators.numbering import running
from termforge.operators.postings import META, build_meta, build_postings
from termforge.session import stored
from termforge.sources.reviews import read_dump

FIELDS = ["product_id", "helpfulness_num", "helpfulness_den", "score", "text"]
KEY = ["seg", "term", "rid"]


class _Writer:
    strategy = ""

    def __init__(self, spark: SparkSession, root: str, capacity: int = 0, rows_per_file: int = 50_000_000) -> None:
        self.spark, self.capacity, self.rows_per_file = spark, capacity, rows_per_file
        self.catalog = Catalog(spark, root)

    # files ------------------------------------------------------------------------------------------------------

    def _write_segments(self, rows: DataFrame, kinds: list[Segment], add_up: bool = False) -> list[Segment]:
        """The segments of rows (seg, term, rid, freq), all in one write; seg: the place in kinds, which tell what each is.

        Rows are in order of (term, rid), with delta codes for both, so that a term's rows are next to each other. With
        add_up, rows of one term and rid become one, in the same shuffle.
        """
        path = self.catalog.fresh("segments")
        placed = rows.select(*KEY, "freq").repartitionByRange(*KEY)
        if add_up:
            placed = placed.groupBy(*KEY).agg(F.sum("freq").alias("freq"))
        writer = placed.sortWithinPartitions(*KEY).write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("maxRecordsPerFile", self.rows_per_file)
        writer.mode("error").partitionBy("seg").parquet(path)
        seen = self.spark.read.schema("term string, rid bigint, freq bigint, seg int").parquet(path).groupBy("seg").agg(F.count(F.lit(1)), F.min("term"), F.max("term"))
        stats = {r[0]: tuple(r)[1:] for r in seen.collect()}  # a row for each segment
        return [Segment(f"{path}/seg={k}" if k in stats else "", s.kind, s.level, s.start, *stats.get(k, (0, None, None))) for k, s in enumerate(kinds)]

    def _write(self, rows: DataFrame, label: str) -> str:
        path = self.catalog.fresh(label)
        rows.write.mode("error").parquet(path)
        return path

    # rids -------------------------------------------------------------------------------------------------------

    def _numbered(self, reviews: DataFrame | str | list[str], manifest: Manifest) -> tuple[DataFrame, int, int]:
        """(reviews with rids, next rid, malformed rows). Rids are taken from the input, or given in order of ``seq``, or of a dump's records.

        A row without score or helpfulness numbers, or a record that can't be read, is malformed: it takes a rid but no
        part in the index. The input is read once.
        """
        if not isinstance(reviews, DataFrame):
            dump = read_dump(self.spark, reviews)
            score = F.when(F.col("problem").isNull(), F.col("score"))
            reviews = dump.select((F.col("seq") + manifest.next_rid).alias("rid"), *(score.alias(c) if c == "score" else c for c in FIELDS))
        if "rid" in reviews.columns:
            rows = stored(reviews.select(F.col("rid").cast("bigint").alias("rid"), *FIELDS), "reviews")
        else:
            rows = running(reviews.select("seq", *FIELDS), ["seq"], number="_n").select((F.col("_n") + manifest.next_rid).alias("rid"), *FIELDS)
        good = F.col("score").isNotNull() & F.col("helpfulness_num").isNotNull() & F.col("helpfulness_den").isNotNull()
        most, least, malformed, number, every = rows.agg(F.max("rid"), F.min("rid"), F.count_if(~good), F.count("rid"), F.count(F.lit(1))).first()
        # bit maps of rids tell whether they differ; a map of some KB is all that a task sends for each range of rids
        maps = rows.groupBy(F.bitmap_bucket_number("rid")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("rid"))).alias("n"))
        if number < every or (number and (least < manifest.next_rid or maps.agg(F.sum("n")).first()[0] < number)):
            raise ValueError("rids must be new and different")
        return rows.where(good), (most or manifest.next_rid - 1) + 1, malformed

    # commands ---------------------------------------------------------------------------------------------------

    def construct(self, reviews: DataFrame | str | list[str]) -> int:
        """Build a new index from rows or from dump files; the number of reviews. An index that is there already is an error."""
        if self.catalog.exists():
            raise FileExistsError(f"there is an index at {self.catalog.root}")
        return self._add(reviews, Manifest(strategy=self.strategy, capacity=self.capacity), "main")

    def insert(self, reviews: DataFrame | str | list[str]) -> int:
        """Add a batch of rows or dump files; the number of reviews in it. Rids go on where they ended, in whatever process that was."""
        return self._add(reviews, self.catalog.load(), "aux")

    def insert_once(self, reviews: DataFrame, stream: str, number: int) -> int:
        """Insert batch ``number`` of a stream, or construct the index with it; nothing if it was committed before."""
        there = self.catalog.exists()
        manifest = self.catalog.load() if there else Manifest(strategy=self.strategy, capacity=self.capacity)
        if manifest.streams.get(stream, -1) >= number:
            return 0
        manifest.streams[stream] = number
        return self._add(reviews, manifest, "aux" if there else "main")

    def _add(self, reviews: DataFrame | str | list[str], manifest: Manifest, kind: str) -> int:
        rows, next_rid, malformed = self._numbered(reviews, manifest)
        before = manifest.next_rid
        manifest.next_rid, manifest.malformed = max(next_rid, before), manifest.malformed + malformed
        with self.catalog.draft():
            columns = [F.col(c).cast("string" if c == "product_id" else "bigint").alias(c) for c in META]
            meta = build_meta(rows, raw_length(F.col("text")).alias("raw_length")).select(*columns, "raw_length")
            manifest.meta.append(self._write(meta, "meta"))
            self._count_meta(manifest, manifest.meta[-1:])
            self._add_postings(build_postings(rows, unique=True), manifest, kind)
            self.catalog.commit(manifest)
        return manifest.next_rid - before

    def _count_meta(self, manifest: Manifest, paths: list[str]) -> None:
        """Add what is in metadata files to the manifest's totals."""
        sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("review_length", "raw_length")]
        n, tokens, raw = self.spark.read.schema(f"{META_SCHEMA}, raw_length bigint").parquet(*paths).agg(F.count(F.lit(1)), *sums).first()
        manifest.reviews, manifest.tokens, manifest.raw_tokens = manifest.reviews + n, manifest.tokens + tokens, manifest.raw_tokens + raw

    def _add_postings(self, postings: DataFrame, manifest: Manifest, kind: str) -> None:
        """Put the postings into segments of the manifest."""
        raise NotImplementedError

    def remove(self, rids: DataFrame) -> None:
        """Delete reviews by rid; null rids and rids that were never given out are ignored, repeats count once."""
        manifest = self.catalog.load()
        known = F.col("rid").between(1, manifest.next_rid - 1)
        with self.catalog.draft():
            manifest.tombstones.append(self._write(rids.select(F.col("rid").cast("bigint").alias("rid")).where(known).distinct(), "tombstones"))
            self.catalog.commit(manifest)

    def _purge(self, manifest: Manifest) -> None:
        """Metadata without deleted reviews, in one set of files, and no tombstones."""
        if manifest.tombstones and manifest.version:
            reader = IndexReader(self.spark, self.catalog.root, manifest.version)
            live = reader._live(reader._read(manifest.meta, f"{META_SCHEMA}, raw_length bigint"))
            manifest.meta, manifest.tombstones = [self._write(live, "meta")], []


class SimpleMergeWriter(_Writer):
    strategy = "simple"

    def _add_postings(self, postings: DataFrame, manifest: Manifest, kind: str) -> None:
        manifest.segments += self._write_segments(postings.withColumn("seg", F.lit(0)), [Segment("", kind)])

    def compact(self) -> None:
        """Merge all segments of the current version into a new main one and drop deleted reviews for good."""
        manifest = self.catalog.load()
        reader = IndexReader(self.spark, self.catalog.root, manifest.version)
        with self.catalog.draft():
            manifest.segments = self._write_segments(reader.postings().withColumn("seg", F.lit(0)), [Segment("", "main")], add_up=True)
            self._purge(manifest)
            manifest.reviews = manifest.tokens = manifest.raw_tokens = 0
            self._count_meta(manifest, manifest.meta)
            self.catalog.commit(manifest)


class LogMergeWriter(_Writer):
    strategy = "log"

    def __init__(self, spark: SparkSession, root: str, capacity: int, rows_per_file: int = 50_000_000) -> None:
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        super().__init__(spark, root, capacity, rows_per_file)

    def _add_postings(self, postings: DataFrame, manifest: Manifest, kind: str) -> None:
        """Cut full flushes off the tail and the new rows, then write those segments that the flushes changed, in one write.

        The state after all flushes follows from their number, so that a batch of many flushes merges once.
        """
        reader = IndexReader(self.spark, self.catalog.root, manifest.version) if manifest.version else None
        old = {(s.level, s.start): s for s in manifest.segments if s.kind == "level"}
        tails = [s for s in manifest.segments if s.kind == "tail"]
        fresh = postings.select("term", "rid", "freq")
        if tails:
            fresh = reader.segment_rows(tails).unionByName(fresh)
        before = manifest.flushes
        rows = layout.flush_numbers(fresh, manifest.capacity, before)
        after = before + rows.count() // manifest.capacity
        clear = layout.clears(before, after) and bool(manifest.tombstones)
        kept, kinds = [], []
        whole: list[tuple[int, DataFrame]] = []  # rows of old segments, by the place of the new one that takes them up
        place = F.lit(None).cast("int")
        for level, start in layout.live_levels(after):
            if (level, start) in old and not clear:
                kept.append(old[level, start])
                continue
            end = start + (1 << level)
            parts = [s for (_, first), s in old.items() if start <= first < end]
            if parts:
                whole.append((len(kinds), reader._live(reader.segment_rows(parts))))
            place = F.when(F.col("flush").between(start, end - 1), F.lit(len(kinds))).otherwise(place)
            kinds.append(Segment("", "level", level, start))
        place = F.when(F.col("flush") >= after, F.lit(len(kinds))).otherwise(place)
        kinds.append(Segment("", "tail"))
        new = rows.withColumn("seg", place).where("seg IS NOT NULL").select(*KEY, "freq")
        new = reader._live(new) if clear else new
        for k, part in whole:
            new = new.unionByName(part.withColumn("seg", F.lit(k)).select(*KEY, "freq"))
        manifest.segments, manifest.flushes = kept + self._write_segments(new, kinds), after
        if clear:
            new_meta = manifest.meta[-1]  # the batch's own rids are newer than any tombstone
            manifest.meta = manifest.meta[:-1]
            self._purge(manifest)
            manifest.meta.append(new_meta)
            manifest.reviews = manifest.tokens = manifest.raw_tokens = 0
            self._count_meta(manifest, manifest.meta)
