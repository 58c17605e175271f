"""Queries on one version of an index; later commits don't change what a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.tokens import MAX_TERM
from termforge.index.catalog import Catalog, Segment
from termforge.session import sized

POSTINGS = "term string, rid bigint, freq bigint"
META = "rid bigint, product_id string, score bigint, helpfulness_num bigint, helpfulness_den bigint, review_length bigint"


class IndexReader:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.manifest = self.catalog.load(version)
        self._dead: DataFrame | None = None
        self._totals: tuple[int, int] | None = None

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        """All paths in one scan, however many there are."""
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tombstones(self) -> DataFrame:
        return self._read(self.manifest.tombstones, "rid bigint").distinct()

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows without deleted reviews; the deleted ones are counted once for each reader."""
        if not self.manifest.tombstones:
            return rows
        if self._dead is None:
            self._dead = sized(self._read(self.manifest.tombstones, "rid bigint"))
        return rows.join(self._dead, "rid", "left_anti")

    def segment_rows(self, segments: list[Segment] | None = None) -> DataFrame:
        """Rows (term, rid, freq) as they are on disk, deleted reviews among them."""
        return self._read([s.path for s in (self.manifest.segments if segments is None else segments) if s.rows], POSTINGS)

    def postings(self) -> DataFrame:
        """Live rows (term, rid, freq) of all segments and the unflushed tail."""
        return self._live(self.segment_rows())

    def term(self, term: str, normalize: bool = False) -> DataFrame:
        """(rid, freq) of a term in order of rid. The term is taken as it is, unless ``normalize``; unknown terms give no rows."""
        term = term.strip().lower() if normalize else term
        # a review's rows are in one segment, or, cut off by a flush, in two that don't share its terms: nothing to add up
        return self._live(self._of_term(term)).select("rid", "freq").orderBy("rid")

    def _of_term(self, term: str) -> DataFrame:
        """Rows of a term, from the segments that can have it."""
        having = [s for s in self.manifest.segments if s.rows and s.first <= term <= s.last]
        return self.segment_rows(having).where(F.col("term") == F.lit(term))

    def terms(self, words: DataFrame) -> DataFrame:
        """(term, rid, freq) of all terms in a column ``term``; a list longer than can be broadcast is joined by shuffle."""
        wanted = words.select("term").where(F.length("term") <= MAX_TERM).distinct()
        return self._live(self.segment_rows().join(sized(wanted), "term", "left_semi"))

    def word_counts(self, words: DataFrame) -> DataFrame:
        """(term, mentions, reviews) of each different term in a column ``term``; 0 and 0 for what the index doesn't have."""
        found = self.terms(words).groupBy("term").agg(F.sum("freq").alias("mentions"), F.count(F.lit(1)).alias("reviews"))
        return words.select("term").distinct().join(found, "term", "left").select("term", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("mentions", "reviews")))

    def mentions(self, term: str) -> int:
        return self._live(self._of_term(term)).agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]

    def reviews_with(self, term: str) -> int:
        return self._live(self._of_term(term)).count()

    def meta(self) -> DataFrame:
        """Metadata of live reviews."""
        return self._live(self._read(self.manifest.meta, META))

    def lookup(self, rids: DataFrame) -> DataFrame:
        """Metadata of the asked rids: a null product id and -1 for what isn't there, for rids below 1 and deleted ones."""
        asked = rids.select(F.col("rid").cast("bigint").alias("rid"))
        found = asked.join(self.meta().where("rid > 0"), "rid", "left")
        return found.select("rid", "product_id", *(F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("score", "helpfulness_num", "helpfulness_den", "review_length")))

    def with_meta(self, term: str) -> DataFrame:
        """(rid, freq, metadata) of the reviews with a term."""
        return self.term(term).join(self.meta(), "rid")

    def totals(self) -> tuple[int, int]:
        """(live reviews, their kept terms): from the manifest where nothing is deleted, else counted once for each reader."""
        if not self.manifest.tombstones:
            return self.manifest.reviews, self.manifest.tokens
        if self._totals is None:
            self._totals = tuple(self.meta().agg(F.count(F.lit(1)), F.coalesce(F.sum("review_length"), F.lit(0))).first())
        return self._totals

    def total_reviews(self) -> DataFrame:
        return self.spark.createDataFrame([(self.totals()[0],)], "reviews bigint")

    def total_tokens(self) -> DataFrame:
        return self.spark.createDataFrame([(self.totals()[1],)], "tokens bigint")

    def raw_tokens(self) -> int:
        """Tokens of all reviews in the metadata files, those too long for a term among them."""
        return self.manifest.raw_tokens

    def reviews_indexed(self) -> int:
        """Reviews that ever came in, deleted ones too."""
        return self.manifest.next_rid - 1

    def segment_count(self) -> int:
        return sum(s.kind != "tail" for s in self.manifest.segments)

    def disk_bytes(self) -> int:
        return self.catalog.disk_bytes(self.manifest)
