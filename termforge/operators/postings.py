"""Inverted index rows and metadata of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import codec
from termforge.functions.tokens import MAX_TERM, spaced, text_length
from termforge.operators.numbering import gap_encode, running

META = ["rid", "product_id", "score", "helpfulness_num", "helpfulness_den", "review_length"]


#: Rids of a block of a nested postings list.
NESTED_RIDS = 1 << 16


def build_postings(reviews: DataFrame, unique: bool = False) -> DataFrame:
    """(term, rid, freq) of reviews (rid, text): every kept term with its number of mentions in the review.

    A null or empty text has no postings; rows of one rid add up; a null rid is left out; extra columns are ignored.
    unique: no two rows have one rid; then terms are counted inside the row, and nothing is shuffled.
    """
    rows = reviews.where(F.col("rid").isNotNull()).select(F.col("rid").cast("bigint").alias("rid"), F.split(spaced(F.col("text")), " ").alias("tokens"))
    if not unique:
        tokens = rows.select("rid", F.explode("tokens").alias("term")).where((F.col("term") != "") & (F.length("term") <= MAX_TERM))
        return tokens.groupBy("term", "rid").agg(F.count(F.lit(1)).alias("freq"))
    rows = rows.select("rid", F.sort_array("tokens").alias("t"))
    # equal terms are neighbours: a term begins where the one before is another, and ends where the next begins
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    ends = F.slice(F.concat(begins, F.array(F.size("t"))), 2, 1 << 30)
    counted = F.zip_with(begins, ends, lambda a, b: F.struct(F.get("t", a).alias("term"), (b - a).cast("bigint").alias("freq")))
    return rows.select("rid", F.explode(counted).alias("x")).select("x.term", "rid", "x.freq").where((F.col("term") != "") & (F.length("term") <= MAX_TERM))


def build_meta(reviews: DataFrame, *more: Column) -> DataFrame:
    """One row per row of reviews with its fields, its length in kept terms and what more is asked; a null text has length 0."""
    return reviews.select("rid", "product_id", "score", "helpfulness_num", "helpfulness_den", text_length(F.col("text")).alias("review_length"), *more)


def nested(postings: DataFrame, block: int = NESTED_RIDS) -> DataFrame:
    """(term, block, rids, freqs): the postings lists as arrays in order of rid, cut into blocks of so many rids, whatever a term's number of reviews."""
    lists = postings.groupBy("term", F.expr(f"rid div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rid", "freq"))).alias("p"))
    return lists.select("term", "block", F.col("p.rid").alias("rids"), F.col("p.freq").alias("freqs"))


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct()


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, tid, block, pos): terms in order with a number from 1, in blocks of BLOCK_TERMS from 0."""
    numbered = running(vocabulary(postings), ["term"], number="n")
    return numbered.select("term", (F.col("n") + 1).alias("tid"), F.expr(f"n div {codec.BLOCK_TERMS}").alias("block"), (F.col("n") % codec.BLOCK_TERMS).alias("pos"))


def with_ids(postings: DataFrame, words: DataFrame) -> DataFrame:
    """(tid, rid, freq) of postings and a dictionary, in order of (tid, rid); terms that the dictionary lacks are left out."""
    return postings.join(words.select("term", "tid"), "term").select("tid", "rid", "freq").orderBy("tid", "rid")


def with_terms(coded: DataFrame, words: DataFrame) -> DataFrame:
    """(term, rid, freq) of what ``with_ids`` gave."""
    return coded.join(words.select("term", "tid"), "tid").select("term", "rid", "freq")


def encoded_bytes(postings: DataFrame) -> DataFrame:
    """(term, gap_bytes, freq_bytes): bytes of the coded postings list of each term."""
    return gap_encode(postings).groupBy("term").agg(F.sum(codec.varint_length(F.col("gap"))).alias("gap_bytes"), F.sum(codec.varint_length(F.col("freq"))).alias("freq_bytes"))


def front_coded(words: DataFrame) -> DataFrame:
    """(term, block, pos, prefix_len, suffix) of a dictionary: each term against the first of its block, which stays whole."""
    first = words.where("pos = 0").select("block", F.col("term").alias("head"))
    both = words.join(first, "block")
    prefix = codec.common_prefix(F.col("term"), F.col("head"))
    suffix = F.when(F.col("pos") == 0, F.col("term")).otherwise(codec.front_suffix(F.col("term"), prefix))
    return both.select("term", "block", "pos", prefix.alias("prefix_len"), suffix.alias("suffix"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """(block, pos, term) from (block, pos, prefix_len, suffix)"""
    heads = coded.where("pos = 0").select("block", F.col("suffix").alias("head"))
    term = F.when(F.col("pos") == 0, F.col("suffix")).otherwise(F.concat(F.expr("substring(head, 1, cast(prefix_len as int))"), F.col("suffix")))
    return coded.join(heads, "block").select("block", "pos", term.alias("term"))


def pointers(postings: DataFrame) -> DataFrame:
    """(term, block, pos, postings_ptr, postings_len, string_ptr): where each term's list and each block's text begin."""
    words = dictionary(postings)
    coded = front_coded(words)
    sizes = encoded_bytes(postings).select("term", (F.col("gap_bytes") + F.col("freq_bytes")).alias("postings_len"))
    rows = coded.join(sizes, "term").withColumn("chars", F.length("suffix").cast("bigint"))
    placed = running(rows, ["term"], {"postings_ptr": "postings_len", "char_ptr": "chars"})
    starts = placed.where("pos = 0").select("block", F.col("char_ptr").alias("string_ptr"))
    return placed.join(starts, "block").select("term", "block", "pos", "postings_ptr", "postings_len", "string_ptr")
