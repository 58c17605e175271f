"""How distinctive a word is of a review: graph of words and collection rarity.

Within a review, words that stand close together are joined by edges; a word's weight is the number of distinct words
it is joined with, not its frequency. Postings keep frequencies but no positions, so a review's mentions are laid out
by a fixed rule: the k-th of f mentions of a word stands at (k + u) / f of the review, u in [0, 1) being made of word and
review. A review with more than SCALE times as many mentions as different words is laid out at a smaller scale, so that
no frequency, however large, takes more places than the review's words warrant. Texts, where there are any, give their
real order through ``degrees_of_texts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.operators.heavy_keys import heavy_keys, split_by_weight
from termforge.operators.live_index import collapse, valid_postings
from termforge.session import durable, is_small, stored

#: Words at most WINDOW - 1 places apart are joined.
WINDOW = 4
#: Places for each different word of a review that are laid out at most, on the average.
SCALE = 16
#: Reviews of so many rows (but of no smaller share of all rows than LEAST_SHARE, and of at most HEAVY_REVIEW) are cut into blocks of BLOCK mentions, which are laid out one by one.
HEAVY_ROWS, LEAST_SHARE, HEAVY_REVIEW, BLOCK = 1_000_000, 1e-5, 0.01, 4096
#: Steps of the phase of a word.
PHASES = 1 << 20


def neighbours(record: np.ndarray, word: np.ndarray, window: int) -> np.ndarray:
    """Distinct pairs (row of a word, number of another word) in sequences of words; both arrays are in order of place.

    word: any number that stands for the word within its record; returned as two columns, word and neighbour, by record.
    """
    pairs = []
    for d in range(1, window):
        a, b = np.arange(len(word) - d), np.arange(d, len(word)) if len(word) > d else np.arange(0)
        a = a[: len(b)]
        near = (record[a] == record[b]) & (word[a] != word[b])
        pairs += [np.column_stack([word[a[near]], word[b[near]]]), np.column_stack([word[b[near]], word[a[near]]])]
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if not len(both):
        return both
    key = np.unique((both[:, 0] << 32) | both[:, 1])
    return np.column_stack([key >> 32, key & 0xFFFFFFFF])


def laid_out(freq: np.ndarray, length: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of each row, a word of a review of so many mentions and different words."""
    return np.where(length > SCALE * words, np.maximum(1, (freq * (SCALE * words / length)).astype(np.int64)), freq)


def degrees(record: np.ndarray, freq: np.ndarray, phase: np.ndarray, window: int) -> np.ndarray:
    """Distinct neighbours of each row, a word of a record with its places; rows of one record are in a row."""
    row = np.repeat(np.arange(len(freq)), freq)
    kth = np.arange(len(row)) - np.repeat(np.cumsum(freq) - freq, freq)
    place = (kth + phase[row]) / freq[row]
    order = np.lexsort((row, place, record[row]))
    row = row[order]
    return np.bincount(neighbours(record[row], row, window)[:, 0], minlength=len(freq))


def word_phase(word: str) -> int:
    """The word's part of its phase: the first five hexadecimal digits of its MD5."""
    return int(hashlib.md5(word.encode()).hexdigest()[:5], 16)


def phase_column(word: str = "word", rid: str = "rid"):
    """A number in [0, 1) that word and review give."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 5), 16, 10).cast("bigint") + F.pmod(rid, F.lit(PHASES)) * 40503, F.lit(PHASES)) / F.lit(float(PHASES))


#: Words whose counts are broadcast at most; beyond, rows and counts are shuffled by word.
STATS_ROWS = 500_000
#: kind 0: a word of a review; 1: reviews and mentions of a word, in part; 2: number of reviews, in part.
ROWS, WORDS, REVIEWS = range(3)
PARTS = "kind int, rid bigint, length bigint, words array<string>, freqs array<bigint>, degrees array<bigint>, word string, reviews bigint, mentions bigint"
_INTS = pa.list_(pa.int64())
_SCHEMA = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("length", pa.int64()), ("words", pa.list_(pa.string())), ("freqs", _INTS), ("degrees", _INTS), ("word", pa.string()), ("reviews", pa.int64()), ("mentions", pa.int64())])
#: Different words that a task counts before it hands the counts on.
HELD = 1_000_000


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    made = {"kind": pa.array(np.full(n, kind, np.int32))} | {k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


class _Words:
    """The words that a task met: their numbers, phases and counts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.phase, self.counts, self.live = np.zeros(1024, np.int64), np.zeros((2, 1024), np.int64), 0

    def find(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        for w in known:
            if w not in self.number:
                n = self.number[w] = len(self.number)
                if n == len(self.phase):
                    self.phase, self.counts = np.resize(self.phase, 2 * n), np.hstack([self.counts, np.zeros_like(self.counts)])
                self.phase[n] = word_phase(w)
        return np.array([self.number[w] for w in known], np.int64)[np.asarray(coded.indices)]

    def add(self, number: np.ndarray, freq: np.ndarray, reviews: int) -> None:
        n = len(self.number)
        self.counts[0, :n] += np.bincount(number, minlength=n)
        np.add.at(self.counts[1], number, freq)
        self.live += reviews

    def handed(self) -> Iterator[pa.RecordBatch]:
        n = len(self.number)
        if n:
            yield _batch(WORDS, n, word=pa.array(list(self.number), pa.string()), reviews=self.counts[0, :n], mentions=self.counts[1, :n])
            yield _batch(REVIEWS, 1, reviews=np.array([self.live]))


def _review_degrees(window: int, min_freq: int):
    """Rows (rid, word, flush_id, freq) in order, freq falling, to PARTS: a row for each review."""

    def work(table: pa.Table, known: _Words) -> pa.RecordBatch:
        rid, flush, freq = (table.column(c).to_numpy() for c in ("rid", "flush_id", "freq"))
        words = table.column("word").combine_chunks()
        number = known.find(words)
        new = np.ones(len(rid), bool)  # a word of a review begins
        new[1:] = (rid[1:] != rid[:-1]) | (number[1:] != number[:-1])
        once = new.copy()  # replays come after the row that counts
        once[1:] |= flush[1:] != flush[:-1]
        first = np.flatnonzero(new)
        freq = np.add.reduceat(np.where(once, freq, 0), first)
        rid, number = rid[first], number[first]
        begin = np.flatnonzero(np.diff(rid, prepend=rid[0] - 1))
        size = np.diff(np.append(begin, len(rid)))
        record = np.repeat(np.arange(len(begin)), size)
        length = np.add.reduceat(freq, begin)
        phase = (known.phase[number] + np.mod(rid, PHASES) * 40503) % PHASES / float(PHASES)
        degree = degrees(record, laid_out(freq, length[record], size[record]), phase, window).astype(np.int64)
        known.add(number, freq, len(begin))
        keep = np.flatnonzero(freq >= min_freq)
        some, each = np.unique(record[keep], return_counts=True)
        cuts = pa.array(np.append(0, np.cumsum(each)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(cuts, c) for c in (words.take(pa.array(first[keep])), pa.array(freq[keep]), pa.array(degree[keep])))
        return _batch(ROWS, len(some), rid=rid[begin][some], length=length[some], **dict(zip(("words", "freqs", "degrees"), lists, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        known = _Words()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            if not len(rid):
                continue
            last = int(np.searchsorted(rid, rid[-1]))  # the last review may go on in the next batch
            if last or (kept and kept[-1].column(0)[0].as_py() != rid[0]):
                done = pa.Table.from_batches([*kept, batch.slice(0, last)])
                kept = []
                if done.num_rows:
                    yield work(done, known)
            kept.append(batch.slice(last))
            if len(known.number) > HELD:
                yield from known.handed()
                known = _Words()
        if kept:
            yield work(pa.Table.from_batches(kept), known)
        yield from known.handed()

    return run


def _heavy_degrees(pairs: DataFrame, window: int) -> DataFrame:
    """The same for reviews of any size: mentions in blocks by place, edges within blocks and from each to the next."""
    lengths = pairs.groupBy("rid").agg(F.sum("freq").alias("length"), F.count(F.lit(1)).alias("n"))
    sized = pairs.join(F.broadcast(lengths), "rid")  # one row for each heavy review
    scaled = F.greatest(F.lit(1), F.floor(F.col("freq") * (F.col("n") * SCALE / F.col("length"))))
    places = F.when(F.col("length") > F.col("n") * SCALE, scaled).otherwise(F.col("freq")).cast("bigint")
    place = (F.col("k") + phase_column()) / F.col("f")
    mentions = sized.select("rid", "word", places.alias("f"), F.least("length", F.col("n") * SCALE).alias("size")).select("rid", "word", "f", "size", F.explode(F.sequence(F.lit(0), F.col("f") - 1)).alias("k"))
    mentions = mentions.select("rid", "word", place.alias("place"), F.floor(place * F.col("size") / BLOCK).cast("bigint").alias("block"))
    edge_schema = pa.schema([("rid", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("block", pa.int64()), ("place", pa.float64())])

    def edges(table: pa.Table, cross: bool) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("word", "ascending")])
        coded = table.column("word").combine_chunks().dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        rid, n = table.column("rid")[0].as_py(), len(code)
        pair = neighbours(np.zeros(n, np.int64), code, window)
        a, b = (coded.dictionary.take(pa.array(pair[:, i])) for i in (0, 1))
        parts = [pa.table([pa.array(np.full(len(pair), rid)), a, b, pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.float64())], schema=edge_schema)]
        if not cross:  # the places at both ends go to the borders between blocks
            block = table.column("block")[0].as_py()
            for border, at in ((block, np.arange(min(n, window - 1))), (block + 1, np.arange(max(0, n - window + 1), n))):
                ends = table.take(pa.array(at))
                parts.append(pa.table([ends.column("rid"), ends.column("word"), pa.nulls(len(at), pa.string()), pa.array(np.full(len(at), border)), ends.column("place")], schema=edge_schema))
        return pa.concat_tables(parts)

    schema = "rid bigint, a string, b string, block bigint, place double"
    inner = mentions.groupBy("rid", "block").applyInArrow(lambda t: edges(t, False), schema)
    borders = inner.where("block IS NOT NULL").select("rid", F.col("a").alias("word"), "place", "block")
    crossing = borders.groupBy("rid", "block").applyInArrow(lambda t: edges(t, True), schema)
    joined = inner.where("block IS NULL").unionByName(crossing).select("rid", "a", "b").distinct()
    degree = joined.groupBy("rid", F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("degree"))
    return sized.join(degree, ["rid", "word"], "left").select("rid", "word", "freq", "length", F.coalesce("degree", F.lit(0)).alias("degree"))


def review_parts(valid: DataFrame, window: int = WINDOW, min_freq: int = 1) -> DataFrame:
    """PARTS of valid rows (word, rid, freq, flush_id): one shuffle by rid, in which replays, sums, degrees and counts are made."""
    order = ["rid", "word", "flush_id"]
    rows = valid.select("rid", "word", F.coalesce("flush_id", F.lit(-1)).alias("flush_id"), "freq").repartition("rid")
    return rows.sortWithinPartitions(*order, F.col("freq").desc()).mapInArrow(_review_degrees(window, min_freq), PARTS)


def _part_columns(kind: int, **columns):
    return [F.lit(kind).cast("int").alias("kind"), *((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in T._parse_datatype_string(PARTS).fields[1:])]


def distinctive_words(postings: DataFrame, tombstones: DataFrame, min_freq: int = 1, window: int = WINDOW, best_first: bool = False) -> DataFrame:
    """(rid, word, score, degree, freq, length, reviews, mentions, all_mentions) of the live index.

    score = degree * ln(1 + live reviews with any word / live reviews with the word); the degree of the only word of a
    review is 0. min_freq leaves out words mentioned less often in the review, after degrees and counts were made over
    everything. best_first puts each review's words in order of score, then word. Null words and rids, freq below 1 and deleted reviews don't count, replays count once. Ties have equal
    scores; empty tables give an empty result; extra columns are ignored. A review's words are kept in one row, so
    that they stay together; only where the words' counts are too many to be broadcast are they shuffled again.
    """
    valid = valid_postings(postings, tombstones)
    rows = postings.select("rid").where("rid IS NOT NULL")
    share = min(HEAVY_REVIEW, max(LEAST_SHARE, HEAVY_ROWS / max(1, postings.count())))
    heavy = heavy_keys(rows, "rid", share)
    if heavy.isEmpty():
        parts = stored(review_parts(valid, window, min_freq), "parts")
    else:
        large, small = split_by_weight(valid, "rid", heavy)
        pairs = durable(collapse(large.repartition("rid", "word")))
        found = _heavy_degrees(pairs, window).where(F.col("freq") >= min_freq)
        single = {f"{c}s": F.array(c) for c in ("word", "freq", "degree")}  # no review of any size in one row
        found = found.select(*_part_columns(ROWS, rid=F.col("rid"), length=F.col("length"), **single))
        counts = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("reviews"), F.sum("freq").alias("mentions"))
        counts = counts.select(*_part_columns(WORDS, word=F.col("word"), reviews=F.col("reviews"), mentions=F.col("mentions")))
        number = pairs.agg(F.countDistinct("rid").alias("n")).select(*_part_columns(REVIEWS, reviews=F.col("n")))
        parts = stored(review_parts(small, window, min_freq).unionByName(found).unionByName(counts).unionByName(number), "parts")
    stats = parts.where(F.col("kind") == WORDS).groupBy("word").agg(F.sum("reviews").alias("reviews"), F.sum("mentions").alias("mentions"))
    live, mentions = parts.agg(F.sum(F.when(F.col("kind") == REVIEWS, F.col("reviews"))), F.sum(F.when(F.col("kind") == WORDS, F.col("mentions")))).first()
    each = parts.where(F.col("kind") == ROWS).select("rid", "length", F.explode(F.arrays_zip("words", "freqs", "degrees")).alias("x"))
    each = each.select("rid", F.col("x.words").alias("word"), F.col("x.freqs").alias("freq"), "length", F.col("x.degrees").alias("degree"))
    score = F.col("degree") * F.log1p(F.lit(live or 0) / F.col("reviews"))
    small = is_small(stats, STATS_ROWS)
    scored = each.join(F.broadcast(stats) if small else stats.hint("shuffle_hash"), "word").select("rid", "word", score.alias("score"), "degree", "freq", "length", "reviews", "mentions", F.lit(mentions or 0).cast("bigint").alias("all_mentions"))
    if not best_first:
        return scored
    order = ["rid", F.col("score").desc(), "word"]
    # a review that came out of one row is in one partition still
    return scored.sortWithinPartitions(*order) if small and heavy.isEmpty() else scored.orderBy(*order)


def degrees_of_texts(texts: DataFrame, id_col: str, words_col: str, window: int = WINDOW) -> DataFrame:
    """(id, word, freq, degree) from arrays of words in their real order; null words and null or empty arrays give none."""
    schema = pa.schema([(id_col, pa.int64()), ("word", pa.string()), ("freq", pa.int64()), ("degree", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            record = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(words).fill_null(0)))
            coded = words.flatten().dictionary_encode()
            code = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
            record, code = record[code >= 0], code[code >= 0]
            keys, at, freq = np.unique((record << 32) | code, return_inverse=True, return_counts=True)
            degree = np.bincount(neighbours(record, at, window)[:, 0], minlength=len(keys))
            out = [batch.column(0).take(pa.array(keys >> 32)), coded.dictionary.take(pa.array(keys & 0xFFFFFFFF)), pa.array(freq.astype(np.int64)), pa.array(degree.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return texts.select(F.col(id_col).cast("bigint").alias(id_col), F.col(words_col).alias("words")).mapInArrow(run, f"`{id_col}` bigint, word string, freq bigint, degree bigint")
