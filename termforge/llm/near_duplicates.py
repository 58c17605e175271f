"""Texts that share most of their words: an exact set-similarity join that skips by set relations.

Equal word sets are one class, joined once. Sets that differ from another in at most APART words, found by two equal
minimum hashes and compared exactly, follow that one, their leader; only leaders and sets without one are searched, with
bounds that allow for what their followers have less and more. Each searched set enters the index lists of its rarest
words, as many as any two similar sets must have one in common among. A list is kept in order of set size and of the
word's position in the set, in blocks. From a set's size and position follows how large a set can be that it may be
similar to, and blocks, and rows within them, that can't reach the threshold are skipped. Pairs that survive a bound on
bit signatures are compared exactly. A follower's answers come from its leader's: the words that two leaders share, less
and plus the followers' differences, decide most pairs without looking at them, and under one leader all. Long lists
are cut into parts of LIST rows, each pair of which is a task's work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.canonical import canonical_text, word_runs
from termforge.session import durable, join_groups, sized, stored

#: Frequent words whose order is by their counts; all others are at most as frequent as the last of these, and come first, in order of hash.
ORDERED_WORDS = 1 << 20
#: Rows of one list that a task holds, and rows of a block of it.
LIST, ROWS = 1 << 18, 256
SIGNATURE = 4
#: Numbers of equal parts of the signature, one of which two sets have in common if they differ in fewer words.
CHUNKS = (4, 8, 16)
#: Words that a band of sets in a list is wide; sets that make sorting by parts worth while; pairs that are looked at together; how much dearer a pair found by sorting is than one of a block.
BAND, SORTED, PAIRS, DEARER = 2, 400, 1 << 18, 24
#: Words in which a set may differ from its leader.
APART = 1


def _rows(reviews: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, same, words): one row for each id with a text with words; same: hash of the canonical text; words: sorted hashes"""
    texts = reviews.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = texts.select("id", "text", word_runs(F.col("text")).alias("runs"))
    hashed = F.sort_array(F.array_distinct(F.transform("runs", lambda w: F.xxhash64(w))))
    rows = texts.select("id", F.unhex(F.md5(canonical_text(F.col("text"), F.col("runs")))).alias("same"), hashed.alias("words"))
    rows = rows.where(F.size("words") > 0)
    return rows.groupBy("id").agg(F.min(F.struct("same", "words")).alias("r")).select("id", "r.same", "r.words")


def word_order(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, their counts) of the most frequent words; at most ORDERED_WORDS come to the driver"""
    top = classes.select(F.explode("words").alias("w")).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(ORDERED_WORDS).toPandas()
    order = np.argsort(top["w"].to_numpy())
    return top["w"].to_numpy()[order].astype(np.int64), top["count"].to_numpy()[order].astype(np.int64)


LISTED = "list bigint, place bigint, kind int, id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _size_range(size: np.ndarray) -> np.ndarray:
    """Number of the range of sizes, four from each power of two to the next, that a size falls in."""
    power = np.frexp(size.astype(np.float64))[1].astype(np.int64)
    return power * 4 + (size * 8 >> power) - 4


def _largest(size: np.ndarray, pos: np.ndarray, slack: np.ndarray, num: int, den: int, most_slack: int) -> np.ndarray:
    """The largest set that one of that size, with no word shared before that position, can be similar to."""
    return (size - pos + slack + most_slack) * (num + den) // num - size + slack + most_slack


def _list_rows(order: tuple[np.ndarray, np.ndarray], sizes: dict[int, int], threshold: Fraction, longest: int, slack: int):
    """Rows (class, words, slack) to LISTED; slack: the most words in which followers, of this set or any, differ from it.

    sizes: sets of each size. list: a hash of word, range of sizes and parts. The signature of a row is that of the list's word and those after it. place: its size
    and position; kind: its slack, its side in a list of two parts (else 0), and whether the list is the one of its own
    size: in those of larger sizes it only meets larger sets.
    """
    known, counts = order
    unknown = int(counts.min()) if len(counts) == ORDERED_WORDS else 0  # no other word has more
    num, den = threshold.numerator, threshold.denominator
    held = np.bincount(_size_range(np.array(list(sizes), np.int64)), [n * k for n, k in sizes.items()], 256) if sizes else np.zeros(256)
    share = held / max(held.sum(), 1)  # of all words in sets, those of each range
    schema = pa.schema([("list", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), *((f"s{k}", pa.int64()) for k in range(SIGNATURE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            lists = batch.column(1)
            size = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            own_slack = batch.column(2).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy()
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(ids)), size)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            count = np.where(known[at] == flat, counts[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            sort = np.lexsort((flat, count, row))
            flat, count = flat[sort], count[sort]
            pos = np.arange(len(flat)) - begin[row]
            prefix = np.minimum(size, size - (-(-(size - own_slack) * num // den) - own_slack - slack) + 1)
            keep = pos < prefix[row]
            bit = ((flat.view(np.uint64) >> np.uint64(56)) % np.uint64(64 * SIGNATURE)).astype(np.int64)
            signature = np.zeros((SIGNATURE, len(flat)), np.uint64)
            signature[bit // 64, np.arange(len(flat))] = np.uint64(1) << (bit % 64).astype(np.uint64)
            tail = np.bitwise_or.reduceat(np.where(keep, np.uint64(0), signature), begin, axis=1)
            by_prefix = np.argsort(-prefix, kind="stable")
            reach = np.searchsorted(-prefix[by_prefix], -np.arange(int(prefix.max())), "left")  # rows with a prefix beyond each position
            for p in range(int(prefix.max()) - 1, -1, -1):
                r = by_prefix[: reach[p]]
                tail[:, r] |= signature[:, begin[r] + p]
                signature[:, begin[r] + p] = tail[:, r]
            word, count, owner, pos, signature = flat[keep], count[keep], row[keep], pos[keep], signature[:, keep]
            # a word of more than that many sets has a list for each range of sizes; a set enters those of its own and of larger ones that may be similar
            long = np.where(count > 0, count, unknown) > longest
            low = _size_range(size[owner])
            most = _largest(size[owner], pos, own_slack[owner], num, den, slack)
            ranges = np.where(long, np.maximum(_size_range(np.maximum(most, 1)) - low, 0) + 1, 1)
            again = np.repeat(np.arange(len(word)), ranges)
            away = np.arange(len(again)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
            reached = low[again] + away
            name = word[again] + np.where(long[again], reached + 1, 0) * np.int64(-7046029254386353131)
            # where these are too long still, sets are dealt to parts, and every pair of parts is a list
            in_range = np.where(long, np.where(count > 0, count, unknown), 0)[again] * share[np.minimum(reached, 255)]
            parts = np.maximum(1, np.ceil(in_range / longest)).astype(np.int64)
            mine = (np.mod(ids[owner][again] * np.int64(-7046029254386353131), np.int64(1) << 40) >> 8) % parts
            deal = np.repeat(np.arange(len(again)), parts)
            other = np.arange(len(deal)) - np.repeat(np.cumsum(parts) - parts, parts)
            own, again = mine[deal], again[deal]
            first, second = np.minimum(own, other), np.maximum(own, other)
            name = name[deal] + first * np.int64(-4417276706812531889) + second * np.int64(1609587929392839161)
            side = np.where(first == second, 0, 1 + (own == second))
            kind = own_slack[owner][again] << 3 | side << 1 | (away[deal] == 0)
            out = [name, size[owner][again] << 32 | pos[again], kind, ids[owner][again], *(s[again].view(np.int64) for s in signature)]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _spans(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each place with all numbers from its low to before its high, some at a time."""
    n = high - low
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        yield np.repeat(np.arange(a, b), n[a:b]), np.arange(total[b - 1] - done) + np.repeat(low[a:b] - (total[a:b] - n[a:b] - done), n[a:b])
        a = b


def _chunk_keys(sig: np.ndarray, c: int, chunks: int) -> np.ndarray:
    """Part c of signatures, or a hash of it, in the upper 48 bits."""
    bits = 64 * SIGNATURE // chunks
    part = (sig[c * bits // 64] >> np.uint64(c * bits % 64)) << np.uint64(64 - bits)
    return (part * np.uint64(0x9E3779B97F4A7C15) if bits > 48 else part) >> np.uint64(16) << np.uint64(16)


def _pairs_of_list(rows: dict[str, np.ndarray], num: int, den: int, most_slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs that may be similar, or have followers that are; rows are in order of size and position.

    With a threshold of num/den, sets of a and b words must share ceil(num (a + b) / (num + den)) of them; followers have
    at least slack words less, and share at most slack more, than their leader. The list's word is taken to be the first
    that two sets share: words before it are all different, and only the rest of what may differ is left for those after
    it. ``spare`` is a set's part of that rest, times num + den: no pair differs in more words than both their parts, nor
    do the numbers of words that are left. Sets are dealt to bands of spare, and those of a band meet the sets of no
    higher band: where a pair differs in fewer words than CHUNKS, by sorted parts of the signature, one of which must be
    equal; otherwise, or where these are few, in blocks.
    """
    size, pos, sig, slack, home = rows["size"], rows["pos"], rows["sig"], rows["slack"], rows["home"]
    parted, unit = rows["side"].any(), num + den
    spare = size * (den - num) + 2 * slack * (2 * num + den) - pos * unit
    left = size - pos  # words from this one on
    bound = _largest(size, pos, slack, num, den, most_slack)
    folded = np.bitwise_or.reduce(sig, 0)  # all words of a set in 64 bits, which tell more than a part of the signature
    halves = sig[0] | sig[1], sig[2] | sig[3]
    found = [[], []]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.minimum(i, j), np.maximum(i, j)
        near = (i < j) & (home[j] != 0)
        if parted:
            near &= (rows["side"][i] == 0) | (rows["side"][i] != rows["side"][j])
        i, j = i[near], j[near]
        total, less = size[i] + size[j], slack[i] + slack[j]
        need = -(-num * (total - less) // unit) - less
        near = (np.minimum(left[i], left[j]) >= need) & (size[j] * num <= size[i] * den + less * unit)
        i, j, most = i[near], j[near], (total - 2 * need)[near]
        near = np.bitwise_count(sig[:, i] ^ sig[:, j]).astype(np.int64).sum(0) <= most - pos[i] - pos[j]
        found[0].append(i[near])
        found[1].append(j[near])

    def by_chunks(x: np.ndarray, y: np.ndarray, chunks: int) -> bool:
        """Pairs of x with y, which differ in fewer words than chunks; False if blocks are cheaper."""
        sorted_keys, cost = [], 0
        low_x, low_y = (np.minimum(left[v], 65000).astype(np.uint64) for v in (x, y))
        for c in range(chunks):
            key, ask = _chunk_keys(sig[:, y], c, chunks) | low_y, _chunk_keys(sig[:, x], c, chunks) | low_x
            order = np.argsort(key)
            key = key[order]
            low = np.searchsorted(key, np.maximum(ask, np.uint64(chunks)) - np.uint64(chunks), "right")
            high = np.searchsorted(key, ask + np.uint64(chunks), "left")
            cost += int((high - low).sum())
            if cost * DEARER > len(x) * len(y):
                return False
            sorted_keys.append((y[order], low, high))
        for ordered, low, high in sorted_keys:
            hers = folded[ordered]
            for i, j in _spans(low, high):
                near = np.flatnonzero(np.bitwise_count(folded[x[i]] ^ hers[j]) < chunks)
                i, j = x[i[near]], ordered[j[near]]
                near = (spare[i] + spare[j] >= 0) & ((band[j] < band[i]) | (j > i))
                keep(i[near], j[near])
        return True

    def by_blocks(x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of x with y, both in order of the words left."""
        at = left[y]
        apart = (int(spare[x].max()) + int(spare[y].max())) // unit
        room, counted = np.empty((ROWS, 2 * ROWS), np.uint64), np.empty((2, ROWS, 2 * ROWS), np.uint8)
        for a in range(0, len(x), ROWS):
            i = x[a : a + ROWS]
            j_all = y[np.searchsorted(at, left[i[0]] - apart, "left") : np.searchsorted(at, left[i[-1]] + apart, "right")]
            most = int(spare[i].max())
            j_all = j_all[(spare[j_all] + most >= 0) & (bound[j_all] >= size[i].min()) & (size[j_all] <= bound[i].max())]
            for c in range(0, len(j_all), 2 * ROWS):
                j = j_all[c : c + 2 * ROWS]
                allowed = (most + int(spare[j].max())) // unit
                words, part = int(left[j].max()), (slice(len(i)), slice(len(j)))
                differ = counted[0][part]
                if words <= 64 or words <= 128 and allowed < 4:
                    np.bitwise_count(np.bitwise_xor(folded[i][:, None], folded[j], out=room[part]), out=differ)
                elif words <= 192:
                    for bits, to in zip(halves, counted, strict=True):
                        np.bitwise_count(np.bitwise_xor(bits[i][:, None], bits[j], out=room[part]), out=to[part])
                    differ += counted[1][part]
                else:
                    differ = sum(np.bitwise_count(sig[k, i][:, None] ^ sig[k, j]).astype(np.uint16) for k in range(SIGNATURE))
                hit = np.flatnonzero(differ <= allowed)
                found_at = np.divmod(hit, len(j))
                u, v = i[found_at[0]], j[found_at[1]]
                once = ((band[v] < band[u]) | (v > u)) & (differ[found_at].astype(np.int64) * unit <= spare[u] + spare[v])
                keep(u[once], v[once])

    order = np.argsort(left, kind="stable")
    band = spare // (BAND * unit)
    top = int(band.max())
    if len(size) < SORTED:
        band = np.zeros(len(size), np.int64)
        by_blocks(order, order)
        top = -1
    for k in range(top, -1, -1):  # two sets below band 0 can't be similar
        x = order[band[order] == k]
        if not len(x):
            continue
        rest = order[(band[order] <= k) & (spare[order] >= -(k + 1) * BAND * unit)]
        # a set of this band and one of band b differ in fewer than (k + b + 2) * BAND words
        most = (band[rest] + k + 2) * BAND
        below = 0
        for chunks in (*CHUNKS, 0):
            y = rest[(most > below) & (most <= chunks)] if chunks else rest[most > below]
            if len(y) and not (chunks and len(x) * len(y) > SORTED**2 and by_chunks(x, y, chunks)):
                by_blocks(x, y)
            below = chunks
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _candidates(threshold: Fraction, most_slack: int):
    num, den = threshold.numerator, threshold.denominator
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: batch.column(k).to_numpy() for k in batch.column_names}
        sig = np.stack([c[f"s{k}"].astype(np.int64).view(np.uint64) for k in range(SIGNATURE)])
        cuts = [0, *(np.flatnonzero(np.diff(c["list"])) + 1), batch.num_rows]
        pairs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                order = a + np.argsort(c["place"][a:b], kind="stable")
                place, kind = c["place"][order], c["kind"][order].astype(np.int64)
                rows = {"size": place >> 32, "pos": place & 0xFFFFFFFF, "slack": kind >> 3, "side": kind >> 1 & 3, "home": kind & 1, "sig": sig[:, order]}
                i, j = _pairs_of_list(rows, num, den, most_slack)
                ids = c["id"][order]
                if len(i):
                    pairs.append(np.column_stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
        if pairs:
            both = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))  # the last list may go on
            goes_on = kept and kept[-1].column(0)[0].as_py() == key[0]
            if last or (kept and not goes_on):
                yield from work(pa.Table.from_batches([*kept, batch.slice(0, last)]))
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return run


class Similar:
    """The similar texts of a table: ``classes`` (class, words), ``members`` (id, same, class), ``links`` (a, b).

    A class is a set of words, named by its smallest id. Links hold every pair of different classes of which at least
    ``threshold`` of the words are shared. Ids that are null and texts that are null or without words belong to no
    class; of several rows of one id, one counts. An empty table gives empty results; extra columns are ignored.
    """

    def __init__(self, reviews: DataFrame, threshold: float = 0.8, id_col: str = "review_id", text_col: str = "text", longest: int = LIST, apart: int = APART) -> None:
        self.longest, self.apart = longest, apart
        self.threshold = Fraction(str(threshold))
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        rows = stored(_rows(reviews, id_col, text_col).withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(7), "words")), "sets")
        self.classes = stored(rows.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.min("words").alias("words")), "classes")
        self.members = rows.select("id", "same", "k1", "k2").join(self.classes.select("k1", "k2", "class"), ["k1", "k2"]).select("id", "same", "class")

    def _similar(self, shared, size_a, size_b):
        t = self.threshold
        return shared * (t.numerator + t.denominator) >= (size_a + size_b) * t.numerator

    @cached_property
    def followers(self) -> DataFrame:
        """(class, leader, size, n, less, more) of sets that follow a leader, of n words, with what they have less and more; of leaders too."""
        key = F.xxhash64(F.get("words", F.lit(0)), F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
        keyed = self.classes.select("class", key.alias("key"), "words")
        firsts = keyed.groupBy("key").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
        firsts = stored(firsts, "leaders")
        whole = self.classes.join(sized(firsts.select(F.col("leader").alias("class"), "key", "n")), "class").select("key", "n", F.col("class").alias("leader"), F.col("words").alias("whole"))
        both = join_groups(keyed, stored(whole, "leaders"), "key")
        both = both.select("class", "leader", F.size("words").alias("size"), F.size("whole").alias("n"), F.array_except("whole", "words").alias("less"), F.array_except("words", "whole").alias("more"))
        close = (F.size("less") + F.size("more") <= self.apart) & self._similar(F.col("n") - F.size("less"), F.col("size"), F.col("n"))
        near = stored(both.where(close), "followers")
        led = near.where("class <> leader").select("leader").distinct()
        return near.join(sized(led), "leader", "left_semi")

    def candidates(self) -> DataFrame:
        """(a, b): pairs of classes without a leader, or of leaders, that no bound rules out for them or their followers."""
        led = self.followers.where("class <> leader")
        slacks = durable(self.followers.groupBy("leader").agg(F.max(F.size("less") + F.size("more")).alias("slack")))
        most = slacks.agg(F.max("slack")).first()[0] or 0
        searched = self.classes.join(sized(led.select("class")), "class", "left_anti").join(sized(slacks.withColumnRenamed("leader", "class")), "class", "left")
        searched = searched.select("class", "words", F.coalesce("slack", F.lit(0)).alias("slack"))
        sizes = {r.n: r["count"] for r in self.classes.groupBy(F.size("words").alias("n")).count().collect()}
        listed = searched.mapInArrow(_list_rows(word_order(self.classes), sizes, self.threshold, self.longest, most), LISTED)
        return listed.repartition("list").sortWithinPartitions("list").mapInArrow(_candidates(self.threshold, most), "a bigint, b bigint").distinct()

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with shared, size_a and size_b, from the whole sets."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        sets = self.classes.join(sized(ends), "class", "left_semi")
        a, b = (sets.select(F.col("class").alias(e), F.col("words").alias(f"w{e}")) for e in "ab")
        return pairs.join(a, "a").join(b, "b").select(*pairs.columns, F.size(F.array_intersect("wa", "wb")).alias("shared"), F.size("wa").alias("size_a"), F.size("wb").alias("size_b"))

    @cached_property
    def leader_pairs(self) -> DataFrame:
        """(a, b, shared, size_a, size_b) of all candidates."""
        return stored(self._compared(stored(self.candidates(), "candidates")), "compared")

    def _derived(self, pairs: DataFrame) -> DataFrame:
        """(a, b): similar pairs among leaders and followers of the given leader pairs, each leader among its followers."""
        none = F.lit(0)
        sides = {}
        for e in "ab":
            sides[e] = self.followers.select(F.col("leader").alias(e), F.col("class").alias(f"c{e}"), F.col("size").alias(f"s{e}"), F.size("less").alias(f"l{e}"), F.size("more").alias(f"m{e}"))
        both = pairs.join(sized(sides["a"]), "a", "left").join(sized(sides["b"]), "b", "left")
        both = both.select("shared", *(F.coalesce(f"c{e}", e).alias(f"c{e}") for e in "ab"), *(F.coalesce(f"s{e}", f"size_{e}").alias(f"s{e}") for e in "ab"), *(F.coalesce(f"{x}{e}", none).alias(f"{x}{e}") for x in "lm" for e in "ab"))
        sure = self._similar(F.col("shared") - F.col("la") - F.col("lb"), F.col("sa"), F.col("sb"))
        maybe = self._similar(F.col("shared") + F.col("ma") + F.col("mb"), F.col("sa"), F.col("sb")) & ~sure
        ends = F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")
        compared = self._compared(stored(both.where(maybe).select(*ends), "undecided"))
        return both.where(sure).select(*ends).unionByName(compared.where(self._similar(F.col("shared"), F.col("size_a"), F.col("size_b"))).select("a", "b"))

    @cached_property
    def links(self) -> DataFrame:
        """Every similar pair of classes."""
        a, b = (self.followers.select("leader", *(F.col(c).alias(f"{c}_{e}") for c in ("class", "size", "less", "more", "n"))) for e in "ab")
        one = a.join(b, "leader").where("class_a < class_b")
        shared = F.col("n_a") - F.size(F.array_union("less_a", "less_b")) + F.size(F.array_intersect("more_a", "more_b"))
        one = one.where(self._similar(shared, F.col("size_a"), F.col("size_b"))).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        return stored(self._derived(self.leader_pairs).unionByName(one), "links")

    def pairs(self) -> DataFrame:
        """(a, b): all pairs of ids of similar texts, a the smaller, that aren't the same text but for formatting."""
        members = stored(self.members, "members")
        kinds = members.select("class", "same").distinct()
        several = kinds.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
        one, two = kinds.select(F.col("class").alias("a"), F.col("same").alias("same_a")), kinds.select(F.col("class").alias("b"), F.col("same").alias("same_b"))
        linked = self.links.select("a", "b").join(one, "a").join(two, "b").where("same_a <> same_b")
        inner = several.select(F.col("class").alias("a"), F.col("class").alias("b")).join(one, "a").join(two, "b").where("same_a < same_b")
        kinds_linked = linked.unionByName(inner)
        left = members.select(F.col("class").alias("a"), F.col("same").alias("same_a"), F.col("id").alias("x"))
        right = members.select(F.col("class").alias("b"), F.col("same").alias("same_b"), F.col("id").alias("y"))
        ids = kinds_linked.join(left, ["a", "same_a"]).join(right, ["b", "same_b"])
        return ids.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """(id, class, grp): every id with a word, its class, and the smallest class that a chain of links joins it with.

        Links within the followers of a leader aren't made: each has one with the leader. Followers are only looked at
        where their leaders aren't similar but may have followers that are.
        """
        linked = self._similar(F.col("shared"), F.col("size_a"), F.col("size_b"))
        star = self.followers.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b"))
        edges = self.leader_pairs.where(linked).select("a", "b").unionByName(self._derived(self.leader_pairs.where(~linked))).unionByName(star)
        return self.members.join(connected(edges), "class", "left").select("id", "class", F.coalesce("root", "class").alias("grp"))


def connected(edges: DataFrame) -> DataFrame:
    """(class, root) of every end of an edge (a, b): the smallest number that a chain of edges leads to.

    Large and small stars in turn: every round links a node's neighbours to the smallest of them, until nothing
    changes, in a number of rounds that grows with the logarithm of the longest chain. Rounds are cut by checkpoints.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        then = durable(small)
        if then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty():
            break
        now = then
    nodes = now.groupBy(F.col("u").alias("class")).agg(F.min("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("class"), F.col("v").alias("root")).distinct())
