"""Distinctive words and word counts, against SQL and brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from termforge.llm import distinctive, queries, suffix_counts

POSTING = "word string, rid bigint, freq int, flush_id bigint, hash string, degree int, kind int"
DEAD = "rid bigint, word string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    got = oracle.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(map(tuple, got.fetchall()), key=repr)


def dirty(seed=3, n=3000):
    rnd = random.Random(seed)
    data = [(rnd.choice(["a", " A", "b", "c\t", "dd", f"w{rnd.randint(0, 50)}", None]), rnd.choice([None, *range(1, 60)]), rnd.choice([None, 0, -3, 1, 1, 2, 5]), rnd.choice([None, 1, 2]), "x", 1, 1) for _ in range(n)]
    return data + data[:100]


def live(data, dead):
    once, out = {}, collections.Counter()
    for w, r, f, fl, *_ in data:
        if w is not None and r is not None and f and f > 0 and r not in dead:
            k = (w.strip().lower(), r, fl)
            once[k] = max(once.get(k, 0), f)
    for (w, r, _), f in once.items():
        out[w, r] += f
    return out


def test_distinctive_words(spark, monkeypatch):
    """With every review heavy, cut into small blocks, and with none: frequencies and counts are those of brute force, degrees agree."""
    monkeypatch.setattr(distinctive, "BLOCK", 8)
    data = [*dirty(), ("huge", 61, 2**31 - 1, 1, "x", 1, 1), ("b", 61, 5, 1, "x", 1, 1), ("c", 61, 1, 1, "x", 1, 1)]
    want = live(data, {4, 5})
    df = spark.createDataFrame(data, POSTING)
    length, reviews, mentions = collections.Counter(), collections.Counter(), collections.Counter()
    for (w, r), f in want.items():
        length[r] += f
        reviews[w] += 1
        mentions[w] += f
    others = collections.Counter(r for _, r in want)
    seen = []
    for heavy in (0.0001, 2.0):
        monkeypatch.setattr(distinctive, "HEAVY_REVIEW", heavy)
        dead = spark.createDataFrame([(4, "a"), (5, "b"), (None, "c"), (5, "d")], DEAD)
        got = distinctive.distinctive_words(df, dead, best_first=True).collect()
        assert {(r.word, r.rid): r.freq for r in got} == dict(want) and len(got) == len(want)
        for r in got:
            assert (r.length, r.reviews, r.mentions, r.all_mentions) == (length[r.rid], reviews[r.word], mentions[r.word], sum(want.values()))
            assert (r.degree > 0) == (others[r.rid] > 1) and r.degree <= min(others[r.rid] - 1, 2 * (distinctive.WINDOW - 1) * r.freq)
        for rid in {r.rid for r in got}:
            own = [(-r.score, r.word) for r in got if r.rid == rid]
            assert own == sorted(own)
        seen.append({(r.rid, r.word): r.degree for r in got})
    assert seen[0] == seen[1]


def test_degrees_in_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f".split()), (2, ["x", "x", "y", None]), (3, None), (4, [])], "id bigint, words array<string>")
    got = {(r.id, r.word): (r.freq, r.degree) for r in distinctive.degrees_of_texts(df, "id", "words", 3).collect()}
    assert got == {(1, "a"): (1, 2), (1, "b"): (1, 3), (1, "c"): (1, 4), (1, "d"): (1, 4), (1, "e"): (1, 3), (1, "f"): (1, 2), (2, "x"): (2, 1), (2, "y"): (1, 1)}


def test_empty_index(spark):
    none, dead = spark.createDataFrame([], POSTING), spark.createDataFrame([], DEAD)
    assert distinctive.distinctive_words(none, dead).count() == 0
    assert suffix_counts.word_counts(none, dead).count() == 0 and suffix_counts.live_reviews(none, dead) == 0
    assert suffix_counts.marked_words(suffix_counts.word_counts(none, dead), 0).count() == 0


def test_word_counts_and_marks(spark):
    data = dirty(8)
    want = live(data, {4})
    df, dead = spark.createDataFrame(data, POSTING), spark.createDataFrame([(4, "a")], DEAD)
    reviews, mentions = collections.Counter(w for w, _ in want), collections.Counter()
    for (w, _), f in want.items():
        mentions[w] += f
    counts = suffix_counts.word_counts(df, dead)
    assert rows(counts.select("word", "mentions", "reviews")) == sorted(((w, mentions[w], reviews[w]) for w in reviews), key=repr)
    n = len({r for _, r in want})
    assert suffix_counts.live_reviews(df, dead) == n
    marks = {r.word: r.mark for r in suffix_counts.marked_words(counts, n).collect()}
    assert marks == {w: "rare" if c <= 2 else "common" if c >= 0.2 * n else None for w, c in reviews.items()}


@pytest.mark.parametrize("n_max", [1, 2, 3])
def test_all_ngrams(spark, n_max):
    """Small batches, so that intervals reach over many borders."""
    rnd = random.Random(n_max)
    records = [(i, [rnd.choice("abcab") for _ in range(rnd.randint(0, 40))]) for i in range(200)] + [(1, ["a", "b"]), (2, None), (None, ["a"])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 61)
    try:
        df = spark.createDataFrame(records, "id bigint, w array<string>").withColumn("w1", F.lit("clash")).withColumn("record", F.lit(0))
        got = {tuple(r[f"w{k}"] for k in range(1, r.n + 1)): (r.occurrences, r.records) for r in suffix_counts.ngram_counts(df, "id", "w", n_max).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    occurrences, where = collections.Counter(), collections.defaultdict(set)
    for i, w in records:
        for n in range(1, n_max + 1):
            for a in range(len(w or []) - n + 1):
                if i is not None:
                    occurrences[tuple(w[a : a + n])] += 1
                    where[tuple(w[a : a + n])].add(i)
    assert got == {g: (c, len(where[g])) for g, c in occurrences.items()}
