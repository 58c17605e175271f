"""Formatting duplicates and similar texts, against brute force."""

import collections
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from conftest import DATA, rows
from termforge import session
from termforge.llm import format_duplicates, near_duplicates
from termforge.llm.canonical import canonical_text, words

REVIEW = "review_id bigint, text string, id bigint, same string, hash string, block int, words string"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "s", "h", 2, "w") for i, t in pairs], REVIEW)


def canonical(text):
    bare = lambda s: regex.sub(r"[^\p{L}\p{N}]+", "", s)
    pieces = [p for p in regex.split(r"[|;\n\r]+", text.lower()) if p.strip()]
    if len(pieces) > 1 and all(regex.match(r"[^\p{L}\p{N}:]*[\p{L}\p{N}]+[^\p{L}\p{N}:]*:", p) for p in pieces):
        return "".join(sorted(map(bare, pieces)))
    return bare(text.lower())


FORMS = [
    ("Good dog, food!", "good  DOG (food)", True),
    ("Pros: a b | Cons: c", "CONS : c;\n_Pros_: a, b", True),
    ("first: a\nthen b", "then b\nfirst: a", False),
    ("a b", "ab", True),
    ("a b", "b a", False),
    ("ünï 1", "ÜNÏ 1", True),
]


@pytest.mark.parametrize(("a", "b", "same"), FORMS)
def test_canonical_form(spark, a, b, same):
    got = [r[0] for r in spark.createDataFrame([(a,), (b,)], "t string").select(canonical_text(F.col("t"))).collect()]
    assert (got[0] == got[1]) == same and got == [canonical(a), canonical(b)]


def copies_of(pairs):
    groups = collections.defaultdict(set)
    for i, t in pairs:
        if i is not None and t and canonical(t):
            groups[canonical(t)].add(i)
    return groups


def test_copies(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(["x", "yy", "z:", "|", "W"]) for _ in range(6)) for _ in range(200)]
    pairs = [(i, rnd.choice([str.upper, str.lower, str.title])(rnd.choice(base))) for i in range(300)] + [(900, "hot text")] + [(1000 + i, rnd.choice(["Hot text!", "hot, text"])) for i in range(300)]
    pairs += [(5, pairs[5][1]), (5, pairs[5][1]), (2000, None), (2001, ""), (2002, "...!"), (2002, "...!"), (None, "hot text"), (2003, "long " * 50_000), (2004, "LONG " * 50_000)]
    df = table(spark, pairs)
    groups = copies_of(pairs)
    assert rows(format_duplicates.copies(df)) == sorted(((min(g), i) for g in groups.values() for i in g if i != min(g)), key=repr)
    want = [(min(g), len(g)) for g in groups.values()] + [(2000, 1), (2001, 1), (2002, 1)]
    assert rows(format_duplicates.collapse(df)) == sorted(want, key=repr)
    none = df.limit(0)
    assert format_duplicates.copies(none).count() == 0 and format_duplicates.collapse(none).count() == 0


def test_filter_misses_no_repeat(spark):
    rnd = random.Random(4)
    hashes = [rnd.getrandbits(63) - (1 << 62) for _ in range(5000)]
    df = spark.createDataFrame([(h,) for h in hashes + hashes[:400] + [hashes[0]] * 500], "hash bigint").repartition(5)
    marked = format_duplicates.possible_repeats(df, 5900)
    maybe = collections.Counter(r.hash for r in marked.where("maybe").collect())
    assert marked.count() == 5900 and all(h in maybe for h in hashes[:400])
    assert len(maybe) < 400 + 0.1 * 5000  # few others are shuffled


def test_filter_in_ranges(spark, monkeypatch):
    """Many blocks, a few of which are broadcast at a time; groups that are too many to broadcast but for the hot ones."""
    monkeypatch.setattr(format_duplicates, "TEXT_BITS", 1 << 16)
    monkeypatch.setattr(format_duplicates, "FILTER_BYTES", 1 << 20)
    monkeypatch.setattr(session, "is_small", lambda df: False)
    pairs = [(i, f"text {i % 200 if i < 250 else 'hot' if i < 300 else i}") for i in range(400)]
    assert format_duplicates.block_number(400) == 13
    want = sorted(((min(g), i) for g in copies_of(pairs).values() for i in g if i != min(g)), key=repr)
    assert rows(format_duplicates.copies(table(spark, pairs))) == want and len(want) == 99
    assert sum(n for _, n in rows(format_duplicates.collapse(table(spark, pairs)))) == 400


def test_places_in_two_bytes():
    rnd = random.Random(1)
    for top in (5, 70_000, format_duplicates.BLOCK_BITS):
        places = np.array(sorted(rnd.sample(range(top), 5)))
        assert format_duplicates.unpack_places(format_duplicates.pack_places(places)).tolist() == places.tolist()
    every = np.array([0, 65534, 65535, 131069, 131070, 131071, 1 << 20])
    assert format_duplicates.unpack_places(format_duplicates.pack_places(every)).tolist() == every.tolist()


def similar(pairs, t=(7, 10)):
    texts = {}
    for i, x in pairs:
        if i is not None and x and regex.findall(r"[\p{L}\p{N}]+", x.lower()):
            texts.setdefault(i, x)
    sets = {i: frozenset(regex.findall(r"[\p{L}\p{N}]+", x.lower())) for i, x in texts.items()}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) * t[1] >= len(sets[a] | sets[b]) * t[0] and canonical(texts[a]) != canonical(texts[b])}, sets


def noisy(seed, n=250, vocabulary=400):
    rnd = random.Random(seed)
    base = [[f"w{int(rnd.paretovariate(0.4)) % vocabulary}" for _ in range(rnd.choice([1, 3, 8, 20, 90]))] for _ in range(n // 3)]
    pairs = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 1 + len(w) // 6)):
            at = rnd.randint(0, len(w))
            w[at : at + rnd.randint(0, 1)] = [f"w{rnd.randint(0, vocabulary)}"] * rnd.randint(0, 1)
        rnd.shuffle(w) if rnd.random() < 0.3 else None
        pairs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return pairs + [(i, t.upper()) for i, t in pairs[:20]] + [(n, None), (n + 1, ""), (n + 2, "!?"), (None, "w1 w2"), (n + 3, "w1w2"), (n + 4, "w1 w2"), *((n + 10 + k, "hot words here") for k in range(40)), (n + 60, "here hot words")]


@pytest.mark.parametrize(("longest", "apart", "known"), [(16384, 1, 1 << 20), (20, 3, 64), (16384, 0, 1 << 20)])
def test_similar_pairs(spark, longest, apart, known, monkeypatch):
    """Also with lists cut into parts of 20 sets, counts of a few words only, and leaders of sets of three words' difference, or none."""
    monkeypatch.setattr(near_duplicates, "ORDERED_WORDS", known)
    pairs = noisy(longest + apart)
    want, sets = similar(pairs)
    found = near_duplicates.Similar(table(spark, pairs), 0.7, longest=longest, apart=apart)
    assert (found.followers.count() > 0) == (apart > 0)
    assert rows(found.pairs()) == sorted(want, key=repr) and len(want) > 100
    # groups: the components of all pairs of equal or similar sets
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(sorted(sets)):
        for b in sorted(sets)[n + 1 :]:
            if len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 7:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.id: r.grp for r in found.groups().collect()}
    assert got == {i: top(i) for i in sets}


@pytest.mark.parametrize(("chunked", "longest"), [(True, 1 << 18), (True, 300), (False, 1 << 18)])
def test_long_lists_of_frequent_words(chunked, longest, monkeypatch):
    """Sets of a small vocabulary, so that lists hold most of them: found by parts of signatures, in ranges of sizes, and in blocks."""
    looked = []
    real = np.bitwise_count
    monkeypatch.setattr(near_duplicates.np, "bitwise_count", lambda x, **k: looked.append(x.size) or real(x, **k))
    monkeypatch.setattr(near_duplicates, "SORTED", 50 if chunked else 1 << 20)
    rnd = random.Random(11)
    rare, often, most = (range(k, k + n) for k, n in ((0, 3000), (3000, 120), (4000, 30)))
    vocabulary = [*rare, *often, *most]
    mixed = lambda n: rnd.sample(rare, n // 6) + rnd.sample(often, n // 3) + rnd.sample(most, min(30, n // 2))
    sets = [mixed(rnd.choice([18, 36, 48, 66])) for _ in range(2500)]
    for k in range(0, 2500, 5):  # and near ones
        n = len(sets[k])
        sets.append(sets[k][rnd.randint(0, n // 8) :] + mixed(rnd.randint(0, n // 8)))
    classes = {k: frozenset(x) for k, x in enumerate(sets)}
    counts = collections.Counter(w for x in classes.values() for w in x)
    number = {w: rnd.getrandbits(63) - (1 << 62) for w in vocabulary}
    known = sorted((number[w], n) for w, n in counts.items())
    order = np.array([w for w, _ in known]), np.array([n for _, n in known])
    threshold = Fraction(7, 10)
    batch = pa.record_batch([pa.array(list(classes)), pa.array([[number[w] for w in x] for x in classes.values()]), pa.array([0] * len(classes), pa.int32())], names=["class", "words", "slack"])
    sizes = collections.Counter(map(len, classes.values()))
    listed = pa.Table.from_batches(near_duplicates._list_rows(order, sizes, threshold, longest, 0)(iter([batch]))).sort_by("list").combine_chunks()
    got = set()
    for b in near_duplicates._candidates(threshold, 0)(iter(listed.to_batches(max_chunksize=1000))):
        got |= set(zip(*(b.column(k).to_pylist() for k in range(2)), strict=True))
    held = np.zeros((len(sets), max(vocabulary) + 1), np.float32)
    for k, x in classes.items():
        held[k, list(x)] = 1
    shared, n = held @ held.T, held.sum(1)
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(shared * 17 >= (n[:, None] + n) * 7, 1))), strict=True))
    assert len(want) > 200 and want <= got and len(got) < 3 * len(want)
    if chunked:  # a row of a list isn't compared with all others, nor is it in many lists
        of_word = sum(n * n for n in counts.values())
        assert sum(looked) < of_word / 100 and listed.num_rows < 15 * len(classes)


def test_threshold_and_default(spark):
    pairs = noisy(9, 120)
    assert rows(near_duplicates.Similar(table(spark, pairs)).pairs()) == sorted(similar(pairs, (8, 10))[0], key=repr)
    with pytest.raises(ValueError, match="threshold"):
        near_duplicates.Similar(table(spark, pairs), 0)


def test_similar_of_empty_and_long(spark):
    none = near_duplicates.Similar(table(spark, [(1, None)]).limit(0), 0.7)
    assert none.pairs().count() == 0 and none.groups().count() == 0
    long = " ".join(f"u{i}" for i in range(20_000))
    assert rows(near_duplicates.Similar(table(spark, [(1, long), (2, long + " more"), (3, "u1 u2")]), 0.7).pairs()) == [(1, 2)]


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    assert {r["class"]: r.root for r in near_duplicates.connected(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert near_duplicates.connected(edges.limit(0)).count() == 0


def test_words_column(spark):
    df = spark.createDataFrame([("It's a_B c c",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["it", "s", "a", "b", "c"]


def test_tables_on_disk(spark):
    reviews = spark.read.parquet(f"{DATA}/reviews.parquet")
    pairs = [(r.review_id, r.text) for r in reviews.collect()]
    assert rows(near_duplicates.Similar(reviews, 0.7).pairs()) == sorted(similar(pairs)[0], key=repr)
    assert rows(format_duplicates.copies(reviews)) == sorted(((min(g), i) for g in copies_of(pairs).values() for i in g if i != min(g)), key=repr)
