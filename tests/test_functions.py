from pyspark.sql import functions as F
import pytest

from termforge.functions import codec, tokens
from termforge.operators import postings
from termforge.operators.numbering import gap_decode, gap_encode, running


def test_tokens(spark):
    cases = [("naïve_x 1e5 don't", ["naïve", "x", "1e5", "don", "t"]), ("ⅷ ² ½ ٣", ["٣"]), ("𝐀bc 😀 x", ["bc", "x"]), ("Σίσυφος ΟΔΟΣ", ["σίσυφος", "οδος"]), ("", []), (None, []), ("Good: dog food", ["good", "dog", "food"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r.i: r.t for r in df.select("i", tokens.raw_tokens(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_long_terms_are_dropped(spark):
    df = spark.createDataFrame([("a" * 127 + " " + "b" * 128 + " c",)], "text string")
    row = df.select(tokens.terms(F.col("text")).alias("t"), tokens.text_length(F.col("text")).alias("n")).first()
    assert row.t == ["a" * 127, "c"] and row.n == 2


BOUNDS = {0: "00", 63: "3F", 64: "4040", 16383: "7FFF", 16384: "804000", 4194303: "BFFFFF", 4194304: "C0400000", 1073741823: "FFFFFFFF"}


def test_varint_bounds(spark):
    df = spark.createDataFrame([(v,) for v in [*BOUNDS, -1, 1 << 30]], "v bigint")
    got = {r.v: (r.c, r.n) for r in df.select("v", F.hex(codec.varint_encode(F.col("v"))).alias("c"), codec.varint_length(F.col("v")).alias("n")).collect()}
    assert got == {v: (c, len(c) // 2) for v, c in BOUNDS.items()} | {-1: (None, None), 1 << 30: (None, None)}


def test_int_bytes(spark):
    df = spark.createDataFrame([(0,), (258,), (2**31 + 1,), (2**32,), (-1,)], "v bigint")
    assert [r.c for r in df.select(F.hex(codec.int_bytes(F.col("v"))).alias("c")).collect()] == ["00000000", "00000102", "80000001", None, None]


def test_varint_stream(spark):
    df = spark.createDataFrame([("".join(BOUNDS.values()),), ("",)], "h string").select(codec.varint_decode(F.unhex("h")).alias("d"))
    assert [r.d for r in df.collect()] == [list(BOUNDS), []]
    many = spark.createDataFrame([("4040" * 3000,), (None,), ("3F",)], "h string").select(codec.varint_decode_sums(F.unhex("h")).alias("d")).collect()
    assert many[0].d == [64 * k for k in range(1, 3001)] and many[1].d is None and many[2].d == [63]
    with pytest.raises(Exception, match="truncated"):
        spark.createDataFrame([("40",)], "h string").select(codec.varint_decode(F.unhex("h")).alias("d")).collect()


def test_dictionary_blocks_and_front_coding(spark):
    terms = ["ab", "abc", "abd", "b", "ba", "bb", "c", "ca", "cab"]
    rows = spark.createDataFrame([(t, 1, 1) for t in terms], "term string, rid bigint, freq bigint")
    words = postings.dictionary(rows)
    assert [(r.term, r.tid, r.block, r.pos) for r in words.orderBy("tid").collect()] == [(t, i + 1, i // 8, i % 8) for i, t in enumerate(terms)]
    coded = postings.front_coded(words)
    got = {r.term: (r.prefix_len, r.suffix) for r in coded.collect()}
    assert got["ab"] == (2, "ab") and got["abd"] == (2, "d") and got["b"] == (0, "b") and got["cab"] == (3, "cab")
    assert sorted(r.term for r in postings.front_decoded(coded.drop("term")).collect()) == terms


def test_running_numbers_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v")).repartition(7)
    got = running(df, ["k"], {"before": "v"}, "n").collect()
    assert all(r.n == r.k and r.before == 2 * r.k for r in got) and len(got) == 1000


def test_empty_postings(spark):
    none = spark.createDataFrame([], "rid bigint, text string")
    rows = postings.build_postings(none)
    assert rows.count() == 0 and postings.pointers(rows).count() == 0 and postings.nested(rows).count() == 0


@pytest.mark.parametrize("hot", [1, 5])
def test_gaps_of_lists_over_many_partitions(spark, hot):
    """One list holds a half of the rows, or all, over many small partitions and batches."""
    data = [(f"t{i % hot}" if i % 2 else "hot", 7 * i + 3, 1 + i % 3) for i in range(2000)] + [("zz", 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = spark.createDataFrame(data, "term string, rid bigint, freq bigint")
        coded = gap_encode(df)
        before, want = {}, []
        for n, (t, r, f) in enumerate(sorted(data)):
            want.append((t, r, f, r - before.get(t, 0), n))
            before[t] = r
        assert sorted(map(tuple, coded.collect())) == want
        assert sorted(map(tuple, gap_decode(coded.drop("rid")).collect())) == sorted(data)
        assert gap_decode(gap_encode(df.limit(0)).drop("rid")).count() == 0
    finally:
        for name in ("shuffle.partitions", "adaptive.coalescePartitions.enabled", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.set(f"spark.sql.{name}", "4") if name[0] == "s" else spark.conf.unset(f"spark.sql.{name}")
