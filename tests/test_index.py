"""Lifecycle of an index: both strategies agree with each other and with an index built anew without the deleted reviews."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from termforge.index.catalog import Catalog
from termforge.index.reader import IndexReader
from termforge.index.writer import LogMergeWriter, SimpleMergeWriter
from termforge.operators import layout, postings
from termforge.plans import workload
from termforge.sources import dumps
from termforge.sources import reviews as source
from termforge.streaming.ingest import insert_stream

REVIEW = "seq bigint, product_id string, helpfulness_num bigint, helpfulness_den bigint, score bigint, text string"


def reviews(spark, n, start=0, seed=1):
    rnd = random.Random(seed + start)
    data = [(start + i, f"P {i}", 1, 2, 5, " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randint(0, 9)))) for i in range(n)]
    return spark.createDataFrame(data, REVIEW)


def build(spark, writer):
    writer.construct(reviews(spark, 12))
    writer.insert(reviews(spark, 5, 12))
    writer.remove(spark.createDataFrame([(3,), (3,), (14,), (0,), (-5,), (999,), (None,)], "rid bigint"))
    writer.insert(reviews(spark, 7, 17))
    writer.insert(reviews(spark, 0, 24))
    return IndexReader(spark, writer.catalog.root)


@pytest.fixture(scope="module")
def expected(spark):
    every = reviews(spark, 12).unionByName(reviews(spark, 5, 12)).unionByName(reviews(spark, 7, 17)).withColumn("rid", F.col("seq") + 1)
    live = every.where("rid NOT IN (3, 14)")
    return rows(postings.build_postings(live).select("term", "rid", "freq")), rows(postings.build_meta(live).select("rid", "review_length"))


@pytest.mark.parametrize("capacity", [None, 1, 4, 16, 1000])
def test_strategies_agree(spark, tmp_path, expected, capacity):
    root = str(tmp_path / "index")
    reader = build(spark, SimpleMergeWriter(spark, root) if capacity is None else LogMergeWriter(spark, root, capacity))
    assert rows(reader.postings().select("term", "rid", "freq")) == expected[0]
    assert rows(reader.meta().select("rid", "review_length")) == expected[1]
    assert reader.reviews_indexed() == 24
    a = sorted((t for t in expected[0] if t[0] == "a"), key=lambda t: t[1])
    assert [tuple(r) for r in reader.term("a").collect()] == [(r, f) for _, r, f in a]
    assert reader.mentions("a") == sum(f for *_, f in a) and reader.reviews_with("a") == len(a)
    assert reader.mentions("nothing") == 0 and reader.term("A").count() == 0 and reader.term(" A", normalize=True).count() == len(a)
    if capacity:
        assert reader.segment_count() == reader.manifest.flushes.bit_count()


def test_compaction_keeps_answers_and_snapshots(spark, tmp_path, expected):
    writer = SimpleMergeWriter(spark, str(tmp_path / "index"))
    old = build(spark, writer)
    writer.compact()
    new = IndexReader(spark, writer.catalog.root)
    assert rows(new.segment_rows().select("term", "rid", "freq")) == expected[0] and not new.manifest.tombstones
    assert new.segment_count() == 1 and old.segment_count() == 4
    assert rows(old.postings().select("term", "rid", "freq")) == expected[0]  # its files are still there
    assert not writer.catalog.vacuum() and writer.catalog.vacuum(spare_s=0) and rows(new.postings().select("term", "rid", "freq")) == expected[0]
    assert new.disk_bytes() > 0
    writer.catalog.drop()
    assert not writer.catalog.exists()


def test_metadata_lookup(spark, tmp_path):
    reader = build(spark, SimpleMergeWriter(spark, str(tmp_path / "index")))
    got = {r.rid: tuple(r)[1:] for r in reader.lookup(spark.createDataFrame([(1,), (3,), (0,), (77,), (None,)], "rid bigint")).collect()}
    assert got[1][:4] == ("P 0", 5, 1, 2)
    assert got[3] == got[0] == got[77] == got[None] == (None, -1, -1, -1, -1)


def test_everything_deleted(spark, tmp_path):
    writer = SimpleMergeWriter(spark, str(tmp_path / "index"))
    writer.construct(reviews(spark, 3))
    writer.remove(spark.range(1, 4).withColumnRenamed("id", "rid"))
    writer.compact()
    reader = IndexReader(spark, writer.catalog.root)
    assert reader.postings().count() == 0 and reader.total_reviews().first()[0] == 0 and reader.total_tokens().first()[0] == 0
    assert writer.insert(reviews(spark, 2)) == 2 and IndexReader(spark, writer.catalog.root).reviews_indexed() == 5


def test_errors_and_malformed(spark, tmp_path):
    writer = SimpleMergeWriter(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        writer.insert(reviews(spark, 1))
    writer.construct(spark.createDataFrame([(0, "p", None, 1, 5, "x y"), (1, None, 0, 0, 1, None)], REVIEW))
    assert Catalog(spark, writer.catalog.root).load().malformed == 1
    reader = IndexReader(spark, writer.catalog.root)
    assert reader.reviews_indexed() == 2 and rows(reader.meta().select("rid", "review_length")) == [(2, 0)] and reader.postings().count() == 0
    with pytest.raises(FileExistsError):
        writer.construct(reviews(spark, 1))
    with pytest.raises(ValueError, match="rids"):
        writer.insert(reviews(spark, 1).withColumn("rid", F.lit(1)))
    stale = writer.catalog.load()
    writer.insert(reviews(spark, 1))
    with pytest.raises(RuntimeError, match="another writer"):
        writer.catalog.commit(stale)


def test_layout_equals_stepwise_merging():
    assert [{k for k, _ in layout.live_levels(n)} for n in (1, 2, 3, 4, 6)] == [{0}, {1}, {0, 1}, {2}, {1, 2}]
    levels: list[int] = []
    for n in range(1, 200):
        new = 0
        while new in levels:
            levels.remove(new)
            new += 1
        levels.append(new)
        assert sorted(levels) == sorted(k for k, _ in layout.live_levels(n))
        assert layout.clears(n - 1, n) == (len(levels) == 1 and n > 1)


def test_stream_inserts_once(spark, tmp_path):
    reviews(spark, 6).write.parquet(str(tmp_path / "in"))
    writer = LogMergeWriter(spark, str(tmp_path / "index"), 8)
    for _ in range(2):
        insert_stream(spark.readStream.schema(REVIEW).parquet(str(tmp_path / "in")), writer, str(tmp_path / "ckpt")).awaitTermination()
    reader = IndexReader(spark, writer.catalog.root)
    assert reader.reviews_indexed() == 6
    assert writer.insert_once(reviews(spark, 2), next(iter(reader.manifest.streams)), 0) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "dump.txt").write_text("product/productId: B1\nreview/userId: U\nreview/helpfulness: 1/2\nreview/score: 5.0\nreview/text: Good: dog food\n\nproduct/productId: B2\nreview/score: 5.0\nreview/score: 4.0\nreview/helpfulness: 1/2\nreview/text: x\n\nno colon\n\n")
    got = source.read_dump(spark, str(tmp_path / "dump.txt")).collect()
    assert [(r.product_id, r.helpfulness_num, r.helpfulness_den, r.score, r.text, r.problem) for r in got] == [("B1", 1, 2, 5, "Good: dog food", None), ("B2", 1, 2, None, "x", "review/score"), (None, None, None, None, None, "line")]
    (tmp_path / "words.txt").write_text("dog 1;\ncat 22;\nbad\n")
    assert rows(source.read_words(spark, str(tmp_path / "words.txt"))) == [("cat", 22), ("dog", 1)]
    dumps.write_pairs(source.read_words(spark, str(tmp_path / "words.txt")), "word", "id", str(tmp_path / "again"))
    assert rows(source.read_words(spark, str(tmp_path / "again"))) == [("cat", 22), ("dog", 1)]
    dumps.write_lines(spark.createDataFrame([("a", None, 1)], "x string, y string, z int"), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a  1"]
    folder = tmp_path / "ins"
    folder.mkdir()
    for n in ("10_x.txt", "9.txt", "readme"):
        (folder / n).write_text("")
    assert [p.rsplit("/", 1)[-1] for p in source.insert_files(spark, str(folder))] == ["9.txt", "10_x.txt"]
    words = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "word string")
    assert source.sample_words(words, 2).count() == 2 and rows(source.number_words(words)) == [("a", 1), ("b", 2), ("c", 3)]
    numbered = source.number_words(words)
    assert source.word_number(numbered, "b") == 2 and source.word_number(numbered, "x") == -1


RECORD = ["product/productId: B{0}", "review/userId: U", "review/helpfulness: 1/2", "review/score: 5.0", "review/text: w{0} same"]


@pytest.mark.parametrize(("split", "end"), [("2001", "\n"), ("2048", "\r\n"), ("1000000", "\n")])
def test_dump_to_index(spark, tmp_path, split, end):
    """Records that lie across any number of splits, blank lines with blanks, no blank line at the end; rids follow files and places."""
    records = [end.join([*RECORD, *(["x: " + "y" * 90] * (80 if i % 4 == 3 else 3))]).format(i) for i in range(9)] + ["no colon", end.join(RECORD[1:])]
    (tmp_path / "a.txt").write_bytes((end * 2 + " \t" + end).join(records[:5]).encode() + (end + " " + end * 3).encode())
    (tmp_path / "b.txt").write_bytes((end * 2).join(records[5:]).encode())
    (tmp_path / "c.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / f"{x}.txt") for x in "abc"]
        got = source.read_dump(spark, paths).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(11)) and [r.product_id for r in got[:9]] == [f"B{i}" for i in range(9)]
        assert [r.problem for r in got] == [None] * 9 + ["line", "product/productId"]
        writer = SimpleMergeWriter(spark, str(tmp_path / "index"))
        assert writer.construct(paths[1:]) == 6 and writer.insert(paths[0]) == 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    reader = IndexReader(spark, writer.catalog.root)
    assert reader.manifest.malformed == 2 and reader.raw_tokens() == 18 and reader.totals() == (9, 18)
    assert rows(reader.postings().where("term <> 'same'").select("term", "rid")) == sorted((f"w{i}", i - 4 if i > 4 else i + 7) for i in range(9))


def test_vacuum_in_the_middle_of_an_insert(spark, tmp_path, monkeypatch):
    writer = SimpleMergeWriter(spark, str(tmp_path / "index"))
    writer.construct(reviews(spark, 6))
    commit = writer.catalog.commit

    def late(manifest):
        assert Catalog(spark, writer.catalog.root).vacuum(spare_s=0) == []
        return commit(manifest)

    monkeypatch.setattr(writer.catalog, "commit", late)
    writer.insert(reviews(spark, 6, 6))
    monkeypatch.undo()
    assert len(rows(IndexReader(spark, writer.catalog.root).meta())) == 12
    writer.compact()  # the files of the version before aren't used any more
    assert len(Catalog(spark, writer.catalog.root).vacuum(spare_s=0)) > 0 and len(rows(IndexReader(spark, writer.catalog.root).meta())) == 12


@pytest.mark.parametrize("conditional", [False, True])
def test_two_writers_of_one_version(spark, tmp_path, conditional):
    catalog = Catalog(spark, str(tmp_path / "index"))
    one, two = catalog.load() if catalog.exists() else None, None
    SimpleMergeWriter(spark, catalog.root).construct(reviews(spark, 2))
    one, two = catalog.load(), catalog.load()
    catalog.commit(one, conditional)
    with pytest.raises(RuntimeError, match="another writer"):
        catalog.commit(two, conditional)
    assert catalog.versions() == [1, 2] and catalog.load().next_rid == 3


def test_terms_counted_inside_the_row(spark):
    df = spark.createDataFrame([(1, "b a b. A " + "z" * 128), (2, ""), (3, None), (None, "a"), (4, "one")], "rid bigint, text string")
    want = [("a", 1, 2), ("b", 1, 2), ("one", 4, 1)]
    assert rows(postings.build_postings(df, unique=True)) == want == rows(postings.build_postings(df).select("term", "rid", "freq"))


def test_workload_results(spark, tmp_path):
    source.write_dump(reviews(spark, 20).withColumn("rid", F.col("seq") + 1), str(tmp_path / "first"))
    source.write_dump(reviews(spark, 9).withColumn("rid", F.col("seq") + 1), str(tmp_path / "2_x"), "\r\n")
    got = workload.run(spark, str(tmp_path / "first"), [str(tmp_path / "2_x")], ["a"], (16,))
    assert {r[:2] for r in got} == {("simple", 0), ("log", 16)} and {r[3] for r in got} == {"construct_ms", "insert_ms", "merge_ms", "query_ms", "bytes", "segments", "reviews"}
    assert {r.metric: r.average for r in workload.averages(spark, got).where("strategy = 'simple'").collect()}["reviews"] == (20 + 29 + 29) / 3
    dumps.write_log(workload.results(spark, got), str(tmp_path / "log"), "run")
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(lines) == 1 + len(got) and lines[0].startswith("run 2") and dumps.elapsed("x", 61_001) == "Elapsed time for x: 1 in mins, 61 in secs, 61001 in ms"
