"""Encoding, packing and splitting, against the tokenizers library and by their own rules."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from termforge.llm import packing, splitting, tokenizer

pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokenizer.BYTE_BPE), reason="no tokenizer files")

DOC = "doc_id bigint, text string, ids string, tokens string, grp int, piece int"
ODD = ["", None, " ", "   ", "a", " a", "a ", "a  ", "a   b", "a\n\n b", "a \nb", "\n", "x  y", "x  y", "<|endoftext|> a", "日本語。 テキスト", "👩‍👩‍👧 🏽", "don't  DON'T", "\x1c \x1d x", "a  b", "z" * 3000, "ab " * 4000, "\u0000 \u0000", "a\r\n\r\nb", "．" * 700, "é" * 900]


def library(texts):
    own = tokenizer.encoder(tokenizer.BYTE_BPE).tokenizer
    return [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], DOC)


def fuzz(seed, n):
    rnd = random.Random(seed)
    bits = ["a", "the", " ", " ", "  ", "\n", "\n\n", "\t", " ", "　", ".", "!? ", "'s", "12", "日本", "é", "\x1c", "\x0b", "\r\n", "# ", "😀", " "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_encoding_equals_the_library():
    texts = [*ODD, *fuzz(1, 3000)]
    own = tokenizer.encoder(tokenizer.BYTE_BPE)
    array = pa.array([t or "" for t in texts])
    want = library(texts)
    assert own.encode(array).to_pylist() == want
    assert own.counts(array).tolist() == list(map(len, want))
    own.forget()
    assert own.encode(array).to_pylist() == want


def test_encode_and_decode(spark):
    df = docs(spark, ODD)
    got = tokenizer.encode(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert [r.ids for r in got.orderBy("doc_id").collect()] == library(ODD)
    assert [r.text for r in tokenizer.decode(got).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert [r.tokens for r in tokenizer.token_counts(df).orderBy("doc_id").collect()] == [len(x) for x in library(ODD)]
    assert tokenizer.encode(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a", "", "", 1, 1), (1, "a", "", "", 1, 1), (1, "a", "", "", 1, 1)], DOC)
    assert tokenizer.encode(twice).count() == 3


def test_offsets_and_split_characters(spark):
    row = tokenizer.encode_offsets(docs(spark, ["a 𓀀 é"])).first()
    text = "a 𓀀 é"
    assert len(row.ids) == len(row.starts) == len(row.ends) and row.ends[-1] == len(text)
    assert {text[a:b].strip() for a, b in zip(row.starts, row.ends, strict=True)} - {""} == {"a", "𓀀", "é"}
    bits = tokenizer.finished_texts(row.ids)
    assert "".join(bits) == text and "" in bits and len(bits) == len(row.ids)
    assert tokenizer.finished_texts([tokenizer.token_bytes(tokenizer.BYTE_BPE).index(b"\xf0")])[-1] == "�"


def check_pieces(text, pieces, limit, overlap):
    """Order, cover, sizes counted by the library, overlap."""
    own = tokenizer.encoder(tokenizer.BYTE_BPE).tokenizer
    count = lambda s: len(own.encode(s, add_special_tokens=False).ids)
    end, before = 0, -1
    for b, e, n, r in pieces:
        assert b <= end < e and b > before and n == count(text[b:e]) <= limit
        assert r == (count(text[b:end]) if b < end else 0) and r <= overlap
        end, before = e, b
    assert end == len(text)


@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (40, 8), (16, 0)])
def test_pieces_follow_the_rules(limit, overlap):
    own = tokenizer.encoder(tokenizer.BYTE_BPE)
    texts = [t for t in ODD if t] + [t * 40 for t in fuzz(limit, 150) if t]
    for text in texts:
        check_pieces(text, splitting.split_text(text, limit, overlap, own.counts_of), limit, overlap)


def test_cuts_are_natural():
    own = tokenizer.encoder(tokenizer.BYTE_BPE)
    paragraph = "One sentence is here. " * 9 + "The last one."
    text = "\n\n".join([paragraph] * 6)
    ends = {text[:e][-13:] for _, e, _, _ in splitting.split_text(text, 60, 0, own.counts_of)}
    assert ends == {"The last one."}
    ends = [text[:e].rstrip()[-1] for _, e, _, _ in splitting.split_text(text, 30, 0, own.counts_of)]
    assert set(ends) == {"."}
    words = "word " * 300
    assert all(words[:e].endswith("word") or e == len(words) for _, e, _, _ in splitting.split_text(words, 50, 10, own.counts_of))


def test_cuts_depend_on_the_atom_alone():
    """Sentences without blanks are found wherever they stand in the text."""
    own = tokenizer.encoder(tokenizer.BYTE_BPE)
    sentences, latin = "良い天気。散歩へ。 " * 400, "Latin word " * 100
    count = lambda text: splitting.Atoms(text, own.counts_of, 448)
    alone, after = count(sentences), count(latin + sentences)
    assert len(after.cum) - len(alone.cum) == 200 and len(after.places[splitting.SENTENCE]) == len(alone.places[splitting.SENTENCE]) > 800
    text = latin + "いい。（はい）。" * 200
    check_pieces(text, splitting.split_text(text, 60, 10, own.counts_of), 60, 10)


def test_split_documents(spark):
    df = docs(spark, [*ODD, "word " * 600, None])
    got = splitting.split_documents(df).orderBy("doc_id", "piece").collect()
    sizes = [len(x) for x in library([*ODD, "word " * 600])]
    assert {r.doc_id for r in got} == {i for i, n in enumerate(sizes) if n > 512}
    for i in {r.doc_id for r in got}:
        text = [*ODD, "word " * 600][i]
        own = [r for r in got if r.doc_id == i]
        assert [r.piece for r in own] == list(range(len(own))) and all(r.text == text[r.begin : r.end] for r in own)
        check_pieces(text, [(r.begin, r.end, r.tokens, r.repeated) for r in own], 512, 64)
    assert splitting.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_documents(df, limit=10, overlap=10)


def test_differencing_is_near_equal():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 500, 400)
    sums = np.bincount(packing.differencing(sizes, 16), sizes, minlength=16)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    assert packing.differencing(np.array([7]), 3).tolist() in ([0], [1], [2])
    assert np.bincount(packing.pack_group(np.full(9, 60), 100)).max() == 1


def filled(got):
    out = {}
    for r in got:
        out[r.container] = out.get(r.container, 0) + r.tokens
    return out


def test_items_above_capacity(spark):
    """Only whole containers; one item of over a million containers beside others; hosts of tiny items."""
    two = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(4096).alias("tokens"))
    got = packing.pack(two, "doc_id", "tokens", 2048)
    assert got.count() == got.select("container").distinct().count() == 10_000
    huge = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit(2048 * 1_100_000 + 1)).otherwise(1000).cast("bigint").alias("tokens"))
    sums = packing.pack(huge, "doc_id", "tokens", 2048).groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()
    assert tuple(sums) == (2048, 2048 * 1_100_000 + 1 + 899_000, 1_100_450)
    tiny = packing.pack(spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 + 1).alias("tokens")), "doc_id", "tokens", 2048).collect()
    assert max(filled(tiny).values()) <= 2048 and len(tiny) == 100_000 and len(filled(tiny)) <= 100


@pytest.mark.parametrize("windows", [2, 192])
def test_containers(spark, windows):
    rnd = random.Random(windows)
    sizes = [rnd.choice([1, 5, 50, 99, 100, 101, 250, 1000]) for _ in range(300)]
    data = [(i, n, "c", 1) for i, n in enumerate(sizes)] + [(900, 0, "c", 1), (901, None, "c", 1), (902, -4, "c", 1), (None, 30, "c", 1), (3, 30, "c", 1), (3, 30, "c", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, tokens bigint, container string, grp int")
    got = packing.pack(df, "doc_id", "tokens", 100, windows).collect()
    total = sum(n for _, n, *_ in data if n and n > 0)
    assert max(filled(got).values()) <= 100 and sum(filled(got).values()) == total
    for i, n in enumerate(sizes):
        own = sorted((r.start, r.tokens) for r in got if r.doc_id == i)
        if i == 3:
            continue
        assert own == [(s, min(100, n - s)) for s in range(0, n, 100)]  # split only above capacity
    assert sum(r.doc_id is None for r in got) == 1
    if windows > 2:
        assert len(filled(got)) <= 1.03 * total / 100 + 1
    assert packing.pack(df.limit(0), "doc_id", "tokens", 100).count() == 0


def test_documents_on_disk(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    table = df.select("doc_id", "text").orderBy("doc_id").collect()
    assert rows(tokenizer.encode(df)) == rows(spark.createDataFrame(list(zip([r.doc_id for r in table], library([r.text for r in table]), strict=True)), "doc_id bigint, ids array<int>"))
