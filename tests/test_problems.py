"""Heavy keys and rows that fail to parse, against brute force and edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA, rows
from termforge.operators import heavy_keys, raw_records

POSTING = "word string, rid bigint, freq int, flush_id bigint, reviews string, estimate int"


def test_word_stats_with_heavy_words(spark):
    rnd = random.Random(5)
    data = []
    for i in range(6000):
        word = "hot" if i % 3 == 0 else f"w{rnd.randint(0, 900)}"
        data.append((rnd.choice([word, f" {word.upper()} "]), rnd.randint(1, 2000), rnd.choice([1, 2, 0, -1, None]), rnd.choice([1, 2, None]), "x", 1))
    data += [(None, 1, 1, 1, "x", 1), ("w1", None, 1, 1, "x", 1), *data[:50]]
    dead = {5, 6, 7}
    once = {}
    for w, r, f, fl, *_ in data:
        if w is not None and r is not None and f and f > 0 and r not in dead:
            k = (w.strip().lower(), r, fl)
            once[k] = max(once.get(k, 0), f)
    live = defaultdict(int)
    for (w, r, _), f in once.items():
        live[w, r] += f
    want = defaultdict(lambda: [0, 0])
    for (w, _), f in live.items():
        want[w][0] += 1
        want[w][1] += f
    df = spark.createDataFrame(data, POSTING)
    tombs = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (7, 1), (None, 1), (0, 1)], "rid bigint, word int")
    assert rows(heavy_keys.word_stats(df, tombs)) == sorted(((w, *n) for w, n in want.items()), key=repr)
    heavy = {r.word for r in heavy_keys.heavy_keys(df, "word", 0.1).collect()}
    assert heavy == {"hot", " HOT "}
    for share in (1e-4, 0.3):  # all words are heavy, or none is
        assert rows(heavy_keys.word_stats(df, tombs, share)) == sorted(((w, *n) for w, n in want.items()), key=repr)
    with pytest.raises(ValueError, match="share"):
        heavy_keys.heavy_keys(df, "word", 1e-7)


def test_word_stats_of_empty_tables(spark):
    none, dead = spark.createDataFrame([], POSTING), spark.createDataFrame([], "rid bigint")
    assert heavy_keys.word_stats(none, dead).count() == 0
    assert heavy_keys.frequent_words(heavy_keys.word_stats(none, dead), 0.1).count() == 0
    assert heavy_keys.heavy_keys(none, "word", 0.1).count() == 0


def slow_reason(record, layout):
    """The rules one by one, row by row."""
    if record is None or not record.strip(" \t\r\n"):
        return "empty"
    values = {}
    if layout == "line":
        columns, i, n = [], 0, len(record)
        while True:
            while i < n and record[i] in " \t\r\n":
                i += 1
            if i < n and record[i] == '"':
                text, i = "", i + 1
                while True:
                    if i >= n:
                        return "quoting"
                    if record[i] == '"':
                        if i + 1 < n and record[i + 1] == '"':
                            text, i = text + '"', i + 2
                            continue
                        i += 1
                        break
                    text, i = text + record[i], i + 1
                while i < n and record[i] in " \t\r\n":
                    i += 1
                if i < n and record[i] != ",":
                    return "quoting"
                columns.append(text)
            else:
                j = record.find(",", i)
                j = n if j < 0 else j
                if '"' in record[i:j]:
                    return "quoting"
                columns.append(record[i:j].strip(" \t\r\n"))
                i = j
            if i >= n:
                break
            i += 1
        if len(columns) != 4:
            return "field_count"
        values = dict(zip(raw_records.FIELDS, columns, strict=True))
    else:
        seen = defaultdict(list)
        for line in record.split("\n"):
            if not line.strip(" \t\r"):
                continue
            if ":" not in line:
                return "no_separator"
            name, value = line.split(":", 1)
            seen[name].append(value.strip(" \t\r"))
        if any(len(seen[f]) != 1 for f in raw_records.FIELDS):
            return "field_count"
        values = {f: seen[f][0] for f in raw_records.FIELDS}
    _, help_, score, text = (values[f] for f in raw_records.FIELDS)
    m = re.fullmatch(r"[ \t]*([0-9]+)[ \t]*/[ \t]*([0-9]+)[ \t]*", help_)
    if not m or int(m[1]) > int(m[2]) or int(m[2]) > 32767:
        return "helpfulness"
    if not re.fullmatch(r"[1-5](\.0+)?", score):
        return "score"
    if re.search("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text):
        return "text"
    return None


def mutated(rnd):
    base = rnd.choice(['P1,1/2,5,"a, ""b""\nc"', 'P1 , 3 / 3 ,"4.0", x', "product/productId: P\nreview/helpfulness: 1/1\r\n\nreview/score:5.0\nreview/text: it: is é", "  \t"])
    out = list(base)
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randint(0, len(out))
        if rnd.random() < 0.5:
            out.insert(at, rnd.choice(['"', ",", "\n", "\r", " ", ":", "\x07", "�", "9", "日", "x" * 300]))
        elif at < len(out):
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("chunk", [3, 256])
def test_records_against_the_rules(chunk, monkeypatch):
    monkeypatch.setattr(raw_records.tokenize, "__defaults__", (chunk,))
    monkeypatch.setattr(raw_records, "CHUNKS", 37 * chunk)
    rnd = random.Random(chunk)
    cases = [(mutated(rnd), rnd.choice(["line", "block"])) for _ in range(4000)] + [(None, "line"), ("", "block"), ("a", None)]
    layout = np.array([0 if k == "line" else 1 for _, k in cases])
    got = raw_records._typed(pa.array([r for r, _ in cases], pa.string()), layout)[0].to_pylist()
    want = [slow_reason(r, k) for r, k in cases]
    assert [(c, a, b) for c, a, b in zip(cases, got, want, strict=True) if a != b] == []
    assert set(want) >= {None, *raw_records.REASONS}


def test_typed_rows_offsets_and_edges(spark):
    long_text = "word, " * 60_000
    data = [
        (1, "line", ' P1 , 1/2 ,5.00,"say ""hi"", ok"', "x"),
        (2, "block", "review/text: a: b\r\nproduct/productId:P2\nreview/other: 1\nreview/score: 3\nreview/helpfulness: 0 / 0", "x"),
        (3, "line", f'P3,1/2,5,"{long_text}"', "x"),
        (4, "line", 'P4,1/2,5,"open', "x"),
        (5, "block", "product/productId: P\nbroken line\nreview/score: 1", "x"),
        (6, "line", "P,2/1,5,t", "x"),
        (6, "line", "P,2/1,5,t", "x"),
        (None, "line", "P,1/1,9,t", "x"),
        (8, None, None, None),
        (9, "line", "P9,1/99999999999999999999,5,t", "x"),
    ]
    df = spark.createDataFrame(data, "rec_id bigint, layout string, record string, reason string")
    good, bad = raw_records.split(df)
    assert {r.rec_id: (r.product_id, r.helpfulness_num, r.helpfulness_den, r.score, len(r.text)) for r in good.collect()} == {1: ("P1", 1, 2, 5, 12), 2: ("P2", 0, 0, 3, 4), 3: ("P3", 1, 2, 5, len(long_text))}
    assert rows(bad) == sorted([(4, "quoting", 14), (5, "no_separator", 32), (6, "helpfulness", 0), (6, "helpfulness", 0), (None, "score", 0), (8, "empty", 0), (9, "helpfulness", 0)], key=repr)
    assert raw_records.parse(df.limit(0)).count() == 0


def test_rejected_and_valid_cover_the_table(spark):
    raw = spark.read.parquet(f"{DATA}/raw_reviews.parquet")
    good, bad = raw_records.split(raw)
    assert good.count() + bad.count() == raw.count()
    want = {r.rec_id: slow_reason(r.record, r.layout) for r in raw.collect()}
    assert {r.rec_id: r.reason for r in bad.collect()} == {k: v for k, v in want.items() if v}
