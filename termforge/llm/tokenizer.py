"""Encoding whole text columns with a public byte-level tokenizer, and decoding.

Texts are cut before every run of white space: no token of a byte-level vocabulary of this kind reaches across such a
place, so the parts can be encoded one by one. Distinct parts are encoded once with the tokenizers library and kept
in a bounded cache; whole Arrow batches are then put together with array operations.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers are; a parameter of every operator here.
TOKENIZERS = os.environ.get("TERMFORGE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"

#: The characters with the Unicode property White_Space, as a character class.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A blank between two characters that aren't white space: a sure border of tokens.
SURE = re.compile(f"(?<=[^{SPACES}\\x1c-\\x1f]) (?=[^{SPACES}\\x1c-\\x1f])")
#: White space, as RE2 has it, and some more.
_WS = "[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
#: Texts with a blank inside a run of white space aren't cut at every blank.
UNSURE = f"{_WS} {_WS}|{_WS} $"
#: Parts kept, and characters of a part that is kept.
CACHED, CACHED_CHARS = 400_000, 48
#: Bytes of text worked on at a time.
GROUP_BYTES = 4_000_000


class Encoder:
    """Encodes Arrow string arrays; one for each process and vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens_of: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def add(self, parts: list[str]) -> range:
        """Rows of the table for the parts, which are new to it."""
        first = self.rows
        for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            ids = e.ids
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if self.rows == len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[self.rows], self.size[self.rows] = self.used, len(ids)
            self.used += len(ids)
            self.rows += 1
        return range(first, self.rows)

    def find(self, parts: list[str]) -> np.ndarray:
        """Row of the table for each part; asks the tokenizer for those that aren't there."""
        got = [self.known.get(p, -1) for p in parts]
        new = [p for p, k in zip(parts, got, strict=True) if k < 0]
        if new:
            new = list(dict.fromkeys(new))
            at = dict(zip(new, self.add(new), strict=True))
            self.known.update((p, k) for p, k in at.items() if len(p) <= CACHED_CHARS)
            got = [at[p] if k < 0 else k for p, k in zip(parts, got, strict=True)]
        return np.array(got, np.int64)

    def counts_of(self, parts: list[str]) -> list[int]:
        """Tokens of each part by itself."""
        got = list(map(self.tokens_of.get, parts))
        if None in got:
            new = list(dict.fromkeys(p for p, n in zip(parts, got, strict=True) if n is None))
            rows = self.find(new)  # may put a larger table in place of self.size
            sizes = dict(zip(new, self.size[rows].tolist(), strict=True))
            self.tokens_of.update((p, n) for p, n in sizes.items() if len(p) <= CACHED_CHARS)
            got = [sizes[p] if n is None else n for p, n in zip(parts, got, strict=True)]
        return got

    def trim(self) -> None:
        if max(len(self.known), len(self.tokens_of)) > CACHED or self.used > 8_000_000:
            self.forget()

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(table row of each part, parts before each text)"""
        unsure = np.asarray(pc.match_substring_regex(texts, UNSURE))
        lists = pc.split_pattern(texts, " ")
        if unsure.any():
            where = np.flatnonzero(unsure)
            own = pa.array([SURE.split(t) for t in texts.take(pa.array(where)).to_pylist()], lists.type)
            order = np.arange(len(texts))
            order[where] = len(texts) + np.arange(len(where))
            lists = pa.concat_arrays([lists, own]).take(pa.array(order))
        flat = lists.flatten()
        before = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
        coded = flat.dictionary_encode()
        code, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        head = np.zeros(len(code), bool)
        head[before[:-1][before[:-1] < before[1:]]] = True
        row = np.empty(len(code), np.int64)
        # all parts of the batch are asked for at once: at most the words at the start of a text, and those after a blank
        lead, rest = np.unique(code[head]), np.unique(code[~head])
        found = self.find([words[k] for k in lead] + [" " + words[k] for k in rest])
        to = np.empty(len(words), np.int64)
        to[lead] = found[: len(lead)]
        row[head] = to[code[head]]
        to[rest] = found[len(lead) :]
        row[~head] = to[code[~head]]
        return row, before

    def counts(self, texts: pa.Array) -> np.ndarray:
        row, before = self.parts(texts)
        total = np.concatenate([[0], np.cumsum(self.size[row])])
        self.trim()
        return total[before[1:]] - total[before[:-1]]

    def encode(self, texts: pa.Array) -> pa.Array:
        row, before = self.parts(texts)
        size, start = self.size[row], self.start[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        self.trim()
        return pa.ListArray.from_arrays(pa.array(total[before].astype(np.int32)), pa.array(ids, pa.int32()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def groups(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(some rows, their texts without nulls): at most GROUP_BYTES of text, or one longer text."""
    for batch in batches:
        texts = batch.column(text).cast(pa.string()).fill_null("")
        size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // GROUP_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a), pa.concat_arrays([texts.slice(a, b - a)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids): the token ids of each whole text, without special tokens; no shuffle.

    A null text and an empty text give an empty list. Text that looks like a special token is ordinary text. Repeated
    rows and null ids stay; extra columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), encoder(path).encode(texts)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, tokens): the number of token ids of each text, 0 for a null or empty one; no shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(encoder(path).counts(texts))], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, tokens bigint")


def encode_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids, starts, ends): with the code points that each token covers.

    A token that holds only some bytes of a character covers that whole character. Null and empty texts give empty lists.
    """
    schema = pa.schema([(id_col, pa.int64()), *((n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches):
            got = encoder(path).tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            lists = [pa.array([e.ids for e in got], pa.list_(pa.int32())), *(pa.array([[o[k] for o in e.offsets] for e in got], pa.list_(pa.int32())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, ids array<int>, starts array<int>, ends array<int>")


def byte_of_character() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable Latin-1 for itself, the rest in turn from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id; special tokens stand for their own text."""
    table = byte_of_character()
    out = [b""] * (max(encoder(path).tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in encoder(path).tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def finished_texts(ids: list[int], path: str = BYTE_BPE) -> list[str]:
    """For each token the text that it completes: a character split over tokens comes with the last of them.

    Bytes that can't become a character come out as U+FFFD. The texts joined are the decoded whole.
    """
    import codecs

    decoder, table = codecs.getincrementaldecoder("utf-8")("replace"), token_bytes(path)
    out = [decoder.decode(table[i]) for i in ids]
    if out:
        out[-1] += decoder.decode(b"", True)
    return out


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, text): the bytes of the tokens through the byte table, read as UTF-8; null or empty ids give an empty text."""
    schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(path), pa.binary())
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(pc.list_value_length(lists).fill_null(0))
            cuts = np.append(0, np.cumsum(size)).astype(np.int32)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), table.take(lists.flatten())), b"")
            try:
                texts = whole.cast(pa.string())
            except pa.ArrowInvalid:  # ids that don't make up characters
                texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], schema=schema)

    return tokens.select(F.col(id_col).cast("bigint").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` bigint, text string")
