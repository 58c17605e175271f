"""Cutting long texts into pieces under a token limit, at natural boundaries, with overlap.

A text is seen as atoms, each a run of white space and the word after it, whose token counts add up exactly. Places
between atoms have a rank: section, paragraph, line, sentence, word, part of a word, character. A text is cut at its
highest rank first; what is still too long is cut again at the next, and neighbours are packed greedily to the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.tokenizer import BYTE_BPE, SPACES, encoder, groups

SECTION, PARAGRAPH, LINE, SENTENCE, WORD, PART, CHARACTER = 6, 5, 4, 3, 2, 1, 0

ATOM = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Line ends; ends of sentences with closing marks; line starts that begin a section.
BREAKS = re.compile("\r\n|[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]")
LINE_BREAK = re.compile(f"[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029][{SPACES}]*")
HEADING = re.compile(r"#{1,6}[ \t]|<h[1-6]\b|={3,}|-{3,}|\*{3,}")
SENTENCE_END = re.compile(f"[.!?…。！？؟।．][\"'”’»)\\]」』）]*(?=[{SPACES}])")
INNER_END = re.compile("[。！？．][\"'”’»)\\]」』）]*$")
INNER = re.compile("[。！？．]")
#: Atoms of more tokens are cut further; characters of the atoms that come of a word without any place to cut.
LONG_ATOM, LETTERS = 64, 16
#: Atoms of at most so many tokens are never cut; those between are, at ends of sentences inside them.
SMALL_ATOM = 8


def _parts() -> re.Pattern:
    """Runs of letters, digits or other characters, as the tokenizers cut them, with leading white space kept."""
    import regex

    return regex.compile(r"\s*(?:'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)|\s+")


class Atoms:
    """Atoms of one text: cum tokens before each, off code points before each, rank of the place before each."""

    def __init__(self, text: str, find_counts, core: int) -> None:
        words = ATOM.findall(text)
        counts = find_counts(words)
        self.exact = True
        ranks = None
        self.long, self.letters = min(LONG_ATOM, core // 4), max(1, min(LETTERS, core // 4))
        self.small = min(SMALL_ATOM, self.long)
        if max(counts, default=0) > self.small:
            words, counts, ranks = self.cut(words, counts, find_counts)
        self.exact &= max(counts, default=0) <= core
        n = len(words)
        self.cum = [0, *accumulate(counts)]
        self.off = [0, *accumulate(map(len, words))]
        # only a few places between words can be more than the end of a word
        more: dict[int, int] = {}
        for m in SENTENCE_END.finditer(text):
            i = bisect_left(self.off, m.end())
            if self.off[i] == m.end():
                more[i] = SENTENCE
        for m in LINE_BREAK.finditer(text):
            i = bisect_right(self.off, m.start()) - 1
            lines = len(BREAKS.findall(text, self.off[i], m.end()))
            more[i] = SECTION if lines > 2 or "\x0c" in m[0] or HEADING.match(text, m.end()) else PARAGRAPH if lines > 1 else LINE
        if ranks is not None:
            more = {i: r for i, r in more.items() if i < n and ranks[i] is None} | {i: r for i, r in enumerate(ranks) if r is not None}
        more |= {0: SECTION, n: SECTION}
        high = sorted(more)
        self.places = {r: [i for i in high if more[i] >= r] for r in range(SENTENCE, SECTION + 1)}
        for r in (CHARACTER, PART, WORD):
            self.places[r] = range(n + 1) if ranks is None else [i for i in range(n + 1) if more.get(i, WORD) >= r]

    def cut(self, words: list[str], counts: list[int], find_counts) -> tuple[list[str], list[int], list]:
        """Long atoms without white space inside: at ends of sentences in scripts without blanks, else between runs of letters, else after LETTERS characters.

        What is done with an atom depends on that atom alone. All cuts but those inside a run of letters are where the
        tokenizer cuts as well.
        """
        out, ranks, size = [], [], self.letters
        for word, count in zip(words, counts, strict=True):
            if count <= self.small or (count <= self.long and not INNER.search(word)):
                out.append(word)
                ranks.append(None)
                continue
            first, fresh = True, True  # of the atom; of a sentence
            for run in PARTS.findall(word) or [word]:
                if count <= self.long:  # its sentences stay whole
                    if fresh:
                        out.append(run)
                        ranks.append(None if first else SENTENCE)
                    else:
                        out[-1] += run
                else:
                    for k in range(0, len(run), size) if len(run) > 2 * size else [0]:
                        bit = run[k : k + size] if len(run) > 2 * size else run
                        self.exact &= len(run) <= 2 * size
                        out.append(bit)
                        ranks.append(None if first else CHARACTER if k else SENTENCE if fresh else PART)
                        first = False
                first, fresh = False, bool(INNER_END.search(run))
        if "".join(out) != "".join(words):  # characters that no pattern takes up
            out = [w[k : k + size] for w in words for k in range(0, len(w), size)]
            ranks = [CHARACTER] * len(out)
            self.exact = False
        return out, find_counts(out), ranks


PARTS = _parts()


def cores(atoms: Atoms, limit: int, core: int) -> list[tuple[int, int]]:
    """Runs of atoms, of at most core tokens, the first of at most limit."""
    cum = atoms.cum
    out: list[tuple[int, int]] = []

    def room(a: int) -> int:
        return limit if a == 0 else core

    def split(a: int, b: int, rank: int) -> None:
        if cum[b] - cum[a] <= room(a) or b - a == 1:
            out.append((a, b))
            return
        places = atoms.places[rank]
        if rank and bisect_left(places, b) == bisect_right(places, a):  # none inside
            split(a, b, rank - 1)
            return
        while a < b:
            reach = bisect_right(cum, cum[a] + room(a)) - 1
            if reach >= b:
                end = b
            else:
                k = bisect_right(places, reach) - 1
                end = places[k] if k >= 0 else 0
            if end > a:
                out.append((a, end))
            else:
                k = bisect_right(places, a)
                end = min(places[k], b) if k < len(places) else b
                split(a, end, max(rank - 1, 0))
            a = end

    if len(cum) > 1:
        split(0, len(cum) - 1, SECTION)
    packed = out[:1]  # what was left over of a part that was cut goes with what comes after, where both fit
    for a, b in out[1:]:
        first = packed[-1][0]
        if cum[b] - cum[first] <= room(first):
            packed[-1] = (first, b)
        else:
            packed.append((a, b))
    return packed


def split_text(text: str, limit: int, overlap: int, find_counts) -> list[tuple[int, int, int, int]]:
    """(begin, end, tokens, tokens repeated) of the pieces, in code points; pieces of one text cover it in order."""
    atoms = Atoms(text, find_counts, limit - overlap)
    cum, off = atoms.cum, atoms.off
    if cum[-1] <= limit and atoms.exact:
        return [(0, len(text), cum[-1], 0)] if text else []
    pieces, before = [], 0
    for a, b in cores(atoms, limit, limit - overlap):
        start = a
        if a and overlap:
            least = max(bisect_left(cum, cum[a] - overlap), before + 1)
            for rank in (SENTENCE, WORD, CHARACTER):
                places = atoms.places[rank]
                k = bisect_left(places, least)
                if k < len(places) and places[k] < a:
                    start = places[k]
                    break
        pieces.append((start, a, b))
        before = start
    if atoms.exact:
        return [(off[s], off[b], cum[b] - cum[s], cum[a] - cum[s]) for s, a, b in pieces]
    # counts of parts of words needn't add up: count the pieces themselves, shorten the overlap where they are over
    out = []
    spans = [(off[s], off[a], off[b]) for s, a, b in pieces]
    whole = find_counts([text[s:b] for s, _, b in spans])
    for (s, a, b), n in zip(spans, whole, strict=True):
        while n > limit and s < a:
            s = min(a, s + max(1, (a - s) // 2))
            n = find_counts([text[s:b]])[0]
        if n > limit:  # cut by halves; a character has at most four tokens, so this ends
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                n = find_counts([text[x:y]])[0]
                if n <= limit or y - x == 1:
                    out.append((x, y, n, 0))
                else:
                    todo += [((x + y) // 2, y), (x, (x + y) // 2)]
        else:
            out.append((s, b, n, find_counts([text[s:a]])[0] if s < a else 0))
    return out


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64, path: str = BYTE_BPE) -> DataFrame:
    """(id, piece, begin, end, tokens, repeated, text): pieces of each text above ``limit`` tokens, in order from 0.

    begin and end are code points; a piece's first ``repeated`` tokens, at most ``overlap``, repeat the end of the piece
    before; all pieces together cover the text. Texts of at most ``limit`` tokens, null and empty ones have no rows.
    A repeated row is split again; extra columns are ignored; an empty table gives an empty result. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    schema = pa.schema([(id_col, pa.int64()), ("piece", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("tokens", pa.int32()), ("repeated", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)

        for rows, texts in groups(batches):
            ids, out = rows.column(0), []
            for i in np.flatnonzero(own.counts(texts) > limit):
                text = texts[int(i)].as_py()
                key = ids[int(i)].as_py()
                out += [(key, n, b, e, t, r, text[b:e]) for n, (b, e, t, r) in enumerate(split_text(text, limit, overlap, own.counts_of))]
                own.trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, piece int, begin bigint, `end` bigint, tokens int, repeated int, text string")
